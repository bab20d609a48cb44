import os
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]
os.environ.setdefault("PYTHONPATH", "")
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ['PYTHONPATH']}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{base}/shared")
        .config("spark.sql.warehouse.dir", f"{base}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("FATAL")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """values(builder, rows, schema): the builder's column over rows of one value, in order."""
    from pyspark.sql import functions as F

    def run(build, rows, kind="string"):
        df = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], f"k int, v {kind}")
        return [r["o"] for r in df.select("k", build(F.col("v")).alias("o")).orderBy("k").collect()]

    return run
