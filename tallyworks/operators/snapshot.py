"""Tables in the folder that driver and executors share: intermediate results that cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir (on one machine a folder of our own where it is unset)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("tallyworks.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tallyworks-')}"
        spark.conf.set("tallyworks.shared.dir", base)
    return base.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    except Exception:  # the session may have ended, and its folder with it
        pass


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder for something of one run; it goes when the Python process ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write and read again in the shared folder."""
    path = scratch(df.sparkSession, "ledger")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
