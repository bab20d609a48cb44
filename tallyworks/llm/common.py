"""Helpers shared by the training-data operators.

Row identity: ``doc_id`` may be null or repeated, so operators that join a
decision back to its row use ``row_key`` (id, null as the largest long, plus a
64-bit hash of the text). Rows equal in both are one document to them.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONG_MAX = 9223372036854775807


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine one of our own where it is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = sc._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return str(made.get()).rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='tallyworks-')}"
    sc.setCheckpointDir(own)
    return shared_dir(spark)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended, and its folder with it
        pass


def materialize(df: DataFrame, label: str = "cut", rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage and survives lost executors.

    The table is deleted when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyworks-{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is not taken, whatever its case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learned from; a null id is treated as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    return (
        F.coalesce(df[id_col].try_cast("long"), F.lit(LONG_MAX)),
        F.xxhash64(F.coalesce(df[text_col], F.lit(""))),
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, most_bytes: int = 1 << 28) -> DataFrame:
    """(doc_id, text, label) of at most about ``bound`` labelled training rows and ``most_bytes`` bytes of text, chosen by hashes.

    Rows of the held-out fold, with a null label or a null id never enter. A document labelled more
    than once takes its largest label; rows equal in id and text count once, so neither an id of very
    many rows nor a repeated row goes beyond the bounds.
    """
    rows = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    n = rows.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * bound / n)))
    # at most about `bound` rows of two numbers: small enough to send to every task
    own = docs.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("_h")).join(F.broadcast(rows), "doc_id")
    size = own.select("_h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("b")).distinct().agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    share = min(1.0, bound / max(1, size["n"]), most_bytes / max(1, size["b"] or 0))
    if share < 1:
        own = own.where(F.pmod(F.xxhash64("_h"), F.lit(1_000_000)) < F.lit(int(1_000_000 * share)))
    return own.dropDuplicates(["doc_id", "_h"]).select("doc_id", "text", "label")


_held: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker between tasks. A worker is reused by other operators, so only the last one's cache stays."""
    if owner not in _held:
        _held.clear()
        _held[owner] = {}
    return _held[owner]
