"""Sharding by weighted rendezvous hashing.

Each record key is scored against every shard, ``-weight / ln(u)`` with ``u`` a
uniform hash of (key, shard), and goes to the shard with the highest score. A
further shard changes no other score, so the only records that move are those
the new shard wins: a share of weight_new / weight_all.

Edge cases: a null key is a key of its own (all null keys go to one shard); a
null text has size 8 and crc32 0; repeated rows each get their own slot; an
empty table gives an empty result; other columns are carried or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SHARDS = 24
#: Most rows of a file of the written table.
SLICE = 500_000


def _uniform(key: Column, shard: int) -> Column:
    """A number in (0, 1) from the top 53 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(2**53))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard number 0..len(weights)-1 of a key; shards of weight 0 take nothing."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be at least 0, one of them above")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    scores = [
        F.struct((F.lit(-float(w)) / F.log(_uniform(text, i))).alias("s"), F.lit(-i).alias("i"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["i"]).cast("int")


def assign_shards(df: DataFrame, key: str, shards: int = SHARDS, weights: list[float] | None = None) -> DataFrame:
    """``df`` with shard and grown_shard (the shard under one more of mean weight)."""
    w = list(weights or [1.0] * shards)
    return df.withColumns(
        {"shard": rendezvous(F.col(key), w), "grown_shard": rendezvous(F.col(key), [*w, sum(w) / len(w)])}
    )


def number_slots(df: DataFrame, order: str) -> DataFrame:
    """``df`` (with a shard column) plus slot, gapless from 0 in each shard.

    The rows are written once, in files of at most ``SLICE`` rows; a slice of a shard is what one file
    holds of it, so no task ever gets a whole shard or a whole hot key. Slices are counted, their starts
    are running sums over (files x shards) counts, and rows are numbered within slices.
    """
    cut = materialize(df, "slots", rows_per_file=SLICE).withColumn("_file", F.col("_metadata.file_path"))
    slices = cut.groupBy("shard", "_file").agg(F.count(F.lit(1)).alias("_n"))
    starts = slices.select(
        "shard", "_file", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_file")) - F.col("_n")).alias("_start")
    )
    within = Window.partitionBy("shard", "_file").orderBy(F.col(order).asc_nulls_last())
    return (
        cut.withColumn("_row", F.row_number().over(within))
        .join(starts, ["shard", "_file"])
        .withColumn("slot", (F.col("_start") + F.col("_row") - 1).cast("long"))
        .drop("_file", "_row", "_start")
    )


def write_shards(df: DataFrame, key: str, path: str, weights: list[float] | None = None, shards: int = SHARDS) -> None:
    """Write every record under path/shard=N; files of one shard come from many tasks."""
    assign_shards(df, key, shards, weights).drop("grown_shard").write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = number_slots(assign_shards(rows, "doc_id", SHARDS), "doc_id")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
