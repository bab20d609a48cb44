"""Connected components by alternating large and small stars, as joins and pre-aggregated minima.

Node ids may be of any type that Spark orders. The minima are written before edges meet them, so that
both sides of that join are plain exchanges and a node of very many edges can be split over tasks (an
aggregate under a join can't). Each round is written to the shared folder, so lineage
stays short and a lost executor costs one round at most. Nothing is gathered on the driver but a
count and a checksum of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _distinct(edges: DataFrame) -> DataFrame:
    """hi, lo with hi > lo, once each."""
    return edges.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).where("hi <> lo").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, label): the smallest node reachable, for every node that has an edge to another node."""
    e = materialize(_distinct(edges.select(F.col(src).alias("hi"), F.col(dst).alias("lo"))), "edges")
    state = _state(e)
    while state[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(_distinct(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))), "edges")
        low = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(low.select("hi", F.col("m").alias("lo")))
        e = materialize(_distinct(small), "edges")
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionAll(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct()
    )
