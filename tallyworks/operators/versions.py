"""Two versions of many invoices: which side each field comes from, and why, in one shuffle by id."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import merge_from, present, rank
from ..schema import INVOICE, MERGED_FIELDS
from .validate import infer_and_check

#: Why a side won: no side has a value, only one has, its source ranks higher, it is surer, or nothing differs and the stored one stays.
REASONS = ("none", "only", "rank", "confidence", "tie")


def decide(own: Column, other: Column) -> Column:
    """struct(won, why) of a stored field and a newly read one; the newcomer wins as in ``merge_from``."""
    mine, theirs = rank(own["source"]), rank(other["source"])
    sure, surer = own["confidence"], other["confidence"]
    side = lambda holds: F.when(holds, "new").otherwise("old")
    made = lambda won, why: F.struct(won.alias("won"), F.lit(why).alias("why"))
    return (
        F.when(~present(own) & ~present(other), made(F.lit("old"), "none"))
        .when(present(own) != present(other), made(side(present(other)), "only"))
        .when(mine != theirs, made(side(theirs > mine), "rank"))
        .when(sure != surer, made(side(surer > sure), "confidence"))
        .otherwise(made(F.lit("old"), "tie"))
    )


def merge_versions(stored: DataFrame, fresh: DataFrame, today: datetime.date) -> DataFrame:
    """The stored invoices that were read again, merged and checked, with decisions array<struct<field, won, why>> and changed.

    Items and kind only fill what is empty. changed: whether a field, an item, the kind or the issues differ from what is stored.
    Of several new readings of an id the one from the least source path counts.
    """
    first = fresh.groupBy("id").agg(F.min_by(F.struct(*[c for c in fresh.columns if c != "id"]), "source_path").alias("_new"))
    both = stored.join(first, "id")
    new = lambda n: F.col(f"_new.{n}")
    decisions = F.array(*[F.struct(F.lit(n).alias("field"), decide(F.col(n), new(n))["won"].alias("won"), decide(F.col(n), new(n))["why"].alias("why")) for n in MERGED_FIELDS])
    merged = {n: merge_from(F.col(n), new(n)) for n in MERGED_FIELDS}
    merged["items"] = F.when(F.coalesce(F.size("items"), F.lit(0)) > 0, F.col("items")).otherwise(new("items"))
    merged["kind"] = F.coalesce(F.col("kind"), new("kind"))
    before = F.struct(*[F.col(n) for n in (*MERGED_FIELDS, "items", "kind", "issues")])
    made = infer_and_check(both.withColumns({"decisions": decisions, "_was": before}).withColumns(merged), today)
    same = F.lit(True)
    for n in (*MERGED_FIELDS, "items", "kind", "issues"):
        same = same & F.col(n).eqNullSafe(F.col(f"_was.{n}"))
    return made.withColumn("changed", ~same).select(*INVOICE.fieldNames(), "decisions", "changed")
