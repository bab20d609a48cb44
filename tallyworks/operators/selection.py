"""Selections as sets of ids, and category names as sets of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import UNCATEGORISED


def category_names(rules: DataFrame, rows: DataFrame) -> DataFrame:
    """Categories of rules and rows, without the blank and the uncategorised, in pinyin order."""
    both = rules.select("category").union(rows.select(F.col("category_s").alias("category"))).distinct()
    return both.where(~F.col("category").isin("", UNCATEGORISED)).orderBy(F.expr("category collate zh"))


def rule_category_names(rules: DataFrame) -> DataFrame:
    """Categories of rules and the uncategorised, in pinyin order."""
    pinned = rules.sparkSession.createDataFrame([(UNCATEGORISED,)], "category string")
    return rules.select("category").where("category <> ''").union(pinned).distinct().orderBy(F.expr("category collate zh"))


def visible(selected: DataFrame, rows: DataFrame) -> DataFrame:
    return selected.select("id").intersect(rows.select("id"))


def check_all(selected: DataFrame, rows: DataFrame) -> DataFrame:
    return selected.select("id").union(rows.select("id")).distinct()


def uncheck_all(selected: DataFrame, rows: DataFrame) -> DataFrame:
    return selected.select("id").distinct().join(rows.select("id"), "id", "left_anti")


def toggle(selected: DataFrame, ids: DataFrame) -> DataFrame:
    """Symmetric difference."""
    a, b = selected.select("id").distinct(), ids.select("id").distinct()
    return a.join(b, "id", "left_anti").union(b.join(a, "id", "left_anti"))


def add_range(selected: DataFrame, rows: DataFrame, anchor: int, to: int, order: list) -> DataFrame:
    """Selection and every row between two ids in the list's order; without the anchor only the clicked row.

    Both ends are looked up by their sort keys and the range is a filter, so the list isn't numbered in one task.
    """
    ends = rows.where(F.col("id").isin(anchor, to)).select("id", *order)
    both = ends.collect()
    if {anchor, to} - {r["id"] for r in both}:
        return check_all(selected, rows.where(F.col("id") == to))
    keys = sorted(tuple(r[c] for c in order) for r in both)
    struct = F.struct(*order)
    bound = lambda k: F.struct(*[F.lit(v).alias(c) for v, c in zip(k, order, strict=True)])
    return check_all(selected, rows.where((struct >= bound(keys[0])) & (struct <= bound(keys[-1]))))


def append_picked(picked: list[int], checked: list[int]) -> list[int]:
    """Ordered, each id once."""
    return list(dict.fromkeys([*picked, *checked]))


def selected_total(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: total_cents of the selected rows."""
    return rows.join(selected.select("id").distinct(), "id", "left_semi").agg(F.coalesce(F.sum("total_cents"), F.lit(0)).alias("total_cents"))


def first_seen(values: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values in the order in which they first come."""
    return values.groupBy(value).agg(F.min(order).alias("_at")).orderBy("_at").drop("_at")


def newest(rows: DataFrame, by: str) -> DataFrame:
    return rows.orderBy(F.desc(by)).limit(1)


def top_per_group(rows: DataFrame, group: str, by: list) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*by))).where("_n = 1").drop("_n")
