"""Order as data: positions, pages and ordered lists, from ranges of rows and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .snapshot import materialize


def positions(rows: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "position") -> DataFrame:
    """rows with their place, gapless from 0, in a total order (of each group, if groups are given).

    Rows are ranged over partitions by group and order and numbered within them; a partition's first place is a
    running sum of counts. So neither the table nor a hot group is ever sorted by one task. Equal rows keep no
    order among each other, so ``order`` should end in a key.
    """
    group = group or []
    ranged = rows.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id())
    cut = materialize(ranged)
    sizes = cut.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    # a row per group and partition that holds some of it: without groups no more than partitions
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_p")) - F.col("_n")
    starts = materialize(sizes.select(*group, "_p", before.alias("_start")))
    place = F.row_number().over(Window.partitionBy(*group, "_p").orderBy(*order))
    numbered = cut.withColumn("_k", place)
    same = F.lit(True)
    for g in [*group, "_p"]:
        same = same & numbered[g].eqNullSafe(starts[g])
    return numbered.join(starts, same).select(*[numbered[c] for c in rows.columns], (F.col("_start") + F.col("_k") - 1).cast("long").alias(name))


def list_order(key: str = "date", desc: bool = True) -> list[Column]:
    """The order of a list by date, seller (pinyin) or amount; ids break ties in the same direction."""
    by = {"date": F.col("issued_on_s"), "seller": F.expr("seller_s collate zh"), "amount": F.col("total_cents")}[key]
    return [c.desc() if desc else c.asc() for c in (by, F.col("id"))]


def pages(placed: DataFrame, size: int, columns: list[str], position: str = "position") -> DataFrame:
    """(page, rows, first_*, last_*) of rows with positions: the keys between which each page lies."""
    page = F.floor(F.col(position) / size).cast("long")
    ends = [f(c, position).alias(f"{n}_{c}") for c in columns for f, n in ((F.min_by, "first"), (F.max_by, "last"))]
    return placed.groupBy(page.alias("page")).agg(F.count(F.lit(1)).alias("rows"), *ends)


def page_after(rows: DataFrame, key: str, desc: bool, last: tuple | None, size: int) -> DataFrame:
    """The page of a list that follows the row with these values of (key, id); the first page without them.

    The place is found by comparing keys, so nothing before it is counted or sorted.
    """
    order = list_order(key, desc)
    if last is not None:
        by = {"date": F.col("issued_on_s"), "seller": F.expr("seller_s collate zh"), "amount": F.col("total_cents")}[key]
        at = F.expr("cast(null as string)") if last[0] is None else F.lit(last[0])
        at = F.expr(f"{_quoted(last[0])} collate zh") if key == "seller" else at
        beyond = (by < at) if desc else (by > at)
        next_id = (F.col("id") < last[1]) if desc else (F.col("id") > last[1])
        rows = rows.where(beyond | ((by == at) & next_id))
    return rows.orderBy(*order).limit(size)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def append_lines(bridge: DataFrame, added: DataFrame) -> DataFrame:
    """(report_id, invoice_id, position) of all reports after lines (report_id, invoice_id, at) are appended to them.

    The lines a report has come first, in their order, then the added ones by ``at``; an invoice that is there
    already, or comes twice, keeps its first place. Positions are gapless.
    """
    both = bridge.select("report_id", "invoice_id", F.lit(0).alias("_part"), F.col("position").cast("long").alias("_at")).unionByName(
        added.select("report_id", "invoice_id", F.lit(1).alias("_part"), F.col("at").cast("long").alias("_at"))
    )
    first = both.groupBy("report_id", "invoice_id").agg(F.min(F.struct("_part", "_at")).alias("_f")).select("report_id", "invoice_id", "_f._part", "_f._at")
    placed = positions(first, [F.col("_part").asc(), F.col("_at").asc(), F.col("invoice_id").asc()], ["report_id"])
    return placed.select("report_id", "invoice_id", F.col("position").cast("int").alias("position"))
