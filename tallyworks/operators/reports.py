"""Reports: bridge, summary, preview and row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import is_deductible
from ..functions.money import capital, share_of
from ..functions.prose import issue_message
from ..schema import NO_NUMBER, UNCATEGORISED
from .ledger import with_duplicate_count


def report_invoices(bridge: DataFrame, invoices: DataFrame, report_id: int) -> DataFrame:
    """The invoices of a report in its order, with position."""
    own = bridge.where(F.col("report_id") == report_id).select(F.col("invoice_id").alias("id"), "position")
    return invoices.join(own, "id").orderBy("position", "id")


def list_reports(reports: DataFrame, bridge: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every report with invoice_count and total_cents, newest first; reports without invoices stay. The bridge is summed before it meets the reports."""
    sums = (
        bridge.join(ledger.select(F.col("id").alias("invoice_id"), "total_cents"), "invoice_id", "left")
        .groupBy(F.col("report_id").alias("id"))
        .agg(F.count("invoice_id").alias("invoice_count"), F.coalesce(F.sum("total_cents"), F.lit(0)).alias("total_cents"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return reports.join(sums, "id", "left").select(*reports.columns, zero("invoice_count"), zero("total_cents")).orderBy(F.desc("created_at"))


def set_report_invoices(bridge: DataFrame, report_id: int, ids: list[int]) -> DataFrame:
    """The bridge with a report's list rewritten: position is the index, the first occurrence of an id counts."""
    spark = bridge.sparkSession
    listed = spark.createDataFrame([(report_id, i, k) for k, i in enumerate(ids)], "report_id bigint, invoice_id bigint, position int")
    fresh = listed.groupBy("report_id", "invoice_id").agg(F.min("position").alias("position"))
    return bridge.where(F.col("report_id") != report_id).unionByName(fresh)


def first_positions(listed: DataFrame) -> DataFrame:
    """(report_id, invoice_id, position) of lists given as (report_id, ids array), the first occurrence of an id counts."""
    return listed.select("report_id", F.posexplode("ids").alias("position", "invoice_id")).groupBy("report_id", "invoice_id").agg(F.min("position").alias("position"))


def _amounts() -> dict[str, Column]:
    total, tax = F.coalesce(F.col("total.value"), F.lit(0)), F.coalesce(F.col("tax.value"), F.lit(0))
    return {"_total": total, "_tax": tax, "_net": F.coalesce(F.col("amount_excl_tax.value"), total - tax)}


def _category() -> Column:
    return F.coalesce(F.expr("nullif(category, '')"), F.lit(UNCATEGORISED))


def summary(invoices: DataFrame) -> DataFrame:
    """The grand total (category null, is_total true) and a row per category, largest total first, then by name: one rollup."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return (
        invoices.withColumns({**_amounts(), "_cat": _category(), "_deductible": F.when(is_deductible(F.col("kind")), F.coalesce(F.col("tax.value"), F.lit(0))).otherwise(0)})
        .rollup("_cat")
        .agg(
            F.count(F.lit(1)).alias("count"),
            zero("_net").alias("amount_excl_tax_cents"),
            zero("_tax").alias("tax_cents"),
            zero("_total").alias("total_cents"),
            zero("_deductible").alias("deductible_tax_cents"),
            (F.grouping("_cat") == 1).alias("is_total"),
        )
        .withColumnRenamed("_cat", "category")
        .orderBy(F.desc("is_total"), F.desc("total_cents"), "category")
    )


def with_share(rows: DataFrame) -> DataFrame:
    """Summary rows (one per category, so few) with share of the grand total; 0 where that is 0."""
    whole = F.max(F.when(F.col("is_total"), F.col("total_cents"))).over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("share", share_of(F.col("total_cents"), whole))


def warnings(invoices: DataFrame) -> DataFrame:
    """(id, number, message) of every issue; the order of issues is kept in at."""
    return invoices.select(
        "id", F.coalesce(F.col("number.value"), F.lit(NO_NUMBER)).alias("number"), F.posexplode("issues").alias("at", "issue")
    ).select("id", "number", "at", issue_message(F.col("issue")).alias("message"))


def duplicates_of_report(invoices: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, number) of the report's invoices that have a duplicate anywhere in the ledger."""
    own = ledger.join(invoices.select("id"), "id", "left_semi")
    return with_duplicate_count(own, ledger).where("duplicate_count > 0").select("id", F.col("number_s").alias("number"))


def preview(invoices: DataFrame, ledger: DataFrame) -> dict:
    """Totals, categories, warnings and duplicates of one report; bounded by the report, so gathered on the driver."""
    rows = [r.asDict() for r in summary(invoices).collect()]
    head = next((r for r in rows if r["is_total"]), None) or dict.fromkeys(
        ("count", "amount_excl_tax_cents", "tax_cents", "total_cents", "deductible_tax_cents"), 0
    )
    order = {r["id"]: k for k, r in enumerate(invoices.select("id").collect())}
    notes = sorted(warnings(invoices).collect(), key=lambda r: (order[r["id"]], r["at"]))
    twice = sorted(duplicates_of_report(invoices, ledger).collect(), key=lambda r: order[r["id"]])
    return {
        **{k: head[k] for k in ("count", "amount_excl_tax_cents", "tax_cents", "total_cents", "deductible_tax_cents")},
        "capital_amount": capital(head["total_cents"]),
        "by_category": [{k: r[k] for k in ("category", "count", "total_cents")} for r in rows if not r["is_total"]],
        "warnings": [(r["number"], r["message"]) for r in notes],
        "duplicates": [r["number"] for r in twice],
    }


def picked_duplicates(picked: DataFrame, numbers: DataFrame) -> DataFrame:
    """Picked rows whose number the preview names as a duplicate."""
    return picked.join(numbers.select("number").distinct(), "number", "left_semi")


def sort_by_date(rows: DataFrame, position: str = "position") -> DataFrame:
    """Oldest first, undated rows last, otherwise as they stood."""
    return rows.orderBy(F.col("issued_on") == "", "issued_on", position)


def move_row(rows: DataFrame, index: int, delta: int, count: int, position: str = "position") -> DataFrame:
    """Rows with one moved from index by delta; what lies between shifts; nothing beyond either end."""
    target = index + delta
    if not (0 <= index < count and 0 <= target < count):
        return rows
    p = F.col(position)
    step = -1 if target > index else 1
    between = p.between(min(index, target), max(index, target))
    return rows.withColumn(position, F.when(p == index, F.lit(target)).when(between, p + step).otherwise(p))


def remove_from_report(bridge: DataFrame, report_id: int, invoice_id: int) -> DataFrame:
    """The bridge without one invoice of a report, positions closed up."""
    ids = [r["invoice_id"] for r in bridge.where(F.col("report_id") == report_id).orderBy("position").collect() if r["invoice_id"] != invoice_id]
    return set_report_invoices(bridge, report_id, ids)


def can_export(invoices: DataFrame) -> bool:
    return not invoices.isEmpty()


def new_report(reports: DataFrame, title: str) -> dict:
    """A report under a title, with applicant and department of the newest one."""
    last = reports.orderBy(F.desc("created_at")).limit(1).collect()
    return {"id": None, "title": title, "note": "", **{n: (last[0][n] if last else "") or "" for n in ("applicant", "department")}}


def computed_total(net: Column, tax: Column) -> Column:
    """Net and tax together, null unless both are there."""
    return net + tax
