"""The ledger: flat columns, filtered lists, duplicates and totals."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import min_key_confidence
from ..functions.kinds import kind_label
from ..functions.text import like_ascii
from ..schema import NO_NUMBER, REVIEW_THRESHOLD, UNCATEGORISED

#: Most ids of a list of members.
CHUNK = 1_000
LIST_COLUMNS = [
    "id", "number_s", "issued_on_s", "kind_label", "seller_s", "total_cents", "tax_cents", "category_s", "category_rule_s",
    "min_confidence", "issue_count", "reviewed", "imported_at",
]


def dedup_key(code: Column, number: Column) -> Column:
    """code-number, empty without a number."""
    number = F.coalesce(number, F.lit(""))
    return F.when(number != "", F.concat(F.coalesce(code, F.lit("")), F.lit("-"), number)).otherwise("")


def project(invoices: DataFrame, imported_at: Column | None = None, reviewed: Column | None = None) -> DataFrame:
    """Invoice rows with the flat columns; a missing text is '', a missing amount 0."""
    text = lambda n: F.coalesce(F.col(f"{n}.value"), F.lit(""))
    cents = lambda n: F.coalesce(F.col(f"{n}.value"), F.lit(0)).cast("long")
    return invoices.withColumns(
        {
            "number_s": text("number"),
            "code_s": text("code"),
            "dedup_key": dedup_key(F.col("code.value"), F.col("number.value")),
            "issued_on_s": text("issued_on"),
            "kind_label": F.coalesce(kind_label(F.col("kind")), F.lit("")),
            "seller_s": text("seller_name"),
            "buyer_s": text("buyer_name"),
            "total_cents": cents("total"),
            "tax_cents": cents("tax"),
            "category_s": F.coalesce("category", F.lit("")),
            "category_rule_s": F.coalesce("category_rule", F.lit("")),
            "min_confidence": min_key_confidence().cast("double"),
            "issue_count": F.coalesce(F.size("issues"), F.lit(0)).cast("long"),
            "reviewed": F.lit(False) if reviewed is None else reviewed,
            "imported_at": F.lit(None).cast("string") if imported_at is None else imported_at,
        }
    )


@dataclass(frozen=True)
class Filter:
    """Predicates of a list; None (and a blank search) constrains nothing, category '' means unclassified."""

    search: str | None = None
    category: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    needs_review_only: bool = False
    duplicates_only: bool = False
    exclude_report: int | None = None

    @classmethod
    def scope(cls, name: str, **parts) -> Filter:
        """The three lists of the side bar."""
        return cls(needs_review_only=name == "review", duplicates_only=name == "duplicates", **parts)

    def predicate(self) -> Column:
        """All that one row decides."""
        out = F.lit(True)
        if self.search and self.search.strip():
            needle = self.search.strip()
            out = out & (like_ascii(F.col("number_s"), needle) | like_ascii(F.col("seller_s"), needle) | like_ascii(F.col("buyer_s"), needle))
        if self.category is not None:
            out = out & (F.col("category_s") == self.category)
        if self.date_from:
            out = out & (F.col("issued_on_s") >= self.date_from)
        if self.date_to:
            out = out & (F.col("issued_on_s") <= self.date_to)
        if self.needs_review_only:
            out = out & stored_needs_review()
        return out


def stored_needs_review() -> Column:
    """The stored rule compares as double, so a float 0.9 counts as below 0.9."""
    return ~F.col("reviewed") & ((F.col("min_confidence") < F.lit(REVIEW_THRESHOLD)) | (F.col("issue_count") > 0))


def row_needs_review() -> Column:
    """The row's own rule compares as float, so 0.9 is enough."""
    near = F.col("min_confidence").cast("float") < F.lit(REVIEW_THRESHOLD).cast("float")
    return ~F.col("reviewed") & (near | (F.col("issue_count") > 0))


def row_is_duplicate() -> Column:
    return F.size("duplicate_of") > 0


def _of_rows(ledger: DataFrame, rows: DataFrame | None) -> DataFrame:
    """The rows of the ledger with a key, if rows are given with a key of theirs. Keys are made distinct first, so a hot one is looked up once."""
    keyed = ledger.where("dedup_key <> ''")
    if rows is None or rows is ledger:
        return keyed
    return keyed.join(rows.where("dedup_key <> ''").select("dedup_key").distinct(), "dedup_key", "left_semi")


def duplicate_keys(ledger: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(dedup_key, ids): keys that more than one row has (of the given rows' keys alone), with their sorted ids. Blank keys never pair up."""
    return (
        _of_rows(ledger, rows)
        .groupBy("dedup_key")
        .agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list("id")).alias("ids"))
        .where("_n > 1")
        .drop("_n")
    )


def with_duplicates(rows: DataFrame, ledger: DataFrame, narrow: bool = True) -> DataFrame:
    """rows with duplicate_of: the ids of the other rows of the whole ledger with the same non-blank key.

    narrow: rows are part of the ledger, so only their keys are gathered.
    """
    others = F.filter(F.coalesce("ids", F.array().cast("array<bigint>")), lambda i: i != F.col("id"))
    return rows.join(duplicate_keys(ledger, rows if narrow else None), "dedup_key", "left").withColumn("duplicate_of", others).drop("ids")


def with_duplicate_count(rows: DataFrame, ledger: DataFrame, narrow: bool = True) -> DataFrame:
    """rows with duplicate_count: how many other rows of the whole ledger share the key. Counts are pre-aggregated, so a hot key costs one row."""
    counts = _of_rows(ledger, rows if narrow else None).groupBy("dedup_key").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(counts, "dedup_key", "left").withColumn("duplicate_count", F.coalesce(F.col("_n") - 1, F.lit(0))).drop("_n")


def duplicate_members(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """(dedup_key, id): membership of the shared keys of rows in the whole ledger, one row each instead of a list at every member."""
    return is_duplicate(_of_rows(ledger, rows), ledger).select("dedup_key", "id")


def duplicate_chunks(rows: DataFrame, ledger: DataFrame, size: int = CHUNK) -> DataFrame:
    """(dedup_key, chunk, ids): the members of the rows' shared keys in lists of at most ``size`` sorted ids.

    Members are numbered within their key by ranges and running counts, so a key that a third of the ledger
    shares is dealt over tasks and no list outgrows its bound.
    """
    from .ordering import positions

    placed = positions(duplicate_members(rows, ledger), [F.col("id").asc()], ["dedup_key"])
    chunk = F.floor(F.col("position") / size).cast("long")
    return placed.groupBy("dedup_key", chunk.alias("chunk")).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def duplicate_page(rows: DataFrame, chunks: DataFrame, chunk: int = 0) -> DataFrame:
    """(id, ids): of each duplicate row one list of its key's members, itself left out; further ones by their number."""
    page = chunks.where(F.col("chunk") == chunk).select("dedup_key", "ids")
    return rows.join(page, "dedup_key").select("id", F.filter("ids", lambda i: i != F.col("id")).alias("ids"))


def is_duplicate(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """The rows that another row of the ledger shares a key with: keys are counted, so nothing is paired."""
    twice = ledger.where("dedup_key <> ''").groupBy("dedup_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("dedup_key")
    return rows.join(twice, "dedup_key", "left_semi")


def filtered(ledger: DataFrame, by: Filter, bridge: DataFrame | None = None) -> DataFrame:
    """The rows that a filter keeps; lists and totals both start here."""
    rows = ledger.where(by.predicate())
    if by.duplicates_only:
        rows = is_duplicate(rows, ledger)
    if by.exclude_report is not None:
        if bridge is None:
            raise ValueError("exclude_report needs the report's invoices")
        taken = bridge.where(F.col("report_id") == by.exclude_report).select(F.col("invoice_id").alias("id"))
        rows = rows.join(taken, "id", "left_anti")
    return rows


def list_rows(ledger: DataFrame, by: Filter | None = None, bridge: DataFrame | None = None, ids: bool = True) -> DataFrame:
    """The list, newest first and by id within a day, with duplicates looked up in the whole ledger.

    duplicate_of lists the others' ids, so it grows with the square of a key's rows; ids=False gives their
    number as duplicate_count instead, and ``duplicate_members`` the ids as a table.
    """
    by = by or Filter()
    narrow = replace(by, duplicates_only=False) != Filter()
    rows = (with_duplicates if ids else with_duplicate_count)(filtered(ledger, by, bridge), ledger, narrow)
    last = "duplicate_of" if ids else "duplicate_count"
    return rows.select(*[c for c in LIST_COLUMNS if c in rows.columns], last).orderBy(F.desc("issued_on_s"), F.desc("id"))


def category_label(category: Column) -> Column:
    return F.when(category == "", UNCATEGORISED).otherwise(category)


def totals_by_category(ledger: DataFrame, by: Filter | None = None, bridge: DataFrame | None = None) -> DataFrame:
    """count, total and tax of each category over the same rows as the list; largest total first, ties as first seen in the list."""
    rows = filtered(ledger, by or Filter(), bridge)
    return (
        rows.groupBy(category_label(F.col("category_s")).alias("category"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.sum("total_cents").alias("total_cents"),
            F.sum("tax_cents").alias("tax_cents"),
            F.max(F.struct("issued_on_s", "id")).alias("_first"),
        )
        .orderBy(F.desc("total_cents"), F.desc("_first"))
        .drop("_first")
    )


def sidebar_counts(ledger: DataFrame) -> DataFrame:
    """One row: all, review, duplicates, total_cents. Keys are pre-aggregated, so one pass and one shuffle of counts."""
    per_key = ledger.groupBy("dedup_key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(stored_needs_review()).alias("review"), F.sum("total_cents").alias("total_cents")
    )
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("all"),
        F.coalesce(F.sum("review"), F.lit(0)).alias("review"),
        F.coalesce(F.sum(F.when((F.col("dedup_key") != "") & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("total_cents"), F.lit(0)).alias("total_cents"),
    )


def status_bar(totals: DataFrame) -> DataFrame:
    """One row over category totals: count, total_cents, tax_cents, uncategorised."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return totals.agg(
        zero("count").alias("count"),
        zero("total_cents").alias("total_cents"),
        zero("tax_cents").alias("tax_cents"),
        zero(F.when(F.col("category") == UNCATEGORISED, F.col("count")).otherwise(0)).alias("uncategorised"),
    )


def sort_rows(rows: DataFrame, key: str = "date", desc: bool = True) -> DataFrame:
    """By date, seller (pinyin) or amount; ids break ties in the same direction."""
    by = {"date": F.col("issued_on_s"), "seller": F.expr("seller_s collate zh"), "amount": F.col("total_cents")}[key]
    return rows.orderBy(*(c.desc() if desc else c.asc() for c in (by, F.col("id"))))


def toggle_sort(current: tuple[str, bool], clicked: str) -> tuple[str, bool]:
    """The same column flips, another starts descending."""
    return (clicked, not current[1]) if clicked == current[0] else (clicked, True)


def amount_excl_tax() -> Column:
    return F.col("total_cents") - F.col("tax_cents")


def duplicate_lookup(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, twin_id and the twin's list columns) of every duplicate of the rows."""
    twins = ledger.select(*[F.col(c).alias(f"twin_{c}") for c in ("id", "number_s", "issued_on_s", "seller_s", "total_cents")])
    return rows.select("id", F.explode("duplicate_of").alias("twin_id")).join(twins, "twin_id")


def twins(id_: Column, duplicate_of: Column) -> Column:
    return F.array_union(F.array(id_), duplicate_of)


def picked_rows(rows: DataFrame) -> DataFrame:
    """List rows, with ids or numbers of their duplicates, as the report builder shows them."""
    duplicate = row_is_duplicate() if "duplicate_of" in rows.columns else F.col("duplicate_count") > 0
    return rows.select(
        "id",
        F.coalesce(F.expr("nullif(number_s, '')"), F.lit(NO_NUMBER)).alias("number"),
        F.col("issued_on_s").alias("issued_on"),
        F.col("kind_label").alias("kind"),
        F.col("seller_s").alias("seller"),
        category_label(F.col("category_s")).alias("category"),
        "total_cents",
        "issue_count",
        duplicate.alias("duplicate"),
    )


def picked_invoices(invoices: DataFrame) -> DataFrame:
    """Invoices of a report as the report builder shows them."""
    v = lambda n, d: F.coalesce(F.col(f"{n}.value"), F.lit(d))
    return invoices.select(
        F.coalesce("id", F.lit(-1)).alias("id"),
        v("number", NO_NUMBER).alias("number"),
        v("issued_on", "").alias("issued_on"),
        F.coalesce(kind_label(F.col("kind")), F.lit("")).alias("kind"),
        v("seller_name", "").alias("seller"),
        category_label(F.coalesce("category", F.lit(""))).alias("category"),
        v("total", 0).cast("long").alias("total_cents"),
        F.size("issues").cast("long").alias("issue_count"),
        F.lit(False).alias("duplicate"),
    )


def set_category(invoices: DataFrame, id_: int, category: str) -> DataFrame:
    """Invoices with one category set by hand: its rule goes and the row counts as reviewed."""
    own = F.col("id") == id_
    out = invoices.withColumns(
        {
            "category": F.when(own, F.lit(category)).otherwise(F.col("category")),
            "category_rule": F.when(own, F.lit(None).cast("string")).otherwise(F.col("category_rule")),
        }
    )
    return out.withColumn("reviewed", own | F.col("reviewed")) if "reviewed" in out.columns else out


def next_ids(fresh: DataFrame, start: int, order: list[str]) -> DataFrame:
    """fresh with id start+1.., in order. Rows are ranged over partitions and numbered from their counts, never in one task."""
    ranged = fresh.repartitionByRange(*order) if order else fresh
    marked = ranged.withColumn("_p", F.spark_partition_id())
    from .snapshot import materialize

    cut = materialize(marked)
    sizes = cut.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: bounded by the number of partitions
    starts = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n") + F.lit(start)).alias("_start"))
    numbered = cut.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return numbered.join(F.broadcast(starts), "_p").withColumn("id", (F.col("_start") + F.col("_k")).cast("long")).drop("_p", "_k", "_start")
