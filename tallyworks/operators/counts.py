"""Counts kept up to date: what a change set adds and takes away, instead of counting the ledger again.

Every changed row counts once as it was (-1) and once as it is (+1). The sums of those go to small tables beside
the ledger, in the same commit: rows per duplicate key, totals per category, sums per report and the side bar. Only the
buckets of touched keys are read, so the work follows the change, not the ledger. A key's rows become
duplicates when the second comes and stop being so when one is left, which the difference of its counts says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import COUNT_BAR as BAR
from ..schema import COUNT_CATEGORIES as CATEGORIES
from ..schema import COUNT_KEYS as KEYS
from ..schema import COUNT_REPORTS as REPORTS
from .ledger import stored_needs_review
from .snapshot import materialize
from .store import BucketTable, Manifest, Store, deletes, meet, upserts


class Counts:
    """The counts of a store's invoices and report lines; made before the first change, it follows every one."""

    def __init__(self, store: Store, invoices: str = "invoices", lines: str = "report_invoices"):
        self.store, self.invoices, self.lines = store, store.tables[invoices], store.tables.get(lines)
        self.keys = store.table("count_keys", KEYS, ["dedup_key"])
        self.categories = store.table("count_categories", CATEGORIES, ["category_s"], buckets=1)
        self.reports = store.table("count_reports", REPORTS, ["report_id"])
        self.bar = store.table("count_bar", BAR, ["name"], buckets=1)
        store.derived.append(self._derive)

    def sidebar(self) -> DataFrame:
        """One row: all, review, duplicates, total_cents, as ``ledger.sidebar_counts``."""
        own = self.bar.read()
        return own.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("n", "all"), ("review", "review"), ("duplicates", "duplicates"), ("total_cents", "total_cents"))])

    def _derive(self, was: Manifest, now: Manifest, latest: dict[str, DataFrame]) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        changed = latest.get(self.invoices.name)
        if changed is not None:
            own = changed.select("id", "bucket")
            columns = ["dedup_key", "category_s", "total_cents", "tax_cents", stored_needs_review().cast("int").alias("review")]
            rows = lambda df, sign: df.select(*columns, F.lit(sign).alias("sign"))
            signed = materialize(rows(self.invoices.read_keys(own, was), -1).unionAll(rows(changed.where("_op = 'upsert'"), 1)))
            times = lambda c: F.coalesce(F.sum(F.col("sign") * F.col(c)), F.lit(0)).cast("long")
            n = F.sum("sign").cast("long").alias("n")
            keys = materialize(_merged(self.keys, signed.where("dedup_key <> ''").groupBy("dedup_key").agg(n), was))
            out[self.keys.name] = _changes(keys, KEYS)
            out[self.categories.name] = _changes(_merged(self.categories, signed.groupBy("category_s").agg(n, times("total_cents").alias("total_cents"), times("tax_cents").alias("tax_cents")), was), CATEGORIES)
            # how many rows of a key have company
            company = lambda c: F.when(F.col(c) > 1, F.col(c)).otherwise(0)
            shared = keys.agg(F.coalesce(F.sum(company("n") - company("_old_n")), F.lit(0)).cast("long").alias("duplicates"))
            more = signed.agg(F.coalesce(n, F.lit(0)).alias("n"), times("review").alias("review"), times("total_cents").alias("total_cents"))
            bar = more.join(shared, F.lit(True)).withColumn("name", F.lit("all"))  # one row and one row
            out[self.bar.name] = upserts(_merged(self.bar, bar, was).select(*BAR.names))
        if self.lines is not None:
            touched = [df.select(F.col(c).alias("invoice_id")) for name, c in ((self.invoices.name, "id"), (self.lines.name, "invoice_id")) if (df := latest.get(name)) is not None]
            if touched:
                own = touched[0] if len(touched) == 1 else touched[0].unionAll(touched[1])
                own = materialize(own.distinct())
                most = own.count()

                def lines(m: Manifest, sign: int) -> DataFrame:
                    totals = self.invoices.read_keys(own.select(F.col("invoice_id").alias("id")), m).select(F.col("id").alias("invoice_id"), "total_cents")
                    return meet(self.lines.read_keys(own, m), totals, "invoice_id", "left", most).select("report_id", "total_cents", F.lit(sign).alias("sign"))

                sums = lines(was, -1).unionAll(lines(now, 1)).groupBy("report_id").agg(F.sum("sign").cast("long").alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("total_cents")), F.lit(0)).alias("total_cents"))
                out[self.reports.name] = _changes(_merged(self.reports, sums, was), REPORTS)
        return out


def _merged(table: BucketTable, delta: DataFrame, was: Manifest) -> DataFrame:
    """The rows of the delta's keys after it: each number is the old one and the difference; the old counts as _old_n."""
    key = table.keys[0]
    delta = materialize(delta)
    old = table.read_keys(delta, was)
    numbers = [c for c in table.schema.names if c != key]

    def both(c: str) -> Column:
        return (F.coalesce(old[c], F.lit(0)) + F.coalesce(delta[c], F.lit(0))).cast("long").alias(c)

    return meet(delta, old, delta[key] == old[key], "left", delta.count()).select(delta[key], *map(both, numbers), F.coalesce(old["n"], F.lit(0)).alias("_old_n"))


def _changes(rows: DataFrame, schema: StructType) -> DataFrame:
    """Rows that count nothing any more go."""
    own = rows.select(*schema.names)
    return upserts(own.where("n > 0")).unionByName(deletes(own.where("n <= 0")))
