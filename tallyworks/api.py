"""The ledger as one object: imports, lists, rules and reports over the tables of one store.

A write is a change set: it rewrites the buckets it touches and is there as a whole or not at all. One writer at a time. Methods that read return DataFrames; methods that write return what they did.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .operators import classify as C
from .operators import ingest as I
from .operators import ledger as L
from .operators import reports as R
from .operators import versions as V
from .operators.snapshot import materialize
from .operators.store import Store, deletes, meet, tasks, upserts
from .operators.validate import infer_and_check
from .functions.fields import merge_from
from .sinks import template, xlsx
from .sources import extract, files, replies


class Workspace:
    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], datetime.datetime] = datetime.datetime.now):
        self.spark, self.clock = spark, clock
        self.store = Store(spark, path)
        make = self.store.table
        self.invoices = make("invoices", schema.LEDGER, ["id"], children={"report_invoices": "invoice_id", "file_hashes": "id"})
        self.hashes = make("file_hashes", schema.FILE_HASH, ["file_hash"])
        self.bridge = make("report_invoices", schema.REPORT_INVOICE, ["report_id", "invoice_id"], "invoice_id")
        self.reports = make("reports", schema.REPORT, ["id"], buckets=4, children={"report_invoices": "report_id"})
        self.rules, self.settings = make("rules", schema.RULE, ["id"], buckets=1), make("settings", schema.SETTING, ["key"], buckets=4)
        self.ledger, self.rulebook, self.reporting = Ledger(self), Rules(self), Reports(self)

    def now(self) -> str:
        return self.clock().astimezone().isoformat()

    def today(self) -> datetime.date:
        return self.clock().date()

    def get_setting(self, key: str) -> str | None:
        row = self.settings.read().where(F.col("key") == key).first()
        return row["value"] if row else None

    def set_setting(self, key: str, value: str) -> None:
        self.settings.apply(upserts(self.spark.createDataFrame([(key, value)], schema.SETTING)))

    def get_preference(self, key: str) -> str | None:
        return self.get_setting(f"pref.{key}")

    def set_preference(self, key: str, value: str) -> None:
        self.set_setting(f"pref.{key}", value)


    def get_ai_settings(self) -> dict:
        """Stored settings of the optional model; anything unreadable counts as switched off."""
        try:
            found = json.loads(self.get_setting("ai") or "{}")
        except ValueError:
            found = {}
        return {"vision_enabled": False, "suggest_enabled": False, **(found if isinstance(found, dict) else {})}

    def set_ai_settings(self, settings: dict) -> None:
        self.set_setting("ai", json.dumps(settings, ensure_ascii=False))


class Ledger:
    def __init__(self, ws: Workspace):
        self.ws = ws

    def rows(self) -> DataFrame:
        return self.ws.invoices.read()

    def list(self, by: L.Filter | None = None) -> DataFrame:
        return L.list_rows(self.rows(), by, self.ws.bridge.read())

    def totals(self, by: L.Filter | None = None) -> DataFrame:
        return L.totals_by_category(self.rows(), by, self.ws.bridge.read())

    def counts(self) -> DataFrame:
        return L.sidebar_counts(self.rows())

    def get(self, id_: int) -> DataFrame:
        return self.rows().where(F.col("id") == id_).select(*schema.INVOICE.fieldNames())

    def save(self, invoices: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """Adds invoices whose file hash is new; (file_hash, id, inserted) of every one. Of equal hashes the first path counts.

        Known hashes lie in a table of their own, in buckets by hash, so only the buckets of the given hashes are read.
        batch: the name of a stream and the number of its batch, which is added once however often it comes.
        """
        names = schema.INVOICE.fieldNames()
        fresh = materialize(invoices.select(*names).withColumn("_row", F.monotonically_increasing_id()))
        # rows are chosen and numbered by their keys alone; whole rows move when that is done
        first = materialize(fresh.groupBy("file_hash").agg(F.min(F.struct(F.col("source_path").isNull(), "source_path", "_row")).alias("f")).select("file_hash", "f.source_path", "f._row"))
        known = materialize(self.ws.hashes.read_keys(first))
        new = meet(first, known.select("file_hash"), "file_hash", "left_anti", first.count())
        start = self.ws.invoices.last_id
        numbered = materialize(L.next_ids(new, start, ["source_path", "file_hash"]).select("_row", "id", "file_hash"))
        added = numbered.count()
        if added or batch:
            chosen = meet(fresh.drop("id"), numbered.select("_row", "id"), "_row", "inner", added, tasks(fresh.count(), schema.INVOICE))
            rows = L.project(chosen.select(*names), F.lit(self.ws.now()))
            self.ws.store.apply({"invoices": upserts(rows), "file_hashes": upserts(numbered.select("file_hash", "id"))}, {"invoices": start + added}, batch)
        ids = known.select("file_hash", "id", F.lit(False).alias("inserted")).unionByName(numbered.select("file_hash", "id", F.lit(True).alias("inserted")))
        return ids.where("file_hash is not null")

    def import_files(self, found: DataFrame, today: datetime.date | None = None, qr: extract.QrDecoder | None = None, reply_fn=None) -> DataFrame:
        """(path, content) rows in, (name, status, invoice_id, trace, vision_would_help) out; everything is stored, failures too."""
        today = today or self.ws.today()
        rows = materialize(extract.extract(files.expand_archives(found), today, qr))
        if reply_fn is not None:
            rows = self._with_replies(rows, reply_fn, today)
        rows = C.classify(rows, self.ws.rules.read(), "source_path")
        saved = self.save(rows)
        status = I.file_status(~F.col("inserted"))
        return meet(rows, saved.withColumnRenamed("id", "invoice_id"), "file_hash", "inner", saved.count()).select(
            F.col("source_path").alias("name"), status.alias("status"), "invoice_id", "trace", (F.col("has_image") & F.lit(reply_fn is None)).alias("vision_would_help")
        )

    def _with_replies(self, rows: DataFrame, reply_fn, today: datetime.date) -> DataFrame:
        """Asks the hook about rows that an image could complete; it gets the path."""
        asked = replies.ask(rows.where("has_image"), "source_path", reply_fn, "_reply")
        done = infer_and_check(replies.apply_vision(asked, "_reply"), today).select(*rows.columns)
        return materialize(rows.where("not has_image").unionByName(done))

    def import_folder(self, paths: str | list[str], **kw) -> DataFrame:
        return self.import_files(files.read_files(self.ws.spark, paths), **kw)

    def update(self, invoices: DataFrame, reviewed: bool) -> None:
        """Rewrites invoices by id; hash, path and time of import stay."""
        names = schema.INVOICE.fieldNames()
        invoices = materialize(invoices)
        kept = self.ws.invoices.read_keys(invoices).select("id", "file_hash", "source_path", "imported_at")
        changed = meet(invoices.select(*[n for n in names if n not in ("file_hash", "source_path")]), kept, "id", "inner", invoices.count())
        flat = L.project(changed.select(*names, "imported_at"), F.col("imported_at"), F.lit(reviewed))
        self.ws.invoices.apply(upserts(flat))

    def save_edit(self, invoices: DataFrame) -> None:
        """Edited invoices: amounts derived, checked, stored as reviewed."""
        self.update(infer_and_check(invoices, self.ws.today()), True)

    def delete(self, id_: int) -> None:
        """The invoice goes, and its lines on reports with it."""
        self.ws.invoices.apply(deletes(self.ws.spark.createDataFrame([(id_,)], "id bigint")))

    def set_category(self, id_: int, category: str) -> None:
        self.update(L.set_category(self.get(id_), id_, category), True)

    def reclassify_all(self) -> int:
        """Applies the rules to all but manual categories; how many rows changed."""
        own = self.rows()
        changed = materialize(C.reclassify(own, self.ws.rules.read()).where("changed"))
        n = changed.count()
        if n:
            flat = L.project(changed.select(*own.columns), F.col("imported_at"), F.col("reviewed"))
            self.ws.invoices.apply(upserts(flat.select(*own.columns)))
        return n

    def rescan(self, id_: int, found: DataFrame, qr: extract.QrDecoder | None = None) -> None:
        """Reads an invoice's file again under what is stored: only better readings replace fields, and the row wants review."""
        old = self.get(id_)
        fresh = extract.extract(found.limit(1), self.ws.today(), qr).select(*[F.col(n).alias(f"_{n}") for n in schema.INVOICE.fieldNames()])
        both = old.join(fresh, F.lit(True))  # one row and one row
        merged = {n: merge_from(F.col(n), F.col(f"_{n}")) for n in schema.MERGED_FIELDS}
        merged["items"] = F.when(F.coalesce(F.size("items"), F.lit(0)) > 0, F.col("items")).otherwise(F.col("_items"))
        merged["kind"] = F.coalesce("kind", "_kind")
        self.update(infer_and_check(both.withColumns(merged), self.ws.today()).select(*schema.INVOICE.fieldNames()), False)

    def rescan_all(self, found: DataFrame, qr: extract.QrDecoder | None = None) -> DataFrame:
        """Reads the files of many stored invoices again; (id, decisions, changed) of each. What changed wants review, in one commit."""
        fresh = extract.extract(found, self.ws.today(), qr).drop("id")
        ids = self.rows().select("id", "source_path")
        read = materialize(meet(fresh, ids, "source_path", "inner", ids.count()).select(*schema.INVOICE.fieldNames()))
        stored = self.ws.invoices.read_keys(read).select(*schema.INVOICE.fieldNames())
        merged = materialize(V.merge_versions(stored, read, self.ws.today()))
        self.update(merged.where("changed").select(*schema.INVOICE.fieldNames()), False)
        return merged.select("id", "decisions", "changed")

    def suggest_category(self, id_: int, reply_fn: Callable[[str], str]) -> dict:
        """A model's category for one invoice and the rule that would make it permanent; nothing is stored."""
        described = self.get(id_).withColumn("_d", replies.describe())
        answered = replies.ask(described.select("id", "_d"), "_d", reply_fn)
        known = [r[0] for r in C.rule_categories(self.ws.rules.read()).collect()]
        row = self.get(id_).join(answered, "id").select(replies.parse_suggestion(F.col("reply"), known).alias("s")).first()
        return row["s"].asDict(True)


class Rules:
    def __init__(self, ws: Workspace):
        self.ws = ws

    def list(self) -> DataFrame:
        return C.ordered(self.ws.rules.read())

    def _add(self, rules: DataFrame) -> int:
        """Appends rules under new ids; how many. A rule set is written by people, so it is numbered on the driver."""
        table, start = self.ws.rules, self.ws.rules.last_id
        rows = [{**r.asDict(True), "id": start + k} for k, r in enumerate(rules.collect(), 1)]
        if rows:
            table.apply(upserts(self.ws.spark.createDataFrame(rows, schema.RULE)), start + len(rows))
        return len(rows)

    def save(self, rule: dict) -> int:
        """Inserts a rule without an id, else replaces the one that has it; the id."""
        table = self.ws.rules
        if rule.get("id") is None:
            self._add(self.ws.spark.createDataFrame([{**rule, "id": None}], schema.RULE))
            return table.last_id
        table.apply(upserts(self.ws.spark.createDataFrame([rule], schema.RULE)))
        return rule["id"]

    def delete(self, id_: int) -> None:
        self.ws.rules.apply(deletes(self.ws.spark.createDataFrame([(id_,)], "id bigint")))

    def seed_if_empty(self) -> int:
        return self._add(C.seed_rules(self.ws.spark)) if self.ws.rules.read().isEmpty() else 0

    def restore_defaults(self) -> int:
        """Adds the built-in rules of which no equal category and conditions are left."""
        gone = C.missing_defaults(C.seed_rules(self.ws.spark), self.ws.rules.read())
        order = {(c, p, f): k for k, (c, p, f, _) in enumerate(C.SEEDS)}
        rows = sorted((r.asDict(True) for r in gone.collect()), key=lambda r: order[r["category"], r["priority"], r["conditions"][0]["field"]])
        return self._add(self.ws.spark.createDataFrame(rows, schema.RULE)) if rows else 0

    def categories(self) -> DataFrame:
        return C.rule_categories(self.ws.rules.read())

    def export_json(self, path: str | None = None) -> str:
        """All rules as JSON text, written to a local file if one is named."""
        text = json.dumps([r.asDict(True) for r in self.list().collect()], ensure_ascii=False, indent=2)
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
        return text

    def import_json(self, text: str) -> int:
        """Adds the rules of a JSON text under new ids; how many. Conditions that can't be read never match."""
        rows = []
        for r in json.loads(text):
            conditions = r.get("conditions")
            usable = isinstance(conditions, list) and all(isinstance(c, dict) and isinstance(c.get("keywords"), list) for c in conditions)
            rows.append(
                {
                    "id": None,
                    "name": r.get("name", ""),
                    "category": r.get("category", ""),
                    "priority": int(r.get("priority", 0)),
                    "enabled": bool(r.get("enabled", True)),
                    "conditions": [{"field": c.get("field"), "keywords": c["keywords"]} for c in conditions] if usable else [],
                }
            )
        return self._add(self.ws.spark.createDataFrame(rows, schema.RULE)) if rows else 0

    def import_file(self, path: str) -> int:
        return self.import_json("\n".join(r["value"] for r in self.ws.spark.read.text(path, wholetext=True).collect()))


class Reports:
    def __init__(self, ws: Workspace):
        self.ws = ws

    def list(self) -> DataFrame:
        return R.list_reports(self.ws.reports.read(), self.ws.bridge.read(), self.ws.invoices.read())

    def save(self, report: dict) -> int:
        """Inserts a report (created now) or replaces all but its time of creation; the id."""
        table = self.ws.reports
        own, id_ = table.read(), report.get("id")
        old = own.where(F.col("id") == id_).first() if id_ is not None else None
        if id_ is None:
            id_ = table.last_id + 1
        row = {**{n: report.get(n, "") for n in ("title", "applicant", "department", "note")}, "id": id_, "created_at": old["created_at"] if old else self.ws.now()}
        table.apply(upserts(self.ws.spark.createDataFrame([row], schema.REPORT)), max(table.last_id, id_))
        return id_

    def delete(self, id_: int) -> None:
        """The report goes with its lines, its invoices stay."""
        self.ws.reports.apply(deletes(self.ws.spark.createDataFrame([(id_,)], "id bigint")))

    def set_invoices(self, id_: int, invoice_ids: list[int]) -> None:
        old = deletes(self.ws.bridge.read().where(F.col("report_id") == id_).select("report_id", "invoice_id"))
        fresh = R.first_positions(self.ws.spark.createDataFrame([(id_, invoice_ids)], "report_id bigint, ids array<bigint>"))
        self.ws.bridge.apply(old.unionByName(upserts(fresh, 1), allowMissingColumns=True))

    def remove_invoice(self, id_: int, invoice_id: int) -> None:
        own = self.ws.bridge.read().where(F.col("report_id") == id_)
        left = upserts(R.remove_from_report(own, id_, invoice_id), 1)
        self.ws.bridge.apply(deletes(own.select("report_id", "invoice_id")).unionByName(left, allowMissingColumns=True))

    def invoices(self, id_: int) -> DataFrame:
        return R.report_invoices(self.ws.bridge.read(), self.ws.invoices.read(), id_)

    def preview(self, id_: int) -> dict:
        return R.preview(self.invoices(id_), self.ws.invoices.read())

    def new(self, title: str) -> int:
        """A new report that takes applicant and department from the newest."""
        return self.save(R.new_report(self.ws.reports.read(), title))

    def export(self, id_: int, meta: xlsx.ReportMeta, out: str | BinaryIO) -> None:
        xlsx.workbook(self.invoices(id_), meta, out)

    def export_with_template(self, id_: int, content: bytes, meta: xlsx.ReportMeta, out: str | BinaryIO) -> template.FillReport:
        return template.fill(content, self.invoices(id_), meta, out)

    @staticmethod
    def placeholders() -> list[tuple[str, str]]:
        return list(template.PLACEHOLDERS)

    def date(self, id_: int) -> str | None:
        return self.ws.get_preference(f"report.{id_}.date")

    def set_date(self, id_: int, date: str) -> None:
        self.ws.set_preference(f"report.{id_}.date", date)
