"""One query per operator (or small group of them), each with the SQL that must give the same rows."""

from __future__ import annotations

import datetime
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..api import Workspace
from ..functions import dates, fields, kinds, money, prose, qr, text
from ..operators import classify, counts, ingest, ordering, reports, search, selection, validate, versions
from ..operators import ledger as L
from ..operators.snapshot import materialize, scratch
from ..operators.store import Store, deletes, upserts
from ..schema import FILE_KINDS, REPORT_INVOICE, UNCATEGORISED
from ..sources import files, replies
from ..streaming import progress
from . import adapter as A
from .adapter import BRIDGE, INVOICES, LEDGER, REPORTS, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TODAY = datetime.date(2024, 3, 15)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def joined(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


# --- lists -----------------------------------------------------------------------------------------

_LIST = "id, number_s, issued_on_s, kind_label, seller_s, total_cents, tax_cents, category_s, category_rule_s, min_confidence, issue_count, reviewed, imported_at"
_DUPES = "coalesce(array_to_string(list_sort(list_filter(ids, lambda i: i <> id)), ','), '') AS duplicate_of"
_KEYS = "keys AS (SELECT dedup_key, list(id) AS ids FROM ledger WHERE dedup_key <> '' GROUP BY dedup_key)"


def _listed(where: str) -> str:
    return f"WITH {LEDGER}, {_KEYS} SELECT {_LIST}, {_DUPES} FROM ledger LEFT JOIN keys USING (dedup_key) WHERE {where}"


def _list(spark: SparkSession, sf_dir: str, by: L.Filter) -> DataFrame:
    return L.list_rows(A.ledger(spark, sf_dir), by, A.bridge(spark, sf_dir)).withColumn("duplicate_of", joined(F.col("duplicate_of")))


@query(_listed("category_s = '住宿' AND issued_on_s >= '1996-01-01' AND issued_on_s <= '1997-12-31'"))
def list_filtered(spark, sf_dir):
    return _list(spark, sf_dir, L.Filter(category="住宿", date_from="1996-01-01", date_to="1997-12-31"))


@query(_listed("lower(seller_s) LIKE '%r#00000_12%' OR lower(buyer_s) LIKE '%r#00000_12%' OR lower(number_s) LIKE '%r#00000_12%'"))
def list_search(spark, sf_dir):
    return _list(spark, sf_dir, L.Filter(search="  R#00000_12 "))


@query(_listed("issued_on_s <= '1995-03-01'"))
def list_date_to_only(spark, sf_dir):
    return _list(spark, sf_dir, L.Filter(date_to="1995-03-01"))


@query(_listed("category_s = ''"))
def list_unclassified(spark, sf_dir):
    return _list(spark, sf_dir, L.Filter(category=""))


@query(_listed("NOT reviewed AND (min_confidence < 0.9::DOUBLE OR issue_count > 0)"))
def needs_review(spark, sf_dir):
    return _list(spark, sf_dir, L.Filter.scope("review"))


@query(_listed("dedup_key <> '' AND len(ids) > 1"))
def duplicates_list(spark, sf_dir):
    return _list(spark, sf_dir, L.Filter.scope("duplicates"))


@query(_listed(f"id NOT IN (SELECT invoice_id FROM bridge WHERE report_id = 3)").replace("WITH ", f"WITH {BRIDGE}, ", 1))
def exclude_report(spark, sf_dir):
    return _list(spark, sf_dir, L.Filter(exclude_report=3))


@query(
    f"""WITH {LEDGER} SELECT id, NOT reviewed AND (min_confidence::FLOAT < 0.9::FLOAT OR issue_count > 0) AS review_float,
    NOT reviewed AND (min_confidence < 0.9::DOUBLE OR issue_count > 0) AS review_double, total_cents - tax_cents AS net_cents,
    CASE WHEN category_s = '' THEN '{UNCATEGORISED}' ELSE category_s END AS category FROM ledger"""
)
def row_predicates(spark, sf_dir):
    return A.ledger(spark, sf_dir).select(
        "id",
        L.row_needs_review().alias("review_float"),
        L.stored_needs_review().alias("review_double"),
        L.amount_excl_tax().alias("net_cents"),
        L.category_label(F.col("category_s")).alias("category"),
    )


@query(
    f"""WITH {LEDGER}, {_KEYS}, pairs AS (SELECT id, unnest(list_filter(ids, lambda i: i <> id)) AS twin_id FROM ledger JOIN keys USING (dedup_key))
    SELECT p.id, p.twin_id, t.number_s AS twin_number_s, t.issued_on_s AS twin_issued_on_s, t.seller_s AS twin_seller_s, t.total_cents AS twin_total_cents
    FROM pairs p JOIN ledger t ON t.id = p.twin_id"""
)
def duplicate_lookup(spark, sf_dir):
    rows = A.ledger(spark, sf_dir)
    return L.duplicate_lookup(L.with_duplicates(rows, rows), rows)


@query(
    f"""WITH {LEDGER}, {_KEYS} SELECT id, number_s AS number, issued_on_s AS issued_on, kind_label AS kind, seller_s AS seller,
    CASE WHEN category_s = '' THEN '{UNCATEGORISED}' ELSE category_s END AS category, total_cents, issue_count, coalesce(len(ids), 1) > 1 AS duplicate
    FROM ledger LEFT JOIN keys USING (dedup_key)"""
)
def picked_rows(spark, sf_dir):
    rows = A.ledger(spark, sf_dir)
    return L.picked_rows(L.with_duplicate_count(rows, rows))


@query(f"WITH {LEDGER}, {_KEYS} SELECT id, total_cents, coalesce(len(ids) - 1, 0)::BIGINT AS duplicate_count FROM ledger LEFT JOIN keys USING (dedup_key) WHERE issued_on_s >= '1997-01-01'")
def list_counted(spark, sf_dir):
    return L.list_rows(A.ledger(spark, sf_dir), L.Filter(date_from="1997-01-01"), ids=False).select("id", "total_cents", "duplicate_count")


@query(f"WITH {LEDGER}, {_KEYS} SELECT dedup_key, unnest(ids) AS id FROM keys WHERE len(ids) > 1 AND dedup_key IN (SELECT dedup_key FROM ledger WHERE category_s = '住宿')")
def duplicate_members(spark, sf_dir):
    rows = A.ledger(spark, sf_dir)
    return L.duplicate_members(L.filtered(rows, L.Filter(category="住宿")), rows)


_CATEGORY = f"CASE WHEN category_s = '' THEN '{UNCATEGORISED}' ELSE category_s END"
_TOTALS = f"""SELECT {_CATEGORY} AS category, count(*) AS count, sum(total_cents)::BIGINT AS total_cents, sum(tax_cents)::BIGINT AS tax_cents FROM ledger"""


@query(f"WITH {LEDGER} {_TOTALS} WHERE issued_on_s >= '1996-01-01' GROUP BY 1")
def totals_by_category(spark, sf_dir):
    return L.totals_by_category(A.ledger(spark, sf_dir), L.Filter(date_from="1996-01-01"))


@query(
    f"""WITH {LEDGER} SELECT count(*) AS "all", count(*) FILTER (NOT reviewed AND (min_confidence < 0.9::DOUBLE OR issue_count > 0)) AS review,
    (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM ledger WHERE dedup_key <> '' GROUP BY dedup_key) WHERE n > 1) AS duplicates,
    sum(total_cents)::BIGINT AS total_cents FROM ledger"""
)
def sidebar_counts(spark, sf_dir):
    return L.sidebar_counts(A.ledger(spark, sf_dir))


@query(
    f"""WITH {LEDGER}, t AS ({_TOTALS} GROUP BY 1) SELECT sum(count)::BIGINT AS count, sum(total_cents)::BIGINT AS total_cents, sum(tax_cents)::BIGINT AS tax_cents,
    coalesce(sum(count) FILTER (category = '{UNCATEGORISED}'), 0)::BIGINT AS uncategorised FROM t"""
)
def status_bar(spark, sf_dir):
    return L.status_bar(L.totals_by_category(A.ledger(spark, sf_dir)))


@query(f"WITH {LEDGER} SELECT id, seller_s, total_cents FROM ledger")
def sort_rows(spark, sf_dir):
    return L.sort_rows(A.ledger(spark, sf_dir), "seller", False).select("id", "seller_s", "total_cents")


# --- reports ---------------------------------------------------------------------------------------


@query(
    f"""WITH {LEDGER}, {BRIDGE}, {REPORTS} SELECT r.id, r.title, r.created_at, count(b.invoice_id) AS invoice_count, coalesce(sum(l.total_cents), 0)::BIGINT AS total_cents
    FROM reports r LEFT JOIN bridge b ON b.report_id = r.id LEFT JOIN ledger l ON l.id = b.invoice_id GROUP BY ALL"""
)
def reports_list(spark, sf_dir):
    return reports.list_reports(A.reports(spark, sf_dir), A.bridge(spark, sf_dir), A.ledger(spark, sf_dir))


@query(f"WITH {LEDGER}, {BRIDGE} SELECT position, id, number_s, total_cents FROM bridge JOIN ledger ON id = invoice_id WHERE report_id = 5")
def report_lines(spark, sf_dir):
    return reports.report_invoices(A.bridge(spark, sf_dir), A.ledger(spark, sf_dir), 5).select("position", "id", "number_s", "total_cents")


@query(
    """WITH l AS (SELECT c_nationkey::BIGINT AS report_id, list(o_orderkey % 100 ORDER BY o_orderkey) AS ids FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    e AS (SELECT report_id, unnest(ids) AS invoice_id, generate_subscripts(ids, 1) - 1 AS p FROM l)
    SELECT report_id, invoice_id, min(p)::INT AS position FROM e GROUP BY ALL"""
)
def set_report_dedup(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    lists = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").cast("long").alias("report_id")).agg(
        F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x % 100).alias("ids")
    )
    return reports.first_positions(lists)


_SUMS = f"""SELECT CASE WHEN coalesce(category, '') = '' THEN '{UNCATEGORISED}' ELSE category END AS category, count(*) AS count,
  sum(coalesce(net, coalesce(total, 0) - coalesce(tax, 0)))::BIGINT AS amount_excl_tax_cents, sum(coalesce(tax, 0))::BIGINT AS tax_cents,
  sum(coalesce(total, 0))::BIGINT AS total_cents, coalesce(sum(tax) FILTER (kind = 'digitalSpecial'), 0)::BIGINT AS deductible_tax_cents, false AS is_total
  FROM inv GROUP BY 1"""
_SUMMARY = f"""s AS ({_SUMS}), a AS (SELECT * FROM s UNION ALL SELECT NULL, sum(count)::BIGINT, sum(amount_excl_tax_cents)::BIGINT, sum(tax_cents)::BIGINT,
  sum(total_cents)::BIGINT, sum(deductible_tax_cents)::BIGINT, true FROM s)"""


@query(f"WITH {INVOICES}, {_SUMMARY} SELECT * FROM a")
def summary(spark, sf_dir):
    return reports.summary(A.invoices(spark, sf_dir))


@query(f"WITH {INVOICES}, {_SUMMARY} SELECT *, total_cents::DOUBLE / (SELECT total_cents FROM a WHERE is_total) AS share FROM a")
def summary_share(spark, sf_dir):
    return reports.with_share(reports.summary(A.invoices(spark, sf_dir)))


@query(f"WITH {LEDGER} SELECT id, issued_on_s AS issued_on, number_s AS number FROM ledger")
def sort_by_date(spark, sf_dir):
    rows = A.ledger(spark, sf_dir).select("id", F.col("issued_on_s").alias("issued_on"), F.col("number_s").alias("number"))
    return reports.sort_by_date(rows, "id")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey = 3 THEN 7 WHEN n_nationkey BETWEEN 4 AND 7 THEN n_nationkey - 1 ELSE n_nationkey END AS position FROM nation")
def move_row(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("position"))
    return reports.move_row(n, 3, 4, 25)


@query(
    f"""WITH {LEDGER}, s AS (SELECT id, total_cents, total_cents // 100 AS y, total_cents // 10 % 10 AS j, total_cents % 10 AS f, lpad(CAST(total_cents // 100 AS VARCHAR), 12, '0') AS t FROM ledger),
    w AS (SELECT *, array_to_string([CASE WHEN substr(t, k, 1) = '0' THEN '零' ELSE substr('壹贰叁肆伍陆柒捌玖', CAST(substr(t, k, 1) AS INT), 1) || ['', '仟', '佰', '拾'][k % 4 + 1] END
    || CASE k WHEN 4 THEN '亿' WHEN 8 THEN '万' ELSE '' END FOR k IN range(1, 13)], '') AS words FROM s)
    SELECT id, total_cents, CASE WHEN total_cents = 0 THEN '零圆整' ELSE
    trim(regexp_replace(regexp_replace(regexp_replace(words, '零零零零[亿万]', '零', 'g'), '零+([亿万])', '\\1', 'g'), '零+', '零', 'g'), '零') || CASE WHEN y > 0 THEN '圆' ELSE '' END
    || CASE WHEN j = 0 AND f = 0 THEN '整' ELSE CASE WHEN j > 0 THEN substr('壹贰叁肆伍陆柒捌玖', CAST(j AS INT), 1) || '角' WHEN y > 0 THEN '零' ELSE '' END
    || CASE WHEN f > 0 THEN substr('壹贰叁肆伍陆柒捌玖', CAST(f AS INT), 1) || '分' ELSE '整' END END END AS capital FROM w"""
)
def chinese_capital(spark, sf_dir):
    return A.ledger(spark, sf_dir).select("id", "total_cents", money.chinese_capital(F.col("total_cents")).alias("capital"))


@query(
    f"""WITH {INVOICES}, m AS (SELECT id, coalesce(number, '(无号码)') AS number, unnest([CASE WHEN number IS NULL THEN '缺少发票号码' END, CASE WHEN issued_on IS NULL THEN '缺少开票日期' END,
    CASE WHEN total IS NULL AND (net IS NULL OR tax IS NULL) THEN '缺少价税合计' END]) AS message FROM inv) SELECT id, number, message FROM m WHERE message IS NOT NULL"""
)
def report_warnings(spark, sf_dir):
    checked = validate.infer_and_check(A.invoices(spark, sf_dir), TODAY)
    return reports.warnings(checked.withColumn("issues", F.filter("issues", lambda i: i["kind"] == "missingField"))).select("id", "number", "message")


@query(f"WITH {LEDGER}, {BRIDGE}, {_KEYS} SELECT id, number_s AS number FROM bridge JOIN ledger ON id = invoice_id JOIN keys USING (dedup_key) WHERE report_id = 4 AND len(ids) > 1")
def report_duplicates(spark, sf_dir):
    rows = A.ledger(spark, sf_dir)
    return reports.duplicates_of_report(reports.report_invoices(A.bridge(spark, sf_dir), rows, 4), rows)


@query(f"WITH {INVOICES} SELECT id, net + tax AS computed FROM inv")
def computed_total(spark, sf_dir):
    return A.invoices(spark, sf_dir).select("id", reports.computed_total(F.col("amount_excl_tax.value"), F.col("tax.value")).alias("computed"))


@query(
    f"""WITH {INVOICES} SELECT id, coalesce(number, lpad(id::VARCHAR, 8, '0')) AS number, CASE WHEN number IS NOT NULL THEN 'pdfText' ELSE 'vision' END AS number_source,
    coalesce(total, id * 100) AS total, (CASE WHEN total IS NOT NULL THEN 0.75::FLOAT ELSE 0.375::FLOAT END)::DOUBLE AS total_confidence FROM inv"""
)
def vision_reply(spark, sf_dir):
    k = F.col("id").cast("string")
    reply = F.concat(F.lit('结果 {"发票号码":"'), F.lpad(k, 8, "0"), F.lit('","价税合计":"¥'), k, F.lit('","税额":"无","看不清的字段":["价税合计"]} 完'))
    got = replies.apply_vision(A.invoices(spark, sf_dir).withColumn("_reply", reply), "_reply")
    return got.select(
        "id", F.col("number.value").alias("number"), F.col("number.source").alias("number_source"), F.col("total.value").alias("total"), F.col("total.confidence").cast("double").alias("total_confidence")
    )


# --- rules -----------------------------------------------------------------------------------------


@query(f"WITH {INVOICES} SELECT id, nullif(trim(regexp_extract(item, '^\\*([^*]*)\\*', 1)), '') AS tax_category FROM inv")
def tax_category(spark, sf_dir):
    return A.invoices(spark, sf_dir).select("id", text.tax_category(F.col("items")[0]["name"]).alias("tax_category"))


def _seeds(spark: SparkSession) -> DataFrame:
    rows = [{**r.asDict(True), "id": k} for k, r in enumerate(classify.seed_rules(spark).collect(), 1)]
    return spark.createDataFrame(rows, classify.RULE)


@query(f"WITH {INVOICES} SELECT id, {A.RULE_CATEGORY} AS category FROM inv")
def classify_rules(spark, sf_dir):
    return classify.classify(A.invoices(spark, sf_dir), _seeds(spark)).select("id", "category")


@query(f"WITH {INVOICES} SELECT id, {A.RULE_CATEGORY} AS category FROM inv")
def classify_by_join(spark, sf_dir):
    rows = A.invoices(spark, sf_dir)
    return rows.select("id").join(classify.match_by_join(rows, _seeds(spark), "id").select("id", "category"), "id", "left")


@query(
    f"""WITH {INVOICES}, m AS (SELECT id, category AS was, category_rule, {A.RULE_CATEGORY} AS now FROM inv),
    c AS (SELECT *, NOT (coalesce(was, '') <> '' AND coalesce(category_rule, '') = '') AND was IS DISTINCT FROM now AS changed FROM m)
    SELECT id, changed, CASE WHEN changed THEN now ELSE was END AS category FROM c"""
)
def reclassify_changed(spark, sf_dir):
    return classify.reclassify(A.invoices(spark, sf_dir), _seeds(spark)).select("id", "changed", "category")


@query(
    f"""WITH {INVOICES}, t AS (SELECT id, nullif(trim(regexp_extract(item, '^\\*([^*]*)\\*', 1)), '') AS tax, seller FROM inv)
    SELECT id, CASE WHEN tax IS NOT NULL THEN '税收分类简称：' || tax ELSE '销售方名称：' || seller END AS rule_name, 200 AS priority FROM t"""
)
def proposed_rules(spark, sf_dir):
    rule = classify.proposed_rule(F.lit("住宿"))
    return A.invoices(spark, sf_dir).select("id", rule["name"].alias("rule_name"), rule["priority"].alias("priority"))


def _seed_sql() -> str:
    rows = ", ".join(f"({k}, '{c}', {p}, '{f}', '{'、'.join(w)}')" for k, (c, p, f, w) in enumerate(classify.SEEDS, 1))
    return f"seeds AS (SELECT * FROM (VALUES {rows}) AS v(id, category, priority, field, words))"


_LABEL_SQL = f"CASE field {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in {'taxCategory': '税收分类简称', 'itemName': '项目名称', 'sellerName': '销售方名称', 'kind': '票种'}.items())} END"


@query(f"WITH {_seed_sql()} SELECT id, {_LABEL_SQL} || ' 包含 ' || replace(words, '、', ' 或 ') AS described, {_LABEL_SQL} || '：' || words AS name, true AS auto FROM seeds")
def rule_prose(spark, sf_dir):
    return _seeds(spark).select(
        F.col("id").cast("int").alias("id"),
        prose.describe_rule(F.col("conditions")).alias("described"),
        prose.default_rule_name(F.col("conditions")).alias("name"),
        prose.is_auto_name(F.col("name"), F.col("conditions")).alias("auto"),
    )


@query(f"WITH {_seed_sql()} SELECT category, string_agg(id::VARCHAR, ',' ORDER BY priority DESC, id) AS ids FROM seeds GROUP BY category")
def rule_groups(spark, sf_dir):
    return classify.group_by_category(_seeds(spark)).select("category", joined(F.transform("rules", lambda r: r["id"])).alias("ids"))


@query(f"WITH {_seed_sql()} SELECT DISTINCT category FROM seeds UNION SELECT '{UNCATEGORISED}'")
def rule_categories(spark, sf_dir):
    return classify.rule_categories(_seeds(spark))


@query(
    """SELECT p_size, CASE WHEN v > 200 THEN '高于' WHEN v IN (200, 150, 120, 100, 50) THEN '与内置' WHEN v > 50 THEN '介于' ELSE '低于' END AS head, v > 200 AS warn
    FROM (SELECT DISTINCT p_size, p_size * 10 AS v FROM part)"""
)
def priority_notes(spark, sf_dir):
    note = prose.priority_note(F.col("v"))
    rows = table(spark, sf_dir, "part").select("p_size", (F.col("p_size") * 10).alias("v")).distinct()
    head = F.when(note["text"].startswith("与内置"), "与内置").otherwise(F.substring(note["text"], 1, 2))
    return rows.select("p_size", head.alias("head"), note["warn"].alias("warn"))


@query(f"WITH {_seed_sql()} SELECT id, category, priority, row_number() OVER (ORDER BY priority DESC, id) AS place FROM seeds")
def rules_ordered(spark, sf_dir):
    """The rule list is bounded, so its places are numbered in one window."""
    from pyspark.sql import Window

    rules = classify.ordered(_seeds(spark))
    place = F.row_number().over(Window.orderBy(F.desc("priority"), "id"))
    return rules.select(F.col("id").cast("int").alias("id"), "category", "priority", place.cast("long").alias("place"))


@query(f"WITH {_seed_sql()} SELECT id, category FROM seeds WHERE id % 3 <> 0")
def restore_defaults(spark, sf_dir):
    seeds = _seeds(spark)
    return classify.missing_defaults(seeds, seeds.where("id % 3 = 0").drop("id")).select(F.col("id").cast("int").alias("id"), "category")


@query(f"WITH {_seed_sql()} SELECT category, min(id) AS first FROM seeds GROUP BY category")
def seed_categories(spark, sf_dir):
    seeds = _seeds(spark)
    return selection.first_seen(seeds, "category", "id").join(seeds.groupBy("category").agg(F.min("id").cast("int").alias("first")), "category")


@query(f"WITH {_seed_sql()} SELECT count(*) FILTER (id % 4 = 0) AS disabled FROM seeds")
def disabled_rules(spark, sf_dir):
    return classify.disabled_count(_seeds(spark).withColumn("enabled", F.col("id") % 4 != 0))


# --- money, fields, checks -------------------------------------------------------------------------


@query(
    """SELECT o_orderkey, c AS cents, c AS lenient, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE c END AS strict, -c AS negative, c // 100 * 100 + (c % 100) // 10 * 10 + 10 AS rounded
    FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders)"""
)
def money_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    shown = money.format_money(F.col("cents"))
    noisy = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("共 "), shown, F.lit(" 元"))).otherwise(shown)
    digits = money.to_decimal_string(F.col("cents"))
    return rows.select(
        "o_orderkey",
        "cents",
        money.parse_money(noisy).alias("lenient"),
        money.parse_yuan(noisy).alias("strict"),
        money.parse_money(F.concat(F.lit("-"), digits)).alias("negative"),
        money.parse_money(F.concat(F.expr("substring(cast(cents as string), 1, length(cast(cents as string)) - 2)"), F.lit("."), F.expr("substring(cast(cents as string), -2, 1)"), F.lit("95"))).alias("rounded"),
    )


@query(
    """SELECT o_orderkey, (c // 100)::VARCHAR || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS decimal_text, '¥' || (c // 100)::VARCHAR || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS display,
    '-¥' || format('{:,}', c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS grouped, (c // 100)::VARCHAR || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS input
    FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders)"""
)
def money_format(spark, sf_dir):
    c = F.round(F.col("o_totalprice") * 100).cast("long")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", money.to_decimal_string(c).alias("decimal_text"), money.display(c).alias("display"), money.format_money(-c).alias("grouped"), money.yuan_input(c).alias("input")
    )


_INFERRED = """f AS (SELECT *, (net IS NULL)::INT + (tax IS NULL)::INT + (total IS NULL)::INT AS gaps FROM inv),
d AS (SELECT *, CASE WHEN net IS NULL AND gaps = 1 THEN total - tax ELSE net END AS net2, CASE WHEN tax IS NULL AND gaps = 1 THEN total - net ELSE tax END AS tax2,
  CASE WHEN total IS NULL AND gaps = 1 THEN net + tax ELSE total END AS total2 FROM f)"""


@query(
    f"""WITH {INVOICES}, {_INFERRED} SELECT id, net2 AS net, tax2 AS tax, total2 AS total,
    CASE WHEN total IS NOT NULL THEN 'vision' WHEN gaps = 1 THEN 'pdfText' ELSE 'missing' END AS total_source,
    (CASE WHEN total IS NOT NULL THEN 0.75::FLOAT WHEN gaps = 1 THEN (0.9::FLOAT * 0.95::FLOAT)::FLOAT ELSE 0::FLOAT END)::DOUBLE AS total_confidence FROM d"""
)
def infer_missing(spark, sf_dir):
    got = A.invoices(spark, sf_dir).withColumns(validate.infer_missing(F.col("amount_excl_tax"), F.col("tax"), F.col("total")))
    return got.select(
        "id",
        F.col("amount_excl_tax.value").alias("net"),
        F.col("tax.value").alias("tax"),
        F.col("total.value").alias("total"),
        F.col("total.source").alias("total_source"),
        F.col("total.confidence").cast("double").alias("total_confidence"),
    )


@query(
    f"""WITH {INVOICES}, {_INFERRED} SELECT id, array_to_string(list_filter([CASE WHEN net2 + tax2 <> total2 THEN 'totalMismatch' END,
    CASE WHEN number IS NULL THEN 'missingField' END, CASE WHEN issued_on IS NULL THEN 'missingField' END, CASE WHEN total2 IS NULL THEN 'missingField' END,
    CASE WHEN issued_on > '2024-02-01' THEN 'futureDate' END], lambda x: x IS NOT NULL), ',') AS kinds,
    CASE WHEN net2 + tax2 <> total2 THEN net2 + tax2 END AS expected_cents FROM d"""
)
def validate_issues(spark, sf_dir):
    got = validate.infer_and_check(A.invoices(spark, sf_dir), datetime.date(2024, 2, 1))
    return got.select("id", F.array_join(F.transform("issues", lambda i: i["kind"]), ",").alias("kinds"), F.get(F.col("issues"), 0)["expected_cents"].alias("expected_cents"))


@query(
    f"""WITH {INVOICES}, {_INFERRED}, i AS (SELECT CASE WHEN net2 + tax2 <> total2 THEN 'totalMismatch' END AS a, CASE WHEN number IS NULL THEN 'missingField' END AS b,
    CASE WHEN issued_on IS NULL THEN 'missingField' END AS c, CASE WHEN total2 IS NULL THEN 'missingField' END AS d FROM d)
    SELECT kind, count(*) AS n, kind = 'totalMismatch' AS is_error FROM (SELECT unnest([a, b, c, d]) AS kind FROM i) WHERE kind IS NOT NULL GROUP BY kind"""
)
def issue_counts(spark, sf_dir):
    issues = validate.infer_and_check(A.invoices(spark, sf_dir), TODAY).select(F.explode("issues").alias("i"))
    return issues.groupBy(F.col("i.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(prose.is_error(F.col("i"))).alias("is_error"))


@query(
    """SELECT l_orderkey, arg_max(l_quantity::BIGINT, (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 3 ELSE 4 END)::BIGINT * 1000000000000 + round(l_discount * 100)::BIGINT * 10000000000
    - (l_linenumber::BIGINT * 1000000000 + l_quantity::BIGINT * 1000000 + l_suppkey)) AS value FROM lineitem GROUP BY l_orderkey"""
)
def field_merge(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    source = F.when(F.col("l_returnflag") == "A", "vision").when(F.col("l_returnflag") == "N", "qrCode").otherwise("xml")
    f = fields.make_field(F.col("l_quantity").cast("long"), source, (F.round(F.col("l_discount") * 100) / 100).cast("float"))
    order = F.col("l_linenumber").cast("long") * F.lit(1_000_000_000) + F.col("l_quantity").cast("long") * 1_000_000 + F.col("l_suppkey")
    return li.withColumns({"_f": f, "_o": order}).groupBy("l_orderkey").agg(fields.merge_agg(F.col("_f"), F.col("_o"))["value"].alias("value"))


@query(
    f"""WITH {INVOICES} SELECT id, array_to_string(list_filter([CASE WHEN number IS NULL THEN '发票号码' END, CASE WHEN issued_on IS NULL THEN '开票日期' END, '价税合计'],
    lambda x: x IS NOT NULL), ',') AS review, (CASE WHEN number IS NULL OR issued_on IS NULL OR total IS NULL THEN 0::FLOAT ELSE 0.75::FLOAT END)::DOUBLE AS min_confidence,
    CASE WHEN number IS NULL THEN 'missing' ELSE 'ok' END AS number_trust, false AS complete FROM inv"""
)
def fields_review(spark, sf_dir):
    return A.invoices(spark, sf_dir).select(
        "id",
        F.array_join(fields.fields_needing_review(), ",").alias("review"),
        fields.min_key_confidence().cast("double").alias("min_confidence"),
        fields.trust(F.col("number")).alias("number_trust"),
        fields.is_complete().alias("complete"),
    )


# --- text, kinds, codes, dates ---------------------------------------------------------------------

_TITLES = ["电子发票（普通发票）", "电子发票（增值税专用发票）", "增值税普通发票(卷式)", "增值税电子普通发票", "铁路电子客票", "数电票 增值税专用发票", "全电 普票", "出租车", "31", "餐费收据"]
_TITLE_KINDS = ["digitalGeneral", "digitalSpecial", "vatRoll", "vatElectronicGeneral", "train", "vatSpecial", "digitalGeneral", "taxi", "digitalGeneral", None]


@query(
    "SELECT o_orderkey, CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_TITLE_KINDS) if v) + " END AS kind FROM orders"
)
def kind_from_title(spark, sf_dir):
    title = F.get(F.array(*map(F.lit, _TITLES)), (F.col("o_orderkey") % 10).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", kinds.kind_from_title(title).alias("kind"))


_DAY = "lpad((o_orderkey % 28 + 1)::VARCHAR, 2, '0')"


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE lpad(o_orderkey::VARCHAR, 20, '0') END AS number,
    CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE '2023-08-' || {_DAY} END AS issued_on, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE round(o_totalprice * 100)::BIGINT END AS amount_cents,
    CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'digitalSpecial' ELSE 'digitalGeneral' END AS kind FROM orders"""
)
def qr_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    day, number = F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lpad(k.cast("string"), 20, "0")
    amount = money.to_decimal_string(F.round(F.col("o_totalprice") * 100).cast("long"))
    listed = F.concat(F.lit("01,32,,"), number, F.lit(","), amount, F.lit(",202308"), day, F.lit(",,AB12,"))
    url = F.concat(F.lit("https://example.invalid/v?FPHM="), number, F.lit("&kprq=2023-08-"), day, F.lit("&kjje=1&kjje="), amount)
    payload = F.when(k % 5 == 4, "https://example.invalid/?a=1").when(k % 2 == 0, listed).otherwise(url)
    read = qr.with_reading(table(spark, sf_dir, "orders").select("o_orderkey", payload.alias("payload")), F.col("payload"), "q")
    return read.select("o_orderkey", *[F.col("q")[n].alias(n) for n in ("number", "issued_on", "amount_cents", "kind")])


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN lpad(o_orderkey::VARCHAR, 20, '0') END AS number, '2023-08-' || {_DAY} AS issued_on, 'vatSpecial' AS kind,
    round(o_totalprice * 100)::BIGINT AS total, (CASE WHEN o_orderkey % 3 = 0 THEN 0.8::FLOAT ELSE 0.9::FLOAT END)::DOUBLE AS confidence,
    replace(c_name, ' ', '') AS buyer, '销方' || o_custkey::VARCHAR AS seller FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def text_parse(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    number = F.when(k % 2 == 0, F.lpad(k.cast("string"), 20, "0")).otherwise("123456789")
    amount = F.replace(money.format_money(F.round(F.col("o_totalprice") * 100).cast("long")), F.lit("¥"), F.lit(""))
    total = F.when(k % 3 == 0, F.concat(F.lit("价 税 合 计：￥ "), amount)).otherwise(F.concat(F.lit("价税合计（大写）壹圆整（小写） ￥"), amount))
    page = F.concat(
        F.lit("增值税专用发票\n发 票 号 码： "), number, F.lit("\n开票日期： 2023 年 08 月 "), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit(" 日\n购买方 名 称： "), F.col("c_name"),
        F.lit("\n纳税人识别号： 91310115MA1K3XYZ2B\n销售方 名称：销方"), F.col("o_custkey").cast("string"), F.lit("\n地址、电话：无\n"), total,
    )
    pages, p = text.parse_text(o.join(c, o["o_custkey"] == c["c_custkey"]).withColumn("page", page), F.col("page"))
    return pages.select(
        "o_orderkey",
        p["number"]["value"].alias("number"),
        p["issued_on"]["value"].alias("issued_on"),
        p["kind"].alias("kind"),
        p["total"]["value"].alias("total"),
        p["total"]["confidence"].cast("double").alias("confidence"),
        p["buyer_name"]["value"].alias("buyer"),
        p["seller_name"]["value"].alias("seller"),
    )


@query("SELECT doc_id, sha256(text) AS file_hash, doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS inserted FROM documents")
def file_hash_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.file_hash(F.col("text").cast("binary")).alias("file_hash"))
    first = docs.groupBy("file_hash").agg(F.min("doc_id").alias("_first"))
    return docs.join(first, "file_hash").select("doc_id", "file_hash", (F.col("doc_id") == F.col("_first")).alias("inserted"))


@query(
    """SELECT doc_id, length(regexp_replace(text, '[^0-9A-Za-z\\x{4E00}-\\x{9FFF}]', '', 'g')) AS legible,
    length(regexp_replace(text, '[^0-9A-Za-z\\x{4E00}-\\x{9FFF}]', '', 'g')) >= 40 AS usable FROM documents"""
)
def legible_text(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.legible_count(t).cast("long").alias("legible"), text.has_usable_text(t).alias("usable"))


@query(
    """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE event_type END AS said FROM events"""
)
def json_reply(spark, sf_dir):
    reply = F.concat(F.lit("好的，结果如下：```"), F.col("props"), F.lit("``` 完"))
    said = F.when(F.col("event_type") == "view", "N/A").when(F.col("event_type") == "click", " 无 ").otherwise(F.concat(F.col("event_type"), F.lit(" ")))
    return table(spark, sf_dir, "events").select(
        "event_id", F.from_json(text.extract_json(reply), "k bigint")["k"].alias("k"), text.meaningful(said).alias("said")
    )


_STATUS_SQL = "CASE event_type WHEN 'purchase' THEN 'imported' WHEN 'signup' THEN 'needsReview' WHEN 'error' THEN 'failed' ELSE 'alreadyImported' END"


@query(
    f"""WITH e AS (SELECT {_STATUS_SQL} AS status, value > 10 AS v FROM events) SELECT count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'needsReview') AS "needsReview",
    count(*) FILTER (status = 'alreadyImported') AS "alreadyImported", count(*) FILTER (status = 'failed') AS failed, count(*) AS total, count(*) FILTER (v) AS vision_candidates FROM e"""
)
def import_tally(spark, sf_dir):
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "imported").when(kind == "signup", "needsReview").when(kind == "error", "failed").otherwise("alreadyImported")
    return ingest.tally(table(spark, sf_dir, "events").select(status.alias("status"), (F.col("value") > 10).alias("vision_would_help")))


@query(
    f"""WITH {INVOICES} SELECT CASE WHEN id % 19 = 0 THEN 'alreadyImported' WHEN number IS NULL AND total IS NULL THEN 'failed' ELSE 'needsReview' END AS status, count(*) AS n
    FROM inv GROUP BY 1"""
)
def status_counts(spark, sf_dir):
    status = ingest.file_status(F.col("id") % 19 == 0)
    return A.invoices(spark, sf_dir).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS shown, month(o_orderdate)::VARCHAR || '月' AS month, year(o_orderdate)::VARCHAR || '年' || month(o_orderdate)::VARCHAR || '月报销单' AS title,
    CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS eight,
    CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') END AS prefix FROM orders"""
)
def date_scalars(spark, sf_dir):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.format_date(iso).alias("shown"),
        dates.month_label(iso).alias("month"),
        dates.default_report_title(iso).alias("title"),
        dates.date_of_eight(F.date_format("o_orderdate", "yyyy年MM月dd日")).alias("eight"),
        dates.date_of_prefix(F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss")).alias("prefix"),
    )


@query(
    """SELECT * FROM (VALUES ('all', '', ''), ('thisMonth', '2024-03-01', '2024-03-15'), ('lastMonth', '2024-02-01', '2024-02-29'), ('last3', '2024-01-01', '2024-03-15'),
    ('thisYear', '2024-01-01', '2024-03-15')) AS t(preset, date_from, date_to)"""
)
def date_presets(spark, sf_dir):
    one, out = spark.range(1), None
    for name in ("all", "thisMonth", "lastMonth", "last3", "thisYear"):
        a, b = dates.preset_range(name, F.lit(TODAY))
        row = one.select(F.lit(name).alias("preset"), a.alias("date_from"), b.alias("date_to"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    """SELECT n_nationkey, 'a&amp;' || n_name || '&lt;b&gt;' AS escaped, 'a&' || n_name || '<b>' AS back, n_name || '.xlsx' AS base, 'x' || n_name AS safe,
    n_name || ',k' AS keywords FROM nation"""
)
def text_helpers(spark, sf_dir):
    n = F.col("n_name")
    raw = F.concat(F.lit("a&"), n, F.lit("<b>"))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey",
        text.escape_xml(raw).alias("escaped"),
        text.unescape_xml(text.escape_xml(raw)).alias("back"),
        text.base_name(F.concat(F.lit("C:\\tmp/x\\"), n, F.lit(".xlsx"))).alias("base"),
        text.safe_file_name(F.concat(F.lit(' x/:*?"'), n, F.lit("<>| "))).alias("safe"),
        F.array_join(text.add_keywords(F.array(n), F.concat(n, F.lit("，k； ;"), n)), ",").alias("keywords"),
    )


@query("SELECT page_id, 'unknown' AS file_kind, '未知格式' AS label FROM pages")
def detect_files(spark, sf_dir):
    kind = files.detect(F.col("html").cast("binary"), F.concat(F.col("page_id").cast("string"), F.lit(".html")))
    label = F.coalesce(*[F.when(F.col("file_kind") == k, F.lit(v)) for k, v in FILE_KINDS.items()])
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("file_kind")).select("page_id", "file_kind", label.alias("label"))


@query()
def tag_index(spark, sf_dir):
    """Tags of a page's markup with how many leaves each has; markup that breaks off keeps what was read."""
    from ..sources.einvoice import index_content

    leaves = table(spark, sf_dir, "pages").select("page_id", index_content(F.col("html").cast("binary"))["leaves"].alias("l"))
    return leaves.select("page_id", F.explode("l").alias("tag", "texts")).select("page_id", "tag", F.size("texts").alias("n"))


@query(f"WITH {INVOICES} SELECT id, '票种：' || CASE kind WHEN 'digitalSpecial' THEN '数电票（专用）' WHEN 'digitalGeneral' THEN '数电票（普通）' ELSE '铁路电子客票' END || chr(10) || '销售方：' || seller || chr(10) || '项目：' || item AS described FROM inv")
def describe_invoice(spark, sf_dir):
    return A.invoices(spark, sf_dir).select("id", replies.describe().alias("described"))


# --- sets ------------------------------------------------------------------------------------------

_SETS = "a AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0)"


@query(
    f"""WITH {_SETS} SELECT 'visible' AS op, id FROM (SELECT id FROM a INTERSECT SELECT id FROM b) UNION ALL SELECT 'check', id FROM (SELECT id FROM a UNION SELECT id FROM b)
    UNION ALL SELECT 'uncheck', id FROM (SELECT id FROM a EXCEPT SELECT id FROM b)
    UNION ALL SELECT 'toggle', id FROM ((SELECT id FROM a EXCEPT SELECT id FROM b) UNION (SELECT id FROM b EXCEPT SELECT id FROM a))"""
)
def set_ops_selection(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    a, b = ids.where("id % 2 = 0"), ids.where("id % 3 = 0")
    parts = {"visible": selection.visible(a, b), "check": selection.check_all(a, b), "uncheck": selection.uncheck_all(a, b), "toggle": selection.toggle(a, b)}
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("op"), "id")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT id FROM (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 100 = 0 UNION SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 30 AND 60)")
def select_range(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return selection.add_range(ids.where("id % 100 = 0"), ids, 60, 30, ["id"])


@query(f"WITH {LEDGER}, {_seed_sql()} SELECT category FROM (SELECT category FROM seeds UNION SELECT category_s FROM ledger) WHERE category NOT IN ('', '{UNCATEGORISED}')")
def category_names(spark, sf_dir):
    return selection.category_names(_seeds(spark), A.ledger(spark, sf_dir))


@query(f"WITH {LEDGER} SELECT sum(total_cents)::BIGINT AS total_cents FROM ledger WHERE id % 7 = 0")
def selected_total(spark, sf_dir):
    rows = A.ledger(spark, sf_dir)
    return selection.selected_total(rows, rows.where("id % 7 = 0").select("id"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["totals_by_category"](spark, sf_dir)


# --- changes ---------------------------------------------------------------------------------------

_INVOICE_ROW = T.StructType([T.StructField(n, T.LongType() if n in ("id", "total_cents") else T.StringType()) for n in ("id", "number_s", "category_s", "total_cents")])
#: The lines of an order set its amount and category, by number, then amount; partly delivered orders are deleted at line 4, so later lines bring them back; every 50th order comes in anew.
_CHANGES = """edits AS (
  SELECT l_orderkey AS id, lpad(l_partkey::VARCHAR, 8, '0') AS number_s, l_returnflag AS category_s, round(l_extendedprice * 100)::BIGINT AS total_cents, l_linenumber * 1000000000000 + round(l_extendedprice * 100)::BIGINT * 1000 + l_partkey % 1000 AS seq, 'upsert' AS op FROM lineitem WHERE l_linenumber <> 4
  UNION ALL SELECT o_orderkey, NULL, NULL, NULL, 4000000000000, 'delete' FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 10 = 3
  UNION ALL SELECT o_orderkey + 1000000000, 'new', '', o_custkey, 0, 'upsert' FROM orders WHERE o_orderkey % 50 = 0
), last AS (SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"""


def _change_set(spark: SparkSession, sf_dir: str) -> Store:
    """Orders and report lines in a store, after changes from orders and line items, in one commit."""
    store = Store(spark, scratch(spark, "store"))
    store.table("invoices", _INVOICE_ROW, ["id"], children={"report_invoices": "invoice_id"})
    store.table("report_invoices", REPORT_INVOICE, ["report_id", "invoice_id"], "invoice_id")
    store.apply({"invoices": upserts(A.ledger(spark, sf_dir).select(*_INVOICE_ROW.names)), "report_invoices": upserts(A.bridge(spark, sf_dir))})
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_linenumber <> 4")
    edited = l.select(
        F.col("l_orderkey").alias("id"), F.lpad(F.col("l_partkey").cast("string"), 8, "0").alias("number_s"), F.col("l_returnflag").alias("category_s"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("total_cents"), (F.col("l_linenumber") * 10**12 + F.round(F.col("l_extendedprice") * 100).cast("long") * 1000 + F.col("l_partkey") % 1000).alias("line"),
    )
    new = o.where("o_orderkey % 50 = 0").select((F.col("o_orderkey") + 1_000_000_000).alias("id"), F.lit("new").alias("number_s"), F.lit("").alias("category_s"), F.col("o_custkey").alias("total_cents"))
    gone = deletes(o.where("o_orderstatus = 'P' OR o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("id")), 4 * 10**12)
    lines = upserts(new.select(F.lit(7).cast("long").alias("report_id"), F.col("id").alias("invoice_id"), F.lit(0).alias("position")))
    changes = upserts(edited, F.col("line")).drop("line").unionByName(upserts(new)).unionByName(gone, allowMissingColumns=True)
    store.apply({"invoices": changes, "report_invoices": lines})
    return store


@query(
    f"""WITH {LEDGER}, {_CHANGES} SELECT l.id, l.number_s, l.category_s, l.total_cents FROM ledger l WHERE l.id NOT IN (SELECT id FROM last)
    UNION ALL SELECT id, number_s, category_s, total_cents FROM last WHERE op = 'upsert'"""
)
def change_set(spark, sf_dir):
    return _change_set(spark, sf_dir).tables["invoices"].read()


@query(
    f"""WITH {BRIDGE}, {_CHANGES} SELECT * FROM bridge WHERE invoice_id NOT IN (SELECT id FROM last WHERE op = 'delete')
    UNION ALL SELECT 7, id, 0 FROM last WHERE number_s = 'new'"""
)
def change_set_lines(spark, sf_dir):
    return _change_set(spark, sf_dir).tables["report_invoices"].read()


@query(
    f"""WITH {LEDGER}, m AS (SELECT code_s, id, (row_number() OVER (PARTITION BY code_s ORDER BY id) - 1) // 1000 AS chunk FROM ledger WHERE code_s <> '')
    SELECT code_s AS dedup_key, chunk, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM m GROUP BY ALL"""
)
def duplicate_chunks(spark, sf_dir):
    rows = A.ledger(spark, sf_dir).withColumn("dedup_key", F.col("code_s"))  # keys that a fifth of all rows share
    return L.duplicate_chunks(rows, rows).withColumn("ids", joined(F.col("ids")))


@query(
    f"""WITH {LEDGER}, m AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY id) - 1 AS k FROM ledger WHERE dedup_key <> ''), c AS (SELECT dedup_key, list(id ORDER BY id) AS ids, count(*) AS n FROM m WHERE k < 1000 GROUP BY 1)
    SELECT id, coalesce(array_to_string(list_filter(ids, lambda i: i <> id), ','), '') AS ids FROM ledger JOIN c USING (dedup_key) WHERE n > 1"""
)
def duplicate_page(spark, sf_dir):
    rows = A.ledger(spark, sf_dir)
    return L.duplicate_page(rows, L.duplicate_chunks(rows, rows)).withColumn("ids", joined(F.col("ids")))


# --- order -----------------------------------------------------------------------------------------


@query(f"WITH {LEDGER} SELECT row_number() OVER (ORDER BY issued_on_s DESC, id DESC) - 1 AS position, id FROM ledger")
def list_positions(spark, sf_dir):
    return ordering.positions(A.ledger(spark, sf_dir).select("id", "issued_on_s"), ordering.list_order()).select("position", "id")


@query(f"WITH {LEDGER} SELECT row_number() OVER (ORDER BY seller_s, id) - 1 AS position, id, seller_s FROM ledger")
def seller_positions(spark, sf_dir):
    return ordering.positions(A.ledger(spark, sf_dir).select("id", "seller_s"), ordering.list_order("seller", False)).select("position", "id", "seller_s")


@query(
    f"""WITH {LEDGER}, p AS (SELECT *, row_number() OVER (ORDER BY total_cents DESC, id DESC) - 1 AS k FROM ledger)
    SELECT k // 100 AS page, count(*) AS rows, arg_min(id, k) AS first_id, arg_max(id, k) AS last_id, arg_min(total_cents, k) AS first_total_cents, arg_max(total_cents, k) AS last_total_cents FROM p GROUP BY 1"""
)
def list_pages(spark, sf_dir):
    placed = ordering.positions(A.ledger(spark, sf_dir).select("id", "total_cents"), ordering.list_order("amount"))
    return ordering.pages(placed, 100, ["id", "total_cents"])


@query(
    f"""WITH {BRIDGE}, e AS (SELECT report_id, invoice_id, 0 AS part, position::BIGINT AS spot FROM bridge WHERE invoice_id % 3 = 0 UNION ALL SELECT report_id, invoice_id, 1, -position FROM bridge WHERE invoice_id % 2 = 0
    UNION ALL SELECT 7, invoice_id, 1, 1000000000 + position FROM bridge), f AS (SELECT report_id, invoice_id, min({{'part': part, 'spot': spot}}) AS f FROM e GROUP BY ALL)
    SELECT report_id, invoice_id, (row_number() OVER (PARTITION BY report_id ORDER BY f.part, f.spot, invoice_id) - 1)::INTEGER AS position FROM f"""
)
def report_append(spark, sf_dir):
    b = A.bridge(spark, sf_dir)
    at = F.col("position").cast("long")
    # every second invoice comes to the end of its report, newest first, and all of them to report 7
    added = b.where("invoice_id % 2 = 0").select("report_id", "invoice_id", (-at).alias("at")).unionByName(b.select(F.lit(7).cast("long").alias("report_id"), "invoice_id", (at + 1_000_000_000).alias("at")))
    return ordering.append_lines(b.where("invoice_id % 3 = 0"), added)


# --- imports under way -----------------------------------------------------------------------------

_EVENTS = """ev AS (SELECT user_id AS import_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'finished' ELSE 'file' END AS type, floor(value)::BIGINT AS total, 'f' || event_id AS name,
    CASE WHEN value > 30 THEN 'alreadyImported' WHEN event_type = 'view' THEN 'imported' WHEN event_type = 'click' THEN 'needsReview' ELSE 'failed' END AS status, event_id % 3 = 0 AS vision, floor(value * 2)::BIGINT AS b, event_id % 5 AS c, event_id % 7 AS d FROM events),
  st AS (SELECT import_id, max(seq) FILTER (type = 'started') AS s, arg_max(total, seq) FILTER (type = 'started') AS total, max(seq) AS last_seq FROM ev GROUP BY 1),
  since AS (SELECT e.* FROM ev e JOIN st USING (import_id) WHERE seq > coalesce(s, -1)),
  fi AS (SELECT import_id, max(seq) AS f, arg_max(total, seq) AS a, arg_max(b, seq) AS b, arg_max(c, seq) AS c, arg_max(d, seq) AS d FROM since WHERE type = 'finished' GROUP BY 1),
  se AS (SELECT import_id, count(*) AS done, arg_max(name, seq) FILTER (seq > coalesce(f, -1)) AS current_name, count(*) FILTER (vision) AS vision_candidates, count(*) FILTER (status <> 'imported') AS problems,
    count(*) FILTER (seq > coalesce(f, -1) AND status = 'imported') AS ma, count(*) FILTER (seq > coalesce(f, -1) AND status = 'needsReview') AS mb, count(*) FILTER (seq > coalesce(f, -1) AND status = 'alreadyImported') AS mc,
    count(*) FILTER (seq > coalesce(f, -1) AND status = 'failed') AS md FROM (SELECT e.*, f FROM since e LEFT JOIN fi USING (import_id) WHERE type = 'file') GROUP BY 1)
  SELECT import_id, last_seq, CASE WHEN f IS NOT NULL THEN 'done' WHEN s IS NOT NULL THEN 'running' ELSE 'idle' END AS phase, coalesce(total, 0) AS total, coalesce(done, 0) AS done, current_name,
    coalesce(a, 0) + coalesce(ma, 0) AS imported, coalesce(b, 0) + coalesce(mb, 0) AS needs_review, coalesce(c, 0) + coalesce(mc, 0) AS duplicates, coalesce(d, 0) + coalesce(md, 0) AS failed,
    coalesce(vision_candidates, 0) AS vision_candidates, coalesce(problems, 0) AS problems FROM st LEFT JOIN fi USING (import_id) LEFT JOIN se USING (import_id)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as imports: a sign-up starts one, a purchase finishes it, everything else is a file."""
    v, k = F.col("value"), F.col("event_id")
    type_ = F.when(F.col("event_type") == "signup", "started").when(F.col("event_type") == "purchase", "finished").otherwise("file")
    status = F.when(v > 30, "alreadyImported").when(F.col("event_type") == "view", "imported").when(F.col("event_type") == "click", "needsReview").otherwise("failed")
    whole = lambda x: F.floor(x).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("import_id"), k.alias("seq"), type_.alias("type"), whole(v).alias("total"), F.concat(F.lit("f"), k.cast("string")).alias("name"), status.alias("status"),
        (k % 3 == 0).alias("vision_would_help"), whole(v).alias("imported"), whole(v * 2).alias("needs_review"), (k % 5).alias("duplicates"), (k % 7).alias("failed"),
    )


@query(f"WITH {_EVENTS}")
def import_progress(spark, sf_dir):
    return ingest.progress(_events(spark, sf_dir))


@query(f"WITH {_EVENTS}")
def import_progress_stream(spark, sf_dir):
    base = scratch(spark, "progress")
    own = _events(spark, sf_dir)
    n = own.agg(F.max("seq")).first()[0] or 0
    store = progress.progress_table(spark, f"{base}/store")
    # four slices in order, the second of them comes again at the end; a slice is a batch, of as many files as it has tasks
    for part in (0, 1, 2, 3, 1):
        own.where((F.col("seq") > n * part // 4 - (part == 0)) & (F.col("seq") <= n * (part + 1) // 4)).write.mode("append").parquet(f"{base}/events")
        progress.follow(progress.watch_events(spark, f"{base}/events", 1_000_000), store, f"{base}/checkpoint").awaitTermination()
    return store.tables["progress"].read()


# --- counts, search, rules and saves at scale ------------------------------------------------------

#: Three states of the ledger: the even orders; all of them, every tenth fourth one without a key; then without every seventh, those keys back where 3 divides the id, one category renamed.
_STATES = f"""{LEDGER}, {BRIDGE}, base AS (SELECT *, id % 10 = 4 AS moved FROM ledger),
  s1 AS (SELECT 1 AS step, * FROM base WHERE id % 2 = 0),
  s2 AS (SELECT 2 AS step, * REPLACE (CASE WHEN moved THEN '' ELSE dedup_key END AS dedup_key, CASE WHEN moved THEN total_cents + 1 ELSE total_cents END AS total_cents) FROM base),
  s3 AS (SELECT 3 AS step, * EXCLUDE (step) REPLACE (CASE WHEN moved AND id % 3 = 0 THEN (SELECT any_value(b.dedup_key) FROM base b WHERE b.id = s2.id) ELSE dedup_key END AS dedup_key, CASE WHEN category_s = '餐饮' THEN '会议' ELSE category_s END AS category_s)
    FROM s2 WHERE id % 7 <> 0),
  states AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)"""
_COUNTED_ROW = "id bigint, dedup_key string, category_s string, total_cents bigint, tax_cents bigint, reviewed boolean, min_confidence double, issue_count bigint"


def _counted(spark: SparkSession, sf_dir: str, after=None) -> counts.Counts:
    """The ledger's counts after three change sets; ``after`` sees them after each."""
    store = Store(spark, scratch(spark, "counts"))
    row = T.StructType.fromDDL(_COUNTED_ROW)
    store.table("invoices", row, ["id"], children={"report_invoices": "invoice_id"})
    store.table("report_invoices", REPORT_INVOICE, ["report_id", "invoice_id"], "invoice_id")
    own, lines = counts.Counts(store), materialize(A.bridge(spark, sf_dir))
    base = materialize(A.ledger(spark, sf_dir).select(*row.names))
    moved = F.col("id") % 10 == 4
    second = base.withColumns({"dedup_key": F.when(moved, "").otherwise(F.col("dedup_key")), "total_cents": F.when(moved, F.col("total_cents") + 1).otherwise(F.col("total_cents"))})
    renamed = F.when(F.col("category_s") == "餐饮", "会议").otherwise(F.col("category_s"))
    third = base.withColumns({"dedup_key": F.when(moved & (F.col("id") % 3 != 0), "").otherwise(F.col("dedup_key")), "total_cents": F.when(moved, F.col("total_cents") + 1).otherwise(F.col("total_cents")), "category_s": renamed})
    sets = [
        {"invoices": upserts(base.where("id % 2 = 0")), "report_invoices": upserts(lines.where("invoice_id % 2 = 0"))},
        {"invoices": upserts(second.where("id % 2 = 1").unionByName(second.where(moved))), "report_invoices": upserts(lines.where("invoice_id % 2 = 1"))},
        {"invoices": upserts(third.where((moved & (F.col("id") % 3 == 0)) | (F.col("category_s") == "会议"))).unionByName(deletes(base.where("id % 7 = 0").select("id"), 1), allowMissingColumns=True)},
    ]
    for k, changes in enumerate(sets, 1):
        store.apply(changes)
        if after:
            after(k, own)
    return own


@query(
    f"""WITH {_STATES} SELECT step, count(*) AS "all", count(*) FILTER (NOT reviewed AND (min_confidence < 0.9::DOUBLE OR issue_count > 0)) AS review,
    (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM states t WHERE t.step = s.step AND dedup_key <> '' GROUP BY dedup_key) WHERE n > 1) AS duplicates, sum(total_cents)::BIGINT AS total_cents FROM states s GROUP BY step"""
)
def counts_followed(spark, sf_dir):
    seen: list[DataFrame] = []
    _counted(spark, sf_dir, lambda k, own: seen.append(materialize(own.sidebar().withColumn("step", F.lit(k)))))
    return seen[0].unionByName(seen[1]).unionByName(seen[2])


@query(f"WITH {_STATES} SELECT category_s, count(*) AS n, sum(total_cents)::BIGINT AS total_cents, sum(tax_cents)::BIGINT AS tax_cents FROM s3 GROUP BY 1")
def category_counts_followed(spark, sf_dir):
    return _counted(spark, sf_dir).categories.read()


@query(f"WITH {_STATES} SELECT report_id, count(*) AS n, sum(total_cents)::BIGINT AS total_cents FROM bridge JOIN s3 ON id = invoice_id GROUP BY 1")
def report_counts_followed(spark, sf_dir):
    return _counted(spark, sf_dir).reports.read()


_NEEDLES = ["R#00000_12", "customer#000001", "7", " BUILD ", "9%31", "0000000000_5", "no such", "机"]


@query(
    "WITH " + LEDGER + ", needles AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in _NEEDLES) + "]) AS needle), p AS (SELECT needle, '%' || lower(trim(needle)) || '%' AS w FROM needles) "
    "SELECT needle, id FROM p JOIN ledger ON lower(number_s) LIKE w OR lower(seller_s) LIKE w OR lower(buyer_s) LIKE w"
)
def search_postings(spark, sf_dir):
    store = Store(spark, scratch(spark, "search"))
    index, rows = search.posting_table(store), materialize(A.ledger(spark, sf_dir).select("id", *search.COLUMNS))
    index.apply(upserts(search.postings(rows)))
    found = [search.search(rows, index, n).select(F.lit(n).alias("needle"), "id") for n in _NEEDLES]
    return functools.reduce(DataFrame.unionByName, found)


_RULES_SQL = f"""rules AS (SELECT min(p_partkey) AS rid, p_name AS a, p_brand AS b, '*' || {A._sql_case("p_type", A.TYPES, "")} || '*' AS c FROM part GROUP BY ALL)"""


def _part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every name, brand and type of parts: some thousands."""
    kind = F.concat(F.lit("*"), A._case(F.col("p_type"), A.TYPES, ""), F.lit("*"))
    own = table(spark, sf_dir, "part").groupBy("p_name", "p_brand", kind.alias("kind")).agg(F.min("p_partkey").alias("id"))
    condition = lambda field, word: F.struct(F.lit(field).alias("field"), F.array(word).alias("keywords"))
    return own.select(
        F.col("id").cast("long").alias("id"), F.concat(F.lit("R"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("C"), (F.col("id") % 50).cast("string")).alias("category"),
        (F.col("id") % 7).cast("int").alias("priority"), F.lit(True).alias("enabled"), F.array(condition("itemName", "p_name"), condition("sellerName", "p_brand"), condition("itemName", "kind")).alias("conditions"),
    )


@query(
    f"""WITH {INVOICES}, {_RULES_SQL}, m AS (SELECT id, rid FROM inv JOIN rules ON contains(item, a) AND contains(seller, b) AND contains(item, c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY rid % 7 DESC, rid) = 1)
    SELECT id, 'C' || (rid % 50) AS category, 'R' || rid AS rule FROM inv LEFT JOIN m USING (id)"""
)
def classify_many_rules(spark, sf_dir):
    return classify.classify(A.invoices(spark, sf_dir), _part_rules(spark, sf_dir)).select("id", "category", F.col("category_rule").alias("rule"))


@query(
    """WITH h AS (SELECT p_partkey AS k, sha256(p_partkey::VARCHAR) AS file_hash, '/in/' || p_partkey AS path FROM part), n AS (SELECT count(*) FILTER (k % 2 = 0) AS n FROM h)
    SELECT file_hash, row_number() OVER (PARTITION BY k % 2 ORDER BY path, file_hash) + CASE WHEN k % 2 = 0 THEN 0 ELSE (SELECT n FROM n) END AS id, k % 2 <> 0 AS inserted FROM h"""
)
def save_invoices(spark, sf_dir):
    ws = Workspace(spark, scratch(spark, "workspace"))
    rows = A.invoices(spark, sf_dir)
    ws.ledger.save(rows.where("id % 2 = 0"), ("query", 0))
    ws.ledger.save(rows.where("id % 2 = 0"), ("query", 0))
    again = rows.withColumn("source_path", F.concat(F.lit("/in2/"), F.col("id").cast("string")))
    return ws.ledger.save(rows.unionByName(again), ("query", 1))


# --- versions --------------------------------------------------------------------------------------


def _reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' invoices as another reading: better, worse and equal sources, some values gone."""
    k, own = F.col("id"), A.invoices(spark, sf_dir)
    return own.withColumns({
        "number": fields.make_field(F.when(k % 3 == 0, F.lpad((k + 1).cast("string"), 20, "0")), "xml"),
        "issued_on": fields.make_field(F.when(k % 5 != 0, F.lit("2024-02-01")), "qrCode"),
        "tax": fields.make_field(F.when(k % 9 != 0, k), "pdfText"),
        "total": fields.make_field(F.when(k % 8 != 0, k * 2), "vision", F.when(k % 2 == 0, 0.5).otherwise(0.875)),
        "items": F.array().cast(own.schema["items"].dataType),
        "seller_name": fields.make_field(F.lit("新读"), "manual"),
    })


_WON = "CASE WHEN {o} IS NULL AND {n} IS NULL THEN 'old none' WHEN {o} IS NULL THEN 'new only' WHEN {n} IS NULL THEN 'old only' ELSE {both} END"
_DECIDED = {
    "number": ("number", "CASE WHEN id % 3 = 0 THEN 1 END", "'new rank'"), "issued_on": ("issued_on", "CASE WHEN id % 5 <> 0 THEN 1 END", "'old rank'"), "tax": ("tax", "CASE WHEN id % 9 <> 0 THEN 1 END", "'old tie'"),
    "total": ("total", "CASE WHEN id % 8 <> 0 THEN 1 END", "CASE WHEN id % 2 = 0 THEN 'old confidence' ELSE 'new confidence' END"), "seller_name": ("seller", "1", "'new rank'"), "amount_excl_tax": ("net", "net", "'old tie'"), "remark": ("NULL", "NULL", "''"),
}


@query(
    f"WITH {INVOICES} " + " UNION ALL ".join(f"SELECT id, '{f}' AS field, split_part(d, ' ', 1) AS won, split_part(d, ' ', 2) AS why FROM (SELECT id, {_WON.format(o=o, n=n, both=b)} AS d FROM inv)" for f, (o, n, b) in _DECIDED.items())
)
def rescan_decisions(spark, sf_dir):
    merged = versions.merge_versions(A.invoices(spark, sf_dir), _reread(spark, sf_dir), TODAY)
    return merged.select("id", F.inline("decisions")).where(F.col("field").isin(*_DECIDED))


@query(
    f"""WITH {INVOICES}, m AS (SELECT id, net, CASE WHEN id % 3 = 0 THEN lpad((id + 1)::VARCHAR, 20, '0') ELSE number END AS number, coalesce(issued_on, CASE WHEN id % 5 <> 0 THEN '2024-02-01' END) AS issued_on,
    coalesce(tax, CASE WHEN id % 9 <> 0 THEN id END) AS tax, CASE WHEN id % 8 <> 0 AND (id % 2 = 1 OR total IS NULL) THEN id * 2 ELSE total END AS total FROM inv),
    d AS (SELECT id, number, issued_on, CASE WHEN net IS NULL THEN total - tax ELSE net END AS net, CASE WHEN tax IS NULL THEN total - net ELSE tax END AS tax, CASE WHEN total IS NULL THEN net + tax ELSE total END AS total FROM m)
    SELECT id, number, issued_on, net, tax, total, (CASE WHEN net + tax <> total THEN 1 ELSE 0 END) + (CASE WHEN number IS NULL THEN 1 ELSE 0 END) + (CASE WHEN issued_on IS NULL THEN 1 ELSE 0 END) + (CASE WHEN total IS NULL THEN 1 ELSE 0 END) AS issues, true AS changed FROM d"""
)
def rescan_merged(spark, sf_dir):
    merged = versions.merge_versions(A.invoices(spark, sf_dir), _reread(spark, sf_dir), TODAY)
    value = lambda n, to: F.col(f"{n}.value").alias(to)
    return merged.select("id", value("number", "number"), value("issued_on", "issued_on"), value("amount_excl_tax", "net"), value("tax", "tax"), value("total", "total"), F.size("issues").alias("issues"), "changed")


# --- every shape of an input -----------------------------------------------------------------------

#: Invoices of four kinds whose numbers are right, short, long or missing, with dates that are real, impossible, to come or missing, and sums that don't add up.
_ODD = """odd AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'digitalSpecial' WHEN 1 THEN 'vatSpecial' WHEN 2 THEN 'train' END AS kind,
  CASE o_orderkey % 6 WHEN 0 THEN lpad(o_custkey::VARCHAR, 20, '0') WHEN 1 THEN lpad(o_custkey::VARCHAR, 8, '0') WHEN 2 THEN '1234567' WHEN 3 THEN '号码12345678' WHEN 4 THEN '' END AS number,
  CASE o_orderkey % 9 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '2024-13-45' WHEN 2 THEN '2024-02-30' WHEN 3 THEN '2031-01-01' WHEN 4 THEN '2024/01/05' WHEN 5 THEN '2023-02-29' WHEN 6 THEN '' WHEN 7 THEN '2024-3-5' END AS issued_on,
  CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice * 100)::BIGINT END AS net, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS tax,
  CASE WHEN o_orderkey % 8 <> 0 THEN round(o_totalprice * 100)::BIGINT + o_custkey - o_orderkey % 3 END AS total FROM orders),
  days AS (SELECT *, CASE WHEN regexp_full_match(issued_on, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}') THEN try_strptime(issued_on, '%Y-%-m-%-d')::DATE END AS day, CASE kind WHEN 'digitalSpecial' THEN 20 WHEN 'vatSpecial' THEN 8 END AS wanted, strlen(number) AS size FROM odd)"""


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    pick = lambda n, table_: F.coalesce(*[F.when(k % n == m, v if isinstance(v, Column) else F.lit(v)) for m, v in table_.items()])
    cust = F.col("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), pick(4, {0: "digitalSpecial", 1: "vatSpecial", 2: "train"}).alias("kind"),
        pick(6, {0: F.lpad(cust, 20, "0"), 1: F.lpad(cust, 8, "0"), 2: "1234567", 3: "号码12345678", 4: ""}).alias("number"),
        pick(9, {0: F.date_format("o_orderdate", "yyyy-MM-dd"), 1: "2024-13-45", 2: "2024-02-30", 3: "2031-01-01", 4: "2024/01/05", 5: "2023-02-29", 6: "", 7: "2024-3-5"}).alias("issued_on"),
        F.when(k % 5 != 0, cents).alias("net"), F.when(k % 7 != 0, F.col("o_custkey")).alias("tax"), F.when(k % 8 != 0, cents + F.col("o_custkey") - k % 3).alias("total"),
    )


_YEN = "CASE WHEN {0} < 0 THEN '-¥' ELSE '¥' END || (abs({0}) // 100)::VARCHAR || '.' || lpad((abs({0}) % 100)::VARCHAR, 2, '0')"


@query(
    f"""WITH {_ODD}, i AS (SELECT id, unnest(list_filter([
      CASE WHEN net + tax <> total THEN {{'e': true, 'kind': 'totalMismatch', 'message': '价税合计对不上：金额+税额=' || {_YEN.format("(net + tax)")} || '，票面=' || {_YEN.format("total")}}} END,
      CASE WHEN number IS NULL THEN {{'e': false, 'kind': 'missingField', 'message': '缺少发票号码'}} END, CASE WHEN issued_on IS NULL THEN {{'e': false, 'kind': 'missingField', 'message': '缺少开票日期'}} END,
      CASE WHEN total IS NULL THEN {{'e': false, 'kind': 'missingField', 'message': '缺少价税合计'}} END,
      CASE WHEN size <> wanted THEN {{'e': false, 'kind': 'numberLength', 'message': '发票号码位数异常：' || size || ' 位，应为 ' || wanted || ' 位'}} END,
      CASE WHEN issued_on IS NOT NULL AND day IS NULL THEN {{'e': true, 'kind': 'badDate', 'message': '开票日期无法识别：' || issued_on}}
        WHEN day > DATE '2024-03-15' THEN {{'e': false, 'kind': 'futureDate', 'message': '开票日期晚于今天：' || issued_on}} END], lambda x: x IS NOT NULL)) AS i FROM days)
    SELECT id, i.kind AS kind, i.message AS message, i.e AS is_error FROM i"""
)
def all_issues(spark, sf_dir):
    rows = _odd(spark, sf_dir)
    issues = validate.check(TODAY, *(F.col(c) for c in ("kind", "number", "issued_on", "net", "tax", "total")))
    return rows.select("id", F.explode(issues).alias("i")).select("id", "i.kind", prose.issue_message(F.col("i")).alias("message"), prose.is_error(F.col("i")).alias("is_error"))


@query(f"WITH {INVOICES} SELECT id, {A.RULE_CATEGORY} AS category, {A._rule_case(lambda at, _: f"(SELECT name FROM names WHERE spot = {at})")} AS rule FROM inv".replace(f"WITH {INVOICES}", f"WITH names AS (SELECT spot, CASE field {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in classify.MATCH_FIELDS.items())} END || '：' || words AS name FROM (VALUES {', '.join(f"({k}, '{f}', '{'、'.join(w)}')" for k, (_, _, f, w) in enumerate(classify.SEEDS))}) AS v(spot, field, words)), {INVOICES}", 1))
def classify_rule_names(spark, sf_dir):
    return classify.classify(A.invoices(spark, sf_dir), _seeds(spark)).select("id", "category", F.col("category_rule").alias("rule"))


_MAGIC = {0: ("25504446", "pdf"), 1: ("89504E470D0A1A0A", "image"), 2: ("FFD8FF", "image"), 3: ("EFBBBF3C3F786D6C", "xml"), 4: ("3C45496E766F696365", "xml"), 5: ("52494646", "unknown"), 6: ("4749463839", "unknown"), 7: ("", "unknown"), 8: ("504B0304", "zip"), 9: ("424D", "image"), 10: ("4D4D002A", "image")}
_TAILS = {0: ("", ""), 1: (".PDF", "pdf"), 2: (".jpeg", "image"), 3: (".ofd", "ofd"), 4: (".xml.txt", "")}


@query(
    f"""WITH p AS (SELECT page_id, CASE page_id % 11 {' '.join(f"WHEN {k} THEN '{v}'" for k, (_, v) in _MAGIC.items())} END AS found, CASE page_id % 5 {' '.join(f"WHEN {k} THEN '{v}'" for k, (_, v) in _TAILS.items())} END AS ending FROM pages),
    k AS (SELECT page_id, CASE WHEN found = 'unknown' AND ending <> '' THEN ending ELSE found END AS file_kind FROM p)
    SELECT page_id, file_kind, CASE file_kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FILE_KINDS.items())} END AS label FROM k"""
)
def detect_magic(spark, sf_dir):
    """Pages behind the first bytes of files: known ones decide, others leave it to the ending."""
    k = F.col("page_id")
    head = F.unhex(F.coalesce(*[F.when(k % 11 == m, F.lit(h)) for m, (h, _) in _MAGIC.items()]))
    path = F.concat(F.lit("/in/"), k.cast("string"), F.coalesce(*[F.when(k % 5 == m, F.lit(e)) for m, (e, _) in _TAILS.items()]))
    rows = table(spark, sf_dir, "pages").select("page_id", files.detect(F.concat(head, F.lit(" ").cast("binary"), F.col("html").cast("binary")), path).alias("file_kind"))
    return rows.select("page_id", "file_kind", F.coalesce(*[F.when(F.col("file_kind") == k, F.lit(v)) for k, v in FILE_KINDS.items()]).alias("label"))


# --- rules made from the parts ---------------------------------------------------------------------

_PART_RULES = f"{_RULES_SQL}, pr AS (SELECT rid AS id, 'C' || (rid % 50) AS category, rid % 7 AS priority, rid % 3 <> 0 AS enabled, a, b, c FROM rules)"


def _switched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_rules(spark, sf_dir).withColumn("enabled", F.col("id") % 3 != 0)


@query(f"WITH {_PART_RULES} SELECT DISTINCT category FROM pr UNION SELECT '{UNCATEGORISED}'")
def part_rule_categories(spark, sf_dir):
    return classify.rule_categories(_switched(spark, sf_dir))


@query(f"WITH {_PART_RULES} SELECT count(*) FILTER (NOT enabled) AS disabled FROM pr")
def part_rules_disabled(spark, sf_dir):
    return classify.disabled_count(_switched(spark, sf_dir))


@query(f"WITH {_PART_RULES} SELECT category, string_agg(id::VARCHAR, ',' ORDER BY priority DESC, id) AS ids FROM pr GROUP BY 1")
def part_rule_groups(spark, sf_dir):
    return classify.group_by_category(_switched(spark, sf_dir)).select("category", joined(F.transform("rules", lambda r: r["id"])).alias("ids"))


@query(f"WITH {_PART_RULES} SELECT row_number() OVER (ORDER BY priority DESC, id) - 1 AS position, id FROM pr")
def part_rules_ordered(spark, sf_dir):
    return ordering.positions(_switched(spark, sf_dir).select("id", "priority"), [F.desc("priority"), F.asc_nulls_last("id")]).select("position", "id")


@query(f"WITH {_PART_RULES} SELECT id, '项目名称 包含 ' || a || ' 并且 销售方名称 包含 ' || b || ' 并且 项目名称 包含 ' || c AS described, '项目名称：' || a || ' 等 3 项条件' AS name, id % 2 = 0 AS auto FROM pr")
def part_rule_prose(spark, sf_dir):
    own = _switched(spark, sf_dir)
    name = prose.default_rule_name(F.col("conditions"))
    typed = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), name, F.lit("\u3000"))).otherwise(F.col("name"))
    return own.select("id", prose.describe_rule(F.col("conditions")).alias("described"), name.alias("name"), prose.is_auto_name(typed, F.col("conditions")).alias("auto"))


@query(f"WITH {_PART_RULES} SELECT id FROM pr WHERE id % 4 = 0")
def part_rules_missing(spark, sf_dir):
    own = _part_rules(spark, sf_dir)
    left = own.where("id % 4 <> 0").withColumn("priority", F.col("priority") + 1)  # another priority is still the same rule
    return classify.missing_defaults(own, left).select("id")


_BAND_SQL = " ".join([f"WHEN v > 200 THEN '高于全部内置规则（最高 200），会盖过更可靠的税收分类简称规则'"] + [f"WHEN v = {v} THEN '与内置的「{a}」同档：{h}'" for v, a, h in prose.BANDS] + [f"WHEN v < {a[0]} AND v > {b[0]} THEN '介于「{b[1]}」({b[0]}) 和「{a[1]}」({a[0]}) 之间'" for a, b in zip(prose.BANDS, prose.BANDS[1:])])


@query(f"SELECT id, CASE {_BAND_SQL} ELSE '低于全部内置规则，只有在没有别的规则命中时才轮得到它' END AS note, v > 200 AS warn FROM (SELECT p_partkey AS id, p_partkey % 250 AS v FROM part)")
def priority_notes_whole(spark, sf_dir):
    note = prose.priority_note(F.col("v"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 250).alias("v")).select("id", note["text"].alias("note"), note["warn"].alias("warn"))


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN '请先选择或填写费用类别' WHEN p_partkey % 7 = 0 THEN '至少要有一个条件：没有条件的规则会匹配所有发票，因此会被直接忽略'
    WHEN p_partkey % 3 = 0 THEN '每个条件都要至少填一个关键词，否则这条规则永远不会命中' WHEN p_partkey % 2 = 1 THEN '优先级必须是整数' END AS problem FROM part"""
)
def rule_drafts(spark, sf_dir):
    k = F.col("p_partkey")
    blank = F.array().cast("array<string>")
    condition = F.struct(F.lit("itemName").alias("field"), F.when(k % 3 == 0, blank).otherwise(F.array("p_name")).alias("keywords"))
    conditions = F.when(k % 7 == 0, F.array().cast("array<struct<field: string, keywords: array<string>>>")).otherwise(F.array(condition))
    problem = prose.validate_draft(F.when(k % 5 == 0, F.lit(" \u3000")).otherwise(F.col("p_type")), conditions, k / 2)
    return table(spark, sf_dir, "part").select(k.alias("id"), problem.alias("problem"))


@query(f"WITH {LEDGER}, {BRIDGE}, {_KEYS} SELECT l.id, number_s AS number FROM ledger l WHERE number_s IN (SELECT number_s FROM bridge JOIN ledger m ON m.id = invoice_id JOIN keys USING (dedup_key) WHERE report_id = 6 AND len(ids) > 1)")
def picked_duplicates(spark, sf_dir):
    rows = A.ledger(spark, sf_dir)
    named = reports.duplicates_of_report(reports.report_invoices(A.bridge(spark, sf_dir), rows, 6), rows)
    return reports.picked_duplicates(rows.select("id", F.col("number_s").alias("number")), named)


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, c_name, round(o_totalprice * 100)::BIGINT AS cents, o_orderkey % 11 <> 0 AS there FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT k AS id, CASE WHEN there THEN CASE k % 5 WHEN 0 THEN lpad(k::VARCHAR, 20, '0') WHEN 1 THEN lpad(c::VARCHAR, 8, '0') END END AS number,
    CASE WHEN there THEN CASE k % 4 WHEN 0 THEN lpad(k::VARCHAR, 10, '0') WHEN 1 THEN lpad(k::VARCHAR, 12, '0') END END AS code, CASE WHEN there AND k % 3 = 0 THEN lpad(k::VARCHAR, 20, '0') END AS check_code,
    CASE WHEN there AND k % 7 < 3 THEN '2023-08-' || lpad((k % 28 + 1)::VARCHAR, 2, '0') END AS issued_on, CASE WHEN there THEN replace(c_name, ' ', '') END AS buyer, CASE WHEN there THEN '销方' || k END AS seller,
    CASE WHEN there THEN '91310115MA1K3X' || lpad((c % 10000)::VARCHAR, 4, '0') END AS buyer_id, CASE WHEN there AND k % 2 = 1 THEN '9131' || lpad(k::VARCHAR, 16, '0') END AS seller_id,
    CASE WHEN there AND k % 4 <> 3 THEN cents END AS net, CASE WHEN there AND k % 4 <> 3 THEN c + 1000 END AS tax, CASE WHEN there AND k % 3 < 2 THEN cents END AS total,
    (CASE WHEN NOT there OR k % 3 = 2 THEN 0 WHEN k % 3 = 0 THEN 0.9::FLOAT ELSE 0.8::FLOAT END)::DOUBLE AS total_confidence FROM o"""
)
def text_shapes(spark, sf_dir):
    """Every label in its right, wrong and missing forms, parties in either order or unmarked, pages that are null."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    text_of = lambda x, n=0: F.lpad(x.cast("string"), n, "0") if n else x.cast("string")
    line = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("\n"))
    pick = lambda n, *forms: functools.reduce(lambda out, m: out.when(k % n == m, forms[m]), range(1, len(forms)), F.when(k % n == 0, forms[0])).otherwise("")
    amount = lambda x: F.replace(money.format_money(x), F.lit("¥"), F.lit(""))
    cents, day, long_ = F.round(F.col("o_totalprice") * 100).cast("long"), text_of(k % 28 + 1), text_of(k, 20)
    number = pick(5, line("发票号码：", long_), line("发 票 号 码 :", F.regexp_replace(text_of(cust, 8), "(..)", "$1 ")), line("发票号码：", text_of(k, 9)), line("发票号码：未知"))
    code = pick(4, line("发票代码：", text_of(k, 10)), line("发票代码 ", text_of(k, 12)), line("发票代码:", text_of(k, 11)))
    check = pick(3, line("校 验 码 ", F.regexp_replace(long_, "(.{5})", "$1 ")), line("校验码:", text_of(k, 19)))
    date = pick(
        7, line("开票日期：2023 年 8 月 ", day, "日"), line("开票日期: 2023-08-", day), line("开票日期：2023/8/", day), line("开票日期：2023年13月1日"), line("开票日期：2023年8月32日"), F.lit(""), line("开票日期：", day, ".8.2023")
    )
    buyer_id = F.concat(F.lit("91310115MA1K3X"), text_of(cust % 10000, 4))
    seller_id = F.when(k % 2 == 1, F.concat(F.lit("9131"), text_of(k, 16))).otherwise("91310115MA1K3X")
    buyer = lambda mark: line(mark, "名称：", F.col("c_name"), "\n纳税人识别号：", buyer_id, "\n地址：一")
    seller = lambda mark: line(mark, "名 称：销方", text_of(k), "\n统一社会信用代码/纳税人识别号：", seller_id, "\n开户行：二")
    parties = pick(3, F.concat(buyer("购买方 "), seller("销售方信息 ")), F.concat(seller("销售方 "), buyer("购买方信息 ")), F.concat(buyer(""), seller("")))
    sums = F.when(k % 4 == 3, line("合计 ¥", text_of(cust), ".5 ¥1.00")).otherwise(line("合 计 ￥", amount(cents), " ￥ ", amount(cust + 1000)))
    total = pick(3, line("价税合计（大写）壹圆整 （小写）￥", amount(cents)), line("价 税 合 计： ￥ ", amount(cents)))
    page = F.when(k % 11 != 0, F.concat(number, code, check, date, parties, sums, total))
    pages, p = text.parse_text(o.join(c, o["o_custkey"] == c["c_custkey"]).withColumn("page", page), F.col("page"))
    names = {"number": "number", "code": "code", "check_code": "check_code", "issued_on": "issued_on", "buyer": "buyer_name", "seller": "seller_name", "buyer_id": "buyer_tax_id", "seller_id": "seller_tax_id", "net": "amount_excl_tax", "tax": "tax", "total": "total"}
    return pages.select(k.alias("id"), *[p[n]["value"].alias(to) for to, n in names.items()], p["total"]["confidence"].cast("double").alias("total_confidence"))


_CODES = [*kinds.QR_CODES, "99", ""]


@query(
    f"""WITH q AS (SELECT o_orderkey AS id, o_orderkey % {len(_CODES)} AS c, o_orderkey % 8 AS s, round(o_totalprice * 100)::BIGINT AS cents FROM orders)
    SELECT id, CASE WHEN s IN (0, 1, 2, 3) THEN lpad(id::VARCHAR, 20, '0') END AS number, CASE WHEN s IN (0, 3) THEN '2023-08-' || lpad((id % 28 + 1)::VARCHAR, 2, '0') END AS issued_on,
    CASE WHEN s IN (0, 2, 3) THEN cents END AS amount_cents, CASE WHEN s < 4 THEN CASE c {' '.join(f"WHEN {k} THEN '{kinds.QR_CODES[c]}'" for k, c in enumerate(_CODES) if c in kinds.QR_CODES)} END END AS kind FROM q"""
)
def qr_shapes(spark, sf_dir):
    """Payloads of every kind code: whole, with a bad date or amount, cut short, of another version, not of this kind, blank and null."""
    k = F.col("o_orderkey")
    code = F.get(F.array(*map(F.lit, _CODES)), (k % len(_CODES)).cast("int"))
    number, day = F.lpad(k.cast("string"), 20, "0"), F.lpad((k % 28 + 1).cast("string"), 2, "0")
    amount = money.to_decimal_string(F.round(F.col("o_totalprice") * 100).cast("long"))
    listed = lambda money_, date: F.concat_ws(",", F.lit("01"), code, F.lit(""), number, money_, date, F.lit(""), F.lit("AB12"), F.lit(""))
    whole = F.concat(F.lit("202308"), day)
    payload = (
        F.when(k % 8 == 0, listed(amount, whole)).when(k % 8 == 1, listed(F.lit("abc"), F.lit("20231345"))).when(k % 8 == 2, listed(amount, F.lit(""))).when(k % 8 == 3, listed(F.concat(F.lit(" "), amount), whole))
        .when(k % 8 == 4, F.lit("just text, with a comma")).when(k % 8 == 5, F.lit("")).when(k % 8 == 6, F.lit("https://example.invalid/?a=1&b=2"))
    )
    read = qr.with_reading(table(spark, sf_dir, "orders").select("o_orderkey", payload.alias("payload")), F.col("payload"), "q")
    return read.select(k.alias("id"), *[F.col("q")[n].alias(n) for n in ("number", "issued_on", "amount_cents", "kind")])
