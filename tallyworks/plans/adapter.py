"""The driver's tables seen as a ledger, in Spark and, word for word, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import empty_field, make_field
from ..operators.classify import SEEDS
from ..operators.ledger import dedup_key
from ..schema import ITEM, KINDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Order status -> kind; order priority -> category.
STATUS_KINDS = {"F": "digitalSpecial", "O": "digitalGeneral", "P": "vatSpecial"}
CATEGORIES = {"1": "住宿", "2": "餐饮", "3": "市内交通", "5": "油费"}


def _case(value, table_: dict, other):
    return F.coalesce(*[F.when(value == k, F.lit(v)) for k, v in table_.items()], F.lit(other))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat ledger rows: orders as invoices, customers as sellers. Every 97th order has no date; keys repeat per customer and priority."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("o_orderkey")
    p = F.substring("o_orderpriority", 1, 1)
    rows = o.join(c, o["o_custkey"] == c["c_custkey"], "left")
    number, code = F.lpad(F.col("o_custkey").cast("string"), 20, "0"), p
    return rows.select(
        k.alias("id"),
        _case(F.col("o_orderstatus"), STATUS_KINDS, "other").alias("kind"),
        number.alias("number_s"),
        code.alias("code_s"),
        F.when(k % 11 == 0, "").otherwise(dedup_key(code, number)).alias("dedup_key"),
        F.when(k % 97 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("issued_on_s"),
        _case(F.col("o_orderstatus"), {s: KINDS[v] for s, v in STATUS_KINDS.items()}, KINDS["other"]).alias("kind_label"),
        F.coalesce("c_name", F.lit("")).alias("seller_s"),
        F.coalesce("c_mktsegment", F.lit("")).alias("buyer_s"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("total_cents"),
        F.round(F.col("o_totalprice") * 6).cast("long").alias("tax_cents"),
        _case(p, CATEGORIES, "").alias("category_s"),
        F.when(k % 2 == 0, "规则").otherwise("").alias("category_rule_s"),
        _case(k % 4, {0: 0.75, 1: 0.9, 2: 0.95}, 1.0).cast("float").cast("double").alias("min_confidence"),
        F.when(k % 5 == 0, 1).otherwise(0).cast("long").alias("issue_count"),
        (k % 3 == 0).alias("reviewed"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("imported_at"),
    )


def _sql_case(value: str, table_: dict, other: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE '{other}' END"


LEDGER = f"""ledger AS (
  SELECT o_orderkey AS id, {_sql_case("o_orderstatus", STATUS_KINDS, "other")} AS kind, lpad(o_custkey::VARCHAR, 20, '0') AS number_s,
    substr(o_orderpriority, 1, 1) AS code_s,
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE substr(o_orderpriority, 1, 1) || '-' || lpad(o_custkey::VARCHAR, 20, '0') END AS dedup_key,
    CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS issued_on_s,
    {_sql_case("o_orderstatus", {s: KINDS[v] for s, v in STATUS_KINDS.items()}, KINDS["other"])} AS kind_label,
    coalesce(c_name, '') AS seller_s, coalesce(c_mktsegment, '') AS buyer_s,
    round(o_totalprice * 100)::BIGINT AS total_cents, round(o_totalprice * 6)::BIGINT AS tax_cents,
    {_sql_case("substr(o_orderpriority, 1, 1)", CATEGORIES, "")} AS category_s,
    CASE WHEN o_orderkey % 2 = 0 THEN '规则' ELSE '' END AS category_rule_s,
    (CASE o_orderkey % 4 WHEN 0 THEN 0.75 WHEN 1 THEN 0.9 WHEN 2 THEN 0.95 ELSE 1.0 END)::FLOAT::DOUBLE AS min_confidence,
    (CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS issue_count, o_orderkey % 3 = 0 AS reviewed,
    strftime(o_orderdate, '%Y-%m-%d') AS imported_at
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
)"""


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports hold orders: an order is on the report of its customer's nation, in key order."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("c_nationkey").cast("long").alias("report_id"), F.col("o_orderkey").alias("invoice_id"), F.col("o_orderkey").cast("int").alias("position")
    )


BRIDGE = """bridge AS (
  SELECT c_nationkey::BIGINT AS report_id, o_orderkey AS invoice_id, o_orderkey::INT AS position FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as reports, and one more without invoices for every region."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    a = n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("title"), F.format_string("2024-01-%02d", F.col("n_nationkey") + 1).alias("created_at"))
    b = r.select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.col("r_name").alias("title"), F.lit("2023-12-31").alias("created_at"))
    return a.unionByName(b)


REPORTS = """reports AS (
  SELECT n_nationkey::BIGINT AS id, n_name AS title, '2024-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') AS created_at FROM nation
  UNION ALL SELECT (r_regionkey + 1000)::BIGINT, r_name, '2023-12-31' FROM region
)"""


#: Part type -> tax category.
TYPES = {"ECONOMY": "住宿服务", "LARGE": "餐饮服务", "MEDIUM": "办公用品", "PROMO": "电信服务", "SMALL": "汽油", "STANDARD": " "}


def item_name():
    return F.concat(F.lit("*"), _case(F.col("p_type"), TYPES, ""), F.lit("*"), F.col("p_name"))


ITEM_NAME = f"'*' || {_sql_case('p_type', TYPES, '')} || '*' || p_name"


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested invoice rows: one per part, with an item, a seller and amounts of which some are missing."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    item = F.struct(*[item_name().alias("name") if f.name == "name" else F.lit(None).cast(f.dataType).alias(f.name) for f in ITEM.fields])
    blank = empty_field()
    return p.select(
        k.alias("id"),
        _case(k % 3, {0: "digitalSpecial", 1: "digitalGeneral"}, "train").alias("kind"),
        make_field(F.when(k % 7 != 0, F.lpad(k.cast("string"), 20, "0")), "pdfText").alias("number"),
        blank.alias("code"),
        make_field(F.when(k % 13 != 0, F.lit("2024-03-01")), "xml").alias("issued_on"),
        blank.alias("check_code"),
        blank.alias("buyer_name"),
        blank.alias("buyer_tax_id"),
        make_field(F.concat(F.col("p_brand"), F.when(k % 2 == 0, "酒店").otherwise("航空")), "xml").alias("seller_name"),
        blank.alias("seller_tax_id"),
        make_field(F.when(k % 5 != 0, cents), "xml").alias("amount_excl_tax"),
        make_field(F.when(k % 4 != 0, F.floor(cents / 10).cast("long")), "pdfText").alias("tax"),
        make_field(F.when(k % 6 != 0, cents + F.floor(cents / 10).cast("long") + k % 2), "vision").alias("total"),
        F.array(item).alias("items"),
        blank.alias("remark"),
        F.when(k % 17 == 0, "住宿").alias("category"),
        F.when(k % 34 == 0, "旧规则").alias("category_rule"),
        F.concat(F.lit("/in/"), k.cast("string")).alias("source_path"),
        F.sha2(k.cast("string"), 256).alias("file_hash"),
        F.array().cast("array<struct<kind: string, expected_cents: bigint, found_cents: bigint, found_len: int, expected_len: int, raw: string, date: string, field: string>>").alias("issues"),
    )


#: The same rows, flat; confidences are floats.
INVOICES = f"""base AS (
  SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'digitalSpecial' WHEN 1 THEN 'digitalGeneral' ELSE 'train' END AS kind,
    CASE WHEN p_partkey % 7 <> 0 THEN lpad(p_partkey::VARCHAR, 20, '0') END AS number,
    CASE WHEN p_partkey % 13 <> 0 THEN '2024-03-01' END AS issued_on,
    p_brand || CASE WHEN p_partkey % 2 = 0 THEN '酒店' ELSE '航空' END AS seller,
    round(p_retailprice * 100)::BIGINT AS cents, {ITEM_NAME} AS item,
    CASE WHEN p_partkey % 17 = 0 THEN '住宿' END AS category, CASE WHEN p_partkey % 34 = 0 THEN '旧规则' END AS category_rule
  FROM part
), inv AS (
  SELECT *, CASE WHEN id % 5 <> 0 THEN cents END AS net, CASE WHEN id % 4 <> 0 THEN cents // 10 END AS tax,
    CASE WHEN id % 6 <> 0 THEN cents + cents // 10 + id % 2 END AS total FROM base
)"""

_LABELS = {"digitalSpecial": KINDS["digitalSpecial"], "digitalGeneral": KINDS["digitalGeneral"], "train": KINDS["train"]}
_HAY = {
    "taxCategory": "nullif(trim(regexp_extract(item, '^\\*([^*]*)\\*', 1)), '')",
    "itemName": "item",
    "sellerName": "seller",
    "kind": f"CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items())} END",
}


def _rule_case(result) -> str:
    order = sorted(enumerate(SEEDS), key=lambda p: (-p[1][1], p[0]))
    arms = []
    for at, (category, _, field, words) in order:
        tests = " OR ".join(f"coalesce(contains({_HAY[field]}, '{w}'), false)" for w in words)
        arms.append(f"WHEN {tests} THEN {result(at, category)}")
    return "CASE " + " ".join(arms) + " END"


#: Category by the built-in rules, as one CASE in rule order.
RULE_CATEGORY = _rule_case(lambda _, category: f"'{category}'")
