"""Counts that follow change sets, search by postings, large rule sets and merged versions, against plain Python."""

import datetime
import random

import pytest
from helpers import invoice, xml
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyworks import schema
from tallyworks.api import Workspace
from tallyworks.operators import classify as C, counts, ledger as L, search, versions
from tallyworks.operators.store import Store, deletes, upserts

ROW = schema.columns(id=T.LongType(), dedup_key=T.StringType(), category_s=T.StringType(), total_cents=T.LongType(), tax_cents=T.LongType(), reviewed=T.BooleanType(), min_confidence=T.DoubleType(), issue_count=T.LongType())


def test_counts_follow_random_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    t = store.table("invoices", ROW, ["id"], buckets=4, children={"report_invoices": "invoice_id"})
    lines = store.table("report_invoices", schema.REPORT_INVOICE, ["report_id", "invoice_id"], "invoice_id", buckets=4)
    own, rng = counts.Counts(store), random.Random(1)
    assert own.sidebar().collect() == [(0, 0, 0, 0)]
    for _ in range(4):
        rows = [(k, rng.choice(["", "a", "b", f"k{k}"]), rng.choice(["", "餐饮"]), rng.randint(-5, 50), 1, rng.random() < 0.5, rng.choice([0.5, 1.0]), rng.randint(0, 1)) for k in rng.sample(range(30), 9)]
        gone = [(k,) for k in rng.sample(range(30), 6)]
        more = [(rng.randint(1, 3), rng.randint(0, 29), 0) for _ in range(6)]
        changes = upserts(spark.createDataFrame(rows, ROW)).unionByName(deletes(spark.createDataFrame(gone, "id bigint"), 1), allowMissingColumns=True)
        store.apply({"invoices": changes, "report_invoices": upserts(spark.createDataFrame(sorted({m[:2] for m in more}), "report_id bigint, invoice_id bigint").withColumn("position", F.lit(0)))})
        whole = t.read()
        assert own.sidebar().collect() == L.sidebar_counts(whole).select("all", "review", "duplicates", "total_cents").collect()
        by = whole.groupBy("category_s").agg(F.count(F.lit(1)), F.sum("total_cents"), F.sum("tax_cents"))
        assert sorted(own.categories.read().collect()) == sorted(by.collect())
        sums = lines.read().join(whole, F.col("invoice_id") == F.col("id"), "left").groupBy("report_id").agg(F.count(F.lit(1)), F.coalesce(F.sum("total_cents"), F.lit(0)))
        assert sorted(own.reports.read().collect()) == sorted(sums.collect())


NEEDLES = ["", "  ", "Blue", "BLUE 100% c", "e_1", "%", "_", "ab", "日本酒店", "本酒", "x%y", "no such thing", "a\\b", "ÄB"]


def test_search_reads_postings_of_the_needle(spark, tmp_path):
    rng = random.Random(2)
    names = ["Blue 100% Co", "blue1", "日本酒店", "xaay", "ABC ab", "", "a\\bc", "Äbc äb", "e11"]
    rows = [(k, rng.choice(names), rng.choice(names), rng.choice(names)) for k in range(120)]
    df = spark.createDataFrame(rows, "id bigint, number_s string, seller_s string, buyer_s string")
    store = Store(spark, str(tmp_path / "s"))
    index = search.posting_table(store)
    index.apply(upserts(search.postings(df)))
    for n in NEEDLES:
        want = sorted(r["id"] for r in df.where(L.Filter(search=n).predicate()).collect())
        assert sorted(r["id"] for r in search.search(df, index, n).collect()) == want, n
    assert search.needle_grams("Blue_1%日本酒店") == ["blu", "lue", "日本酒", "本酒店"]
    paths = index.files()
    read = index.read_keys(spark.createDataFrame([("blu",)], "gram string")).inputFiles()
    assert read and len(paths) > 5 and len({f.rsplit("/", 2)[1] for f in read}) == 1


@pytest.mark.parametrize("hot", [100_000, 3])
def test_many_rules_match_as_compiled(spark, hot):
    rng = random.Random(3)
    words = ["酒店", "中", "中国", "国航", "ab", "b", "abc", "cab", "店"]
    invoices = [invoice(k, seller_name="".join(rng.choices(words, k=3)) if k % 9 else None, items=["*" + rng.choice(words) + "*" + rng.choice(words)] * (k % 3), kind=None) for k in range(80)]
    rules = [
        {"id": rng.choice([None, k]) if k == 7 else k, "name": f"r{k}", "category": f"c{k % 5}", "priority": rng.randint(0, 3), "enabled": rng.random() < 0.9,
         "conditions": [{"field": rng.choice(["sellerName", "itemName", "taxCategory"]), "keywords": ["".join(rng.choices(words, k=rng.randint(1, 2))) for _ in range(rng.randint(0, 2))] + [""]} for _ in range(rng.randint(0, 2))]}
        for k in range(60)
    ]
    df, given = spark.createDataFrame(invoices, schema.INVOICE), spark.createDataFrame(rules, schema.RULE)
    want = {r["id"]: (r["m"]["category"], r["m"]["rule"]) for r in df.select("id", C.compile_rules(rules).alias("m")).collect() if r["m"]}
    got = {r["id"]: (r["category"], r["rule"]) for r in C.match_by_join(df, given, "id", hot).collect()}
    assert got == want and len(got) > 20
    assert C.match_by_join(df, given.limit(0), "id").collect() == [] == C.match_by_join(df.limit(0), given, "id").collect()


def test_versions(spark):
    old = invoice(1, number=("a", "pdfText", 0.9), total=(5, "vision", 0.5), tax=None, items=["x"], seller_name=("s", "xml", 1.0))
    new = invoice(1, number=("b", "xml", 1.0), total=(6, "vision", 0.75), tax=(1, "vision", 0.75), items=["y"], seller_name=("t", "xml", 1.0), source_path="n")
    later = invoice(1, number=("z", "manual", 1.0), source_path="z")
    row = versions.merge_versions(spark.createDataFrame([old, invoice(2)], schema.INVOICE), spark.createDataFrame([later, new], schema.INVOICE), datetime.date(2024, 1, 1)).collect()
    assert len(row) == 1
    r = row[0]
    how = {d["field"]: (d["won"], d["why"]) for d in r["decisions"]}
    assert how["number"] == ("new", "rank") and how["total"] == ("new", "confidence") and how["tax"] == ("new", "only") and how["seller_name"] == ("old", "tie") and how["code"] == ("old", "none")
    assert (r["number"]["value"], r["total"]["value"], r["tax"]["value"], r["items"][0]["name"], r["amount_excl_tax"]["value"], r["changed"]) == ("b", 6, 1, "x", 5, True)


def test_rescan_of_many_files(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"), lambda: datetime.datetime(2024, 6, 1))
    files = lambda *rows: spark.createDataFrame(rows, "path string, content binary")
    ws.ledger.import_files(files(("a.xml", xml("1" * 20)), ("b.xml", xml("2" * 20, seller="乙店"))))
    ids = {r["source_path"]: r["id"] for r in ws.ledger.rows().collect()}
    blank = ws.ledger.rows().where(F.col("id") == ids["a.xml"]).select(*schema.INVOICE.fieldNames()).withColumn("seller_name", F.struct(F.lit(None).cast("string").alias("value"), F.lit(0.0).cast("float").alias("confidence"), F.lit("missing").alias("source")))
    ws.ledger.update(blank, True)
    version = ws.store.manifest().version
    got = {r["id"]: r["changed"] for r in ws.ledger.rescan_all(files(("a.xml", xml("1" * 20)), ("b.xml", xml("2" * 20, seller="乙店")), ("unknown.xml", xml("3" * 20)))).collect()}
    assert got == {ids["a.xml"]: True, ids["b.xml"]: False} and ws.store.manifest().version == version + 1
    rows = {r["id"]: (r["seller_s"], r["reviewed"]) for r in ws.ledger.rows().collect()}
    assert rows[ids["a.xml"]] == ("海风餐饮店", False)


def test_saves_of_one_batch_come_once(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "ws"))
    df = spark.createDataFrame([invoice(None, file_hash="x")], schema.INVOICE)
    ws.ledger.save(df, ("stream", 4))
    ws.ledger.delete(1)
    ws.ledger.save(df, ("stream", 4))
    assert ws.ledger.rows().isEmpty()
    ws.ledger.save(df, ("stream", 5))
    assert [r["id"] for r in ws.ledger.rows().collect()] == [2]


def test_many_rules_share_conditions(spark):
    """Rules that have conditions in common make no row for each pair of an invoice and a rule that it meets in part."""
    items, sellers = [f"i{k:02d}x" for k in range(40)], [f"s{k:02d}x" for k in range(40)]
    df = spark.createDataFrame([invoice(k, seller_name=sellers[k % 40], items=[items[k // 40 % 40]]) for k in range(1_600)], schema.INVOICE)
    rules = [{"id": 40 * a + b, "name": f"r{a}-{b}", "category": "c", "priority": 1, "enabled": True, "conditions": [{"field": "itemName", "keywords": [x]}, {"field": "sellerName", "keywords": [y]}, {"field": "sellerName", "keywords": [y, ""]}]} for a, x in enumerate(items) for b, y in enumerate(sellers)]
    own = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    before = max((s.stageId() for s in _stages(own, none)), default=-1)
    got = C.match_by_join(df, spark.createDataFrame(rules, schema.RULE), "id").collect()
    assert {r["id"]: r["rule"] for r in got} == {k: f"r{k // 40}-{k % 40}" for k in range(1_600)}
    # an invoice meets 79 of the 1,600 rules in part: 126,400 pairs
    assert max(s.shuffleWriteRecords() for s in _stages(own, none) if s.stageId() > before) < 70_000


def _stages(store, none):
    found = store.stageList(None, False, False, none, None).iterator()
    while found.hasNext():
        yield found.next()


def test_postings_are_made_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "abcab", "ABCd", "xy"), (2, "", "日本酒店", None)], "id bigint, number_s string, seller_s string, buyer_s string")
    made = search.postings(df)
    assert sorted(map(tuple, made.collect())) == [("abc", 1), ("bca", 1), ("bcd", 1), ("cab", 1), ("日本酒", 2), ("本酒店", 2)]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
