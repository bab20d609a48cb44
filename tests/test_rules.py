import datetime

import pytest
from pyspark.sql import functions as F

from helpers import invoice
from tallyworks import schema
from tallyworks.functions import prose as P
from tallyworks.operators import classify as C
from tallyworks.operators import validate as V


def rule(id_, category, conditions, priority=100, enabled=True, name=None):
    return {"id": id_, "name": name or f"r{id_}", "category": category, "priority": priority, "enabled": enabled, "conditions": [{"field": f, "keywords": k} for f, k in conditions]}


@pytest.fixture(scope="module")
def make(spark):
    return lambda *rows: spark.createDataFrame(list(rows), schema.INVOICE)


def category_of(df, spark, *rules):
    table = spark.createDataFrame(list(rules), schema.RULE)
    rows = {r["id"]: (r["category"], r["category_rule"]) for r in C.classify(df, table).collect()}
    joined = {r["id"]: (r["category"], r["rule"]) for r in C.match_by_join(df, table, "id").collect()}
    assert {k: v for k, v in rows.items() if v[0] is not None} == joined  # both forms of the join agree
    return rows


def test_priority_ties_and_conditions(spark, make):
    df = make(invoice(1, seller_name="云上科技", items=["*信息服务*月费"]), invoice(2, seller_name="路边小店"), invoice(3, remark="含云字", kind="taxi"))
    rules = [
        rule(5, "低", [("sellerName", ["云"])], 10), rule(3, "高", [("taxCategory", ["信息"]), ("sellerName", ["科技", "x"])], 50), rule(2, "同", [("itemName", ["月费"])], 50),
        rule(9, "关", [("sellerName", ["云"])], 999, False), rule(8, "空", [], 999), rule(7, "无词", [("sellerName", [""])], 999), rule(6, "票", [("kind", ["出租车"])], 1),
    ]
    assert category_of(df, spark, *rules) == {1: ("同", "r2"), 2: (None, None), 3: ("票", "r6")}


def test_seeds(spark, make):
    df = make(
        invoice(1, items=["*住宿服务*房费"], seller_name="某航空"), invoice(2, seller_name="顺丰速运"), invoice(3, kind="train"), invoice(4, items=["*运输服务*打车"], seller_name="x"), invoice(5, seller_name="杂货")
    )
    rules = [{**r.asDict(True), "id": k} for k, r in enumerate(C.seed_rules(spark).collect())]
    assert len(rules) == 26 and C.seed_categories()[-1] == "未分类"
    got = {k: v[0] for k, v in category_of(df, spark, *rules).items()}
    assert got == {1: "住宿", 2: "快递邮寄", 3: "长途交通", 4: "市内交通", 5: None}


def test_reclassify_keeps_manual(spark, make):
    df = make(
        invoice(1, seller_name="云", category="手工"), invoice(2, seller_name="云", category="旧", category_rule="r"), invoice(3, seller_name="云", category="云类", category_rule="别名"),
        invoice(4, seller_name="x", category="", category_rule=""), invoice(5, seller_name="x"),
    )
    rules = spark.createDataFrame([rule(1, "云类", [("sellerName", ["云"])])], schema.RULE)
    got = {r["id"]: (r["changed"], r["category"], r["category_rule"]) for r in C.reclassify(df, rules).collect()}
    assert got == {1: (False, "手工", None), 2: (True, "云类", "r1"), 3: (False, "云类", "别名"), 4: (True, None, None), 5: (False, None, None)}


def test_proposals_and_groups(spark, make):
    df = make(invoice(1, items=["无", "*餐饮服务*餐"], seller_name="店"), invoice(2, seller_name="店"), invoice(3))
    got = [r["p"] for r in df.orderBy("id").select(C.proposed_rule(F.lit("餐饮")).alias("p")).collect()]
    assert got[0]["name"] == "税收分类简称：餐饮服务" and got[0]["priority"] == 200 and got[1]["conditions"][0]["field"] == "sellerName" and got[2] is None
    rules = spark.createDataFrame([rule(2, "未分类", [], 1), rule(1, "住宿", [], 5), rule(3, "住宿", [], 9), rule(4, "餐饮", [], 1)], schema.RULE)
    groups = [(r["category"], [x["id"] for x in r["rules"]]) for r in C.group_by_category(rules).collect()]
    assert groups == [("餐饮", [4]), ("住宿", [3, 1]), ("未分类", [2])]
    assert [r[0] for r in C.rule_categories(rules.where("id <> 2")).collect()] == ["住宿", "餐饮", "未分类"]
    matches, fresh = C.type_ahead(rules.select("category").distinct(), " 宿 ")
    assert [r[0] for r in matches.collect()] == ["住宿"] and fresh
    assert C.kinds_for_hint("市内交通") == ["taxi"]


def test_prose(spark, values):
    one = rule(1, "x", [("sellerName", ["甲", "乙"])], name="销售方名称：甲、乙")
    two = rule(2, "x", [("kind", []), ("remark", ["丙"])])
    df = spark.createDataFrame([one, two, rule(3, " ", [])], schema.RULE).orderBy("id")
    got = df.select(
        P.describe_rule(F.col("conditions")).alias("d"), P.default_rule_name(F.col("conditions")).alias("n"), P.is_auto_name(F.col("name"), F.col("conditions")).alias("a"),
        P.validate_draft(F.col("category"), F.col("conditions"), F.col("priority")).alias("v"),
    ).collect()
    assert got[0][:] == ("销售方名称 包含 甲 或 乙", "销售方名称：甲、乙", True, None)
    assert got[1]["d"] == "票种 未填写关键词 并且 备注 包含 丙" and got[1]["n"] == "" and "关键词" in got[1]["v"]
    assert got[2]["d"].startswith("没有条件") and "费用类别" in got[2]["v"]
    notes = values(P.priority_note, [300, 150, 130, 10], "int")
    assert [n["warn"] for n in notes] == [True, False, False, False] and "(120)" in notes[2]["text"] and notes[3]["text"].startswith("低于")
    assert values(P.count_label, [12], "int") == ["12 张"]


TODAY = datetime.date(2024, 3, 15)


def test_inference(spark, make):
    df = make(
        invoice(1, amount_excl_tax=(100, "xml", 1.0), tax=(6, "vision", 0.75)), invoice(2, tax=(6, "xml", 1.0), total=(106, "pdfText", 0.9)),
        invoice(3, amount_excl_tax=(100, "qrCode", 0.95), total=(106, "pdfText", 0.9)), invoice(4, total=(5, "xml", 1.0)),
    )
    r = {x["id"]: x for x in V.infer_and_check(df, TODAY).collect()}
    assert r[1]["total"]["value"] == 106 and r[1]["total"]["source"] == "vision" and r[1]["total"]["confidence"] == pytest.approx(0.7125)
    assert r[2]["amount_excl_tax"]["value"] == 100 and r[3]["tax"]["source"] == "pdfText" and r[4]["tax"]["value"] is None


def test_checks(spark, make):
    df = make(
        invoice(1, kind="digitalGeneral", number="1" * 20, issued_on="2024-03-15", total=100), invoice(2, kind="vatRoll", number="1" * 9, issued_on="2024-02-31", amount_excl_tax=100, tax=6, total=105),
        invoice(3), invoice(4, kind="train", number="E1", issued_on="2024-03-16", total=1),
    )
    r = {x["id"]: [i["kind"] for i in x["issues"]] for x in V.infer_and_check(df, TODAY).collect()}
    assert r == {1: [], 2: ["totalMismatch", "badDate", "numberLength"], 3: ["missingField"] * 3, 4: ["futureDate"]}
    messages = V.infer_and_check(df, TODAY).where("id = 2").select(P.issue_messages(F.col("issues")).alias("m"), F.transform("issues", lambda i: P.issue_message(i, True)).alias("g")).first()
    assert messages["m"] == "价税合计对不上：金额+税额=¥1.06，票面=¥1.05；开票日期无法识别：2024-02-31；发票号码位数异常：9 位，应为 8 位"
    assert messages["g"][0] == "价税合计对不上：金额+税额=¥1.06，票面¥1.05"
