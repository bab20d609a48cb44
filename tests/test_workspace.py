import datetime
import io
import json
import re
import zipfile

import pytest
from helpers import archive, invoice, pdf, xml
from pyspark.sql import functions as F

from tallyworks import schema
from tallyworks.api import Workspace
from tallyworks.operators import ingest, ledger as L, reports as R, selection as S
from tallyworks.sinks import template, xlsx
from tallyworks.sources import files

NOW = datetime.datetime(2024, 6, 1, 12, 0)


@pytest.fixture
def ws(spark, tmp_path):
    return Workspace(spark, str(tmp_path / "ws"), lambda: NOW)


def rows_of(df, *names):
    return [r[:] if len(names) > 1 else r[0] for r in df.select(*names).collect()]


def test_saving_is_idempotent(spark, ws):
    a = invoice(None, number="1" * 20, issued_on="2024-01-02", total=100, file_hash="x", source_path="b")
    df = spark.createDataFrame([a, {**a, "source_path": "a"}, invoice(None, number="1" * 20, file_hash="y", source_path="c", issued_on="2024-01-03", total=7, category="餐饮")], schema.INVOICE)
    first = {r["file_hash"]: (r["id"], r["inserted"]) for r in ws.ledger.save(df).collect()}
    assert first == {"x": (1, True), "y": (2, True)}
    again = {r["file_hash"]: (r["id"], r["inserted"]) for r in ws.ledger.save(df).collect()}
    assert again == {"x": (1, False), "y": (2, False)}
    listed = ws.ledger.list().collect()
    assert [(r["id"], r["duplicate_of"]) for r in listed] == [(2, [1]), (1, [2])]
    assert rows_of(ws.ledger.rows().where("id = 1"), "source_path") == ["a"]
    assert [tuple(r) for r in ws.ledger.totals().collect()] == [("未分类", 1, 100, 0), ("餐饮", 1, 7, 0)]
    ws.ledger.delete(2)
    ws.ledger.save(spark.createDataFrame([invoice(None, file_hash="z")], schema.INVOICE))
    assert sorted(rows_of(ws.ledger.rows(), "id")) == [1, 3]  # ids never come back


def test_filters(spark, ws):
    mk = lambda k, **o: invoice(None, file_hash=f"f{k}", source_path=f"{k:02d}", **o)
    ws.ledger.save(
        spark.createDataFrame(
            [
                mk(1, number="A1", issued_on=("2024-01-01", "pdfText", 0.9), total=(5, "xml", 1.0), seller_name="Blue 100% Co", category="餐饮"),
                mk(2, issued_on="2024-02-01", total=9, number="N2", buyer_name="blue buyer"),
                mk(3, number="N3", total=1),
                mk(4, number="N4", code="C", total=1, issued_on="2024-03-01"),
            ],
            schema.INVOICE,
        )
    )
    ids = lambda **f: [r["id"] for r in ws.ledger.list(L.Filter(**f)).collect()]
    assert ids() == [4, 2, 1, 3] and ids(search=" BLUE ") == [2, 1] and ids(search="1__% c") == [1] and ids(search="  ") == [4, 2, 1, 3]
    assert ids(category="") == [4, 2, 3] and ids(category="餐饮") == [1] and ids(date_to="2024-01-15") == [1, 3] and ids(date_from="2024-01-15") == [4, 2]
    assert ids(needs_review_only=True) == [1, 3]  # 0.9 as a float is below 0.9 as a double; no date is less sure
    rows = ws.ledger.list()
    assert rows_of(rows.where(L.row_needs_review()), "id") == [3]
    r = ws.reporting.save({"title": "t"})
    ws.reporting.set_invoices(r, [2, 4])
    assert ids(exclude_report=r) == [1, 3]
    assert [x["total_cents"] for x in ws.ledger.totals(L.Filter(exclude_report=r)).collect()] == [5, 1]
    assert tuple(ws.ledger.counts().first()) == (4, 2, 0, 16)
    assert tuple(L.status_bar(ws.ledger.totals()).first()) == (4, 16, 0, 3)
    by = lambda k, d: [r["id"] for r in L.sort_rows(ws.ledger.rows(), k, d).collect()]
    assert by("amount", True) == [2, 1, 4, 3] and by("date", False) == [3, 1, 2, 4]
    assert L.toggle_sort(("date", True), "date") == ("date", False) and L.toggle_sort(("date", False), "amount") == ("amount", True)


def test_pinyin_order(spark):
    rows = spark.createDataFrame([(1, "重庆店"), (2, "阿明店"), (3, "北京店")], "id long, seller_s string").withColumn("issued_on_s", F.lit("")).withColumn("total_cents", F.lit(0))
    assert [r["id"] for r in L.sort_rows(rows, "seller", False).collect()][0] == 2


def test_edits(spark, ws):
    ws.ledger.save(spark.createDataFrame([invoice(None, number="1" * 20, kind="digitalGeneral", issued_on="2024-01-01", total=106, tax=6, seller_name="云上科技", file_hash="h")], schema.INVOICE))
    ws.rulebook.save({"id": None, "name": "云", "category": "云类", "priority": 5, "enabled": True, "conditions": [{"field": "sellerName", "keywords": ["云"]}]})
    assert ws.ledger.reclassify_all() == 1 and ws.ledger.reclassify_all() == 0
    assert rows_of(ws.ledger.rows(), "category_s", "category_rule_s", "reviewed") == [("云类", "云", False)]
    ws.ledger.set_category(1, "手工")
    assert rows_of(ws.ledger.rows(), "category_s", "category_rule_s", "reviewed") == [("手工", "", True)] and ws.ledger.reclassify_all() == 0
    edited = ws.ledger.get(1).withColumn("total", F.struct(F.lit(None).cast("bigint").alias("value"), F.lit(0.0).cast("float").alias("confidence"), F.lit("missing").alias("source")))
    edited = edited.withColumn("amount_excl_tax", F.struct(F.lit(100).cast("bigint").alias("value"), F.lit(1.0).cast("float").alias("confidence"), F.lit("manual").alias("source")))
    ws.ledger.save_edit(edited)
    assert rows_of(ws.ledger.rows(), "total_cents", "file_hash", "issue_count") == [(106, "h", 0)]
    s = ws.ledger.suggest_category(1, lambda text: '{"类别":"云类","理由":"名字"}' if "云上科技" in text else "")
    assert s["category"] == "云类" and s["proposed_rule"]["priority"] == 200


def test_rescan_keeps_what_was_typed(spark, ws):
    ws.ledger.save(spark.createDataFrame([invoice(None, number=("手填", "manual", 1.0), seller_name=("旧", "vision", 0.75), file_hash="h", source_path="s.xml")], schema.INVOICE))
    ws.ledger.rescan(1, spark.createDataFrame([("s.xml", bytearray(xml()))], files.FILES))
    r = ws.ledger.get(1).first()
    assert r["number"]["value"] == "手填" and r["seller_name"]["value"] == "海风餐饮店" and r["total"]["value"] == 21200 and len(r["items"]) == 2 and r["file_hash"] == "h"


def test_rules(ws):
    assert ws.rulebook.seed_if_empty() == 26 and ws.rulebook.seed_if_empty() == 0
    ws.rulebook.delete(3)
    assert ws.rulebook.restore_defaults() == 1 and ws.rulebook.restore_defaults() == 0
    assert ws.rulebook.list().first()["priority"] == 150 and max(rows_of(ws.rulebook.list(), "id")) == 27
    text = ws.rulebook.export_json()
    assert len(json.loads(text)) == 26 and ws.rulebook.import_json(text) == 26 and ws.rulebook.list().count() == 52
    assert ws.rulebook.import_json('[{"name":"坏","category":"c","priority":1,"conditions":"x"}]') == 1
    bad = ws.rulebook.list().where("name = '坏'").first()
    assert bad["conditions"] == [] and ws.rulebook.save({**bad.asDict(True), "name": "改"}) == bad["id"]
    assert rows_of(ws.rulebook.list().where(F.col("id") == bad["id"]), "name") == ["改"]
    assert rows_of(ws.rulebook.categories(), "category")[-1] == "未分类"


def test_settings(ws):
    assert ws.get_preference("a") is None
    ws.set_preference("a", "1")
    ws.set_preference("a", "2")
    ws.set_setting("a", "3")
    assert ws.get_preference("a") == "2" and ws.get_setting("a") == "3"


@pytest.fixture
def filled(spark, ws):
    cases = [
        ("digitalSpecial", "住宿", 1000, 60, 1060), ("digitalGeneral", "", None, 30, 530), ("train", "长途交通", 200, None, 200), ("taxi", None, 44, 0, 44),
    ]
    ws.ledger.save(
        spark.createDataFrame(
            [
                invoice(None, kind=k, category=c, amount_excl_tax=n, tax=t, total=s, number=f"N{i}", seller_name=f"店<{i}>", issued_on=f"2024-05-0{i + 1}", file_hash=f"h{i}", source_path=str(i))
                for i, (k, c, n, t, s) in enumerate(cases)
            ],
            schema.INVOICE,
        )
    )
    r = ws.reporting.save({"title": "五月", "applicant": "张", "department": "研发", "note": "急"})
    ws.reporting.set_invoices(r, [2, 1, 2, 4, 3])
    return ws, r


def test_reports(filled):
    ws, r = filled
    assert rows_of(ws.reporting.invoices(r), "id", "position") == [(2, 0), (1, 1), (4, 3), (3, 4)]
    empty = ws.reporting.save({"title": "空"})
    got = {x["id"]: (x["title"], x["invoice_count"], x["total_cents"]) for x in ws.reporting.list().collect()}
    assert got == {r: ("五月", 4, 1834), empty: ("空", 0, 0)}
    created = ws.reports.read().where(F.col("id") == r).first()["created_at"]
    ws.reporting.save({"id": r, "title": "改"})
    assert ws.reports.read().where(F.col("id") == r).first()[:] == (r, "改", "", "", "", created)
    p = ws.reporting.preview(r)
    assert (p["count"], p["amount_excl_tax_cents"], p["tax_cents"], p["total_cents"], p["deductible_tax_cents"]) == (4, 1744, 90, 1834, 60)
    assert [(c["category"], c["total_cents"]) for c in p["by_category"]] == [("住宿", 1060), ("未分类", 574), ("长途交通", 200)] and p["capital_amount"] == "壹拾捌圆叁角肆分"
    assert ws.reporting.preview(empty)["count"] == 0 and ws.reporting.preview(empty)["capital_amount"] == "零圆整"
    ws.reporting.remove_invoice(r, 1)
    assert rows_of(ws.reporting.invoices(r), "id", "position") == [(2, 0), (4, 1), (3, 2)]
    ws.ledger.delete(4)
    assert rows_of(ws.reporting.invoices(r), "id") == [2, 3]
    ws.reporting.delete(r)
    assert ws.bridge.read().isEmpty() and ws.ledger.rows().count() == 3
    ws.reporting.set_date(empty, "2024-06-01")
    assert ws.reporting.date(empty) == "2024-06-01"


def cells(content, sheet=1):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        text = z.read(f"xl/worksheets/sheet{sheet}.xml").decode()
    out = {}
    for ref, rest in re.findall(r'<c r="([A-Z]+\d+)"([^>]*/>|.*?</c>)', text):
        m = re.search(r"<v>(.*?)</v>|<t[^>]*>(.*?)</t>", rest)
        out[ref] = (m[1] or m[2]) if m else ""
    return out, text


def test_workbook(filled):
    ws, r = filled
    out = io.BytesIO()
    ws.reporting.export(r, xlsx.ReportMeta("五月报销", "张", "研发", "急件", "2024-06-01"), out)
    c, text = cells(out.getvalue())
    assert c["A1"] == "五月报销" and c["B2"] == "张" and c["E2"] == "研发" and c["H2"] == "2024-06-01" and c["K4"] == "备注/问题"
    assert (c["A5"], c["C5"], c["E5"], c["F5"], c["G5"], c["I5"], c["J5"]) == ("1", "N1", "店&lt;1&gt;", "", "0.00", "5.30", "")
    assert (c["J6"], c["F7"], c["G9"], c["I9"]) == ("是", "未分类", "17.44", "18.34") and c["A9"] == "合计"
    assert c["B11"] == "壹拾捌圆叁角肆分" and c["B12"] == "急件" and 'ref="B11:E11"' in text
    c, _ = cells(out.getvalue(), 2)
    assert (c["A2"], c["B2"], c["E2"], c["A5"], c["B5"], c["C7"]) == ("住宿", "1", "10.60", "合计", "4", "0.60") and float(c["F2"]) == pytest.approx(1060 / 1834)
    assert [xlsx.column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


TEMPLATE = """<worksheet><dimension ref="A1:D9"/><sheetData><row r="1"><c r="A1" s="3" t="s"><v>0</v></c></row>
<row r="3" ht="9"><c r="A3" t="inlineStr"><is><t>共 {{张数}} 张 {{合计}} 元</t></is></c><c r="B3" s="2"><v>7</v></c></row>
<row r="4"><c r="A4" s="1" t="s"><v>1</v></c><c r="B4" t="str"><f>x</f><v>{{明细.合计}}</v></c><c r="C4" t="inlineStr"><is><t>{{明细.销售方}}!</t></is></c></row>
<row r="5"><c r="A5" t="inlineStr"><is><t>{{合计大写}}</t></is></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/><mergeCell ref="A5:C5"/></mergeCells></worksheet>"""


def test_template(filled):
    ws, r = filled
    book = archive({"[Content_Types].xml": "t", "xl/sharedStrings.xml": "<sst><si><r><t>{{标</t></r><r><t>题}}</t></r></si><si><t>{{明细.序号}}</t></si></sst>", "xl/worksheets/sheet1.xml": TEMPLATE})
    out = io.BytesIO()
    report = ws.reporting.export_with_template(r, book, xlsx.ReportMeta(title="A&B"), out)
    c, text = cells(out.getvalue())
    assert report.detail_rows == 4 and set(report.filled) == {"{{标题}}", "{{张数}}", "{{合计}}", "{{合计大写}}", "{{明细.序号}}", "{{明细.销售方}}", "{{明细.合计}}"} and len(report.missing) == 14
    assert c["A1"] == "A&amp;B" and c["A2"] == "共 4 张 18.34 元" and c["B2"] == "7" and (c["A3"], c["B3"], c["C3"]) == ("1", "5.30", "店&lt;1&gt;!")
    assert c["B6"] == "2.00" and c["A7"] == "壹拾捌圆叁角肆分" and 'ref="A8:C8"' in text and 'ref="A1:B1"' in text and "dimension" not in text
    assert '<c r="A3" s="1"><v>1</v></c>' in text and 'ht="9"' in text
    empty = ws.reporting.save({"title": "空"})
    ws.reporting.export_with_template(empty, book, xlsx.ReportMeta(), out2 := io.BytesIO())
    c, text = cells(out2.getvalue())
    assert c["A3"] == "零圆整" and "{{" not in text and c["A1"] == ""
    with pytest.raises(ValueError):
        template.read_template(b"nope")
    assert len(ws.reporting.placeholders()) == 21


def test_ingest_end_to_end(spark, ws, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "a.xml").write_bytes(xml())
    (box / "b.zip").write_bytes(archive({"same.xml": xml(), "mismatch.xml": xml("2" * 20, total="213.00")}))
    (box / "c.pdf").write_bytes(pdf(["发票号码：12345678"] * 5))
    (box / "d.txt").write_text("hello")
    ws.rulebook.seed_if_empty()
    done = ws.ledger.import_folder(str(box), today=NOW.date())
    got = {r["name"].split("/")[-1]: r["status"] for r in done.collect()}
    assert got == {"a.xml": "imported", "b.zip!same.xml": "imported", "b.zip!mismatch.xml": "imported", "c.pdf": "needsReview", "d.txt": "failed"}
    assert ingest.tally(done).first().asDict() == {"imported": 3, "needsReview": 1, "alreadyImported": 0, "failed": 1, "total": 5, "vision_candidates": 0}
    assert ws.ledger.rows().count() == 4 and {r["status"] for r in ws.ledger.import_folder(str(box), today=NOW.date()).collect()} == {"alreadyImported"}
    assert sorted(rows_of(ws.ledger.rows(), "category_s")) == ["", "", "餐饮", "餐饮"]
    assert [r["issue_count"] for r in ws.ledger.rows().where("number_s like '2222%'").collect()] == [1]


def test_reply_hook_completes_scans(spark, ws):
    scan = spark.createDataFrame([("s.pdf", bytearray(pdf(None, None, (600, 400, bytes(240000)))))], files.FILES)
    r = ws.ledger.import_files(scan, NOW.date(), reply_fn=lambda path: '{"发票号码":"12345678","开票日期":"2024-01-01","价税合计":"9"}').first()
    assert r["status"] == "needsReview" and not r["vision_would_help"]
    assert rows_of(ws.ledger.rows(), "number_s", "total_cents") == [("12345678", 900)]


def test_stream(spark, ws, tmp_path):
    from tallyworks.streaming.ingest import ingest_stream, watch

    box = tmp_path / "box"
    box.mkdir()
    (box / "a.xml").write_bytes(xml())
    run = lambda: ingest_stream(watch(spark, str(box)), lambda b, t: ws.ledger.import_files(b, t), str(tmp_path / "cp"), NOW.date).awaitTermination()
    run()
    (box / "b.xml").write_bytes(xml("3" * 20))
    (box / "again.xml").write_bytes(xml())
    run()
    assert sorted(rows_of(ws.ledger.rows(), "number_s")) == ["24312000000000009999", "3" * 20]


def test_selection(spark):
    ids = lambda *k: spark.createDataFrame([(x,) for x in k], "id long")
    got = lambda df: sorted(r["id"] for r in df.collect())
    assert got(S.visible(ids(1, 2), ids(2, 3))) == [2] and got(S.check_all(ids(1, 2), ids(2, 3))) == [1, 2, 3] and got(S.uncheck_all(ids(1, 2), ids(2))) == [1] and got(S.toggle(ids(1, 2), ids(2, 3))) == [1, 3]
    assert got(S.add_range(ids(9), ids(1, 2, 3, 4), 4, 2, ["id"])) == [2, 3, 4, 9] and got(S.add_range(ids(9), ids(1, 2, 3), 7, 2, ["id"])) == [2, 9]
    assert S.append_picked([3, 1], [1, 2]) == [3, 1, 2]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate([2, 0, 1, 3])], "id long, position int")
    moved = lambda i, d: [r["id"] for r in R.move_row(rows, i, d, 4).orderBy("position").collect()]
    assert moved(0, 2) == [2, 0, 1, 3] and moved(3, -2) == [1, 3, 2, 0] and moved(0, -1) == [1, 2, 0, 3]
    dated = spark.createDataFrame([(0, ""), (1, "2024-02-01"), (2, ""), (3, "2024-01-01")], "position int, issued_on string")
    assert [r["position"] for r in R.sort_by_date(dated).collect()] == [3, 1, 0, 2]
    seen = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "v string, at int")
    assert [r[0] for r in S.first_seen(seen, "v", "at").collect()] == ["b", "a"]


def test_ingest_events():
    s = ingest.reduce_ingest(ingest.IDLE, {"type": "started", "total": 2})
    s = ingest.reduce_ingest(s, {"type": "file", "name": "a", "status": "failed", "vision_would_help": True})
    s = ingest.reduce_ingest(s, {"type": "file", "name": "b", "status": "imported"})
    assert (s["done"], s["tally"]["failed"], len(s["problems"]), s["vision_candidates"], s["current_name"]) == (2, 1, 1, 1, "b")
    end = ingest.reduce_ingest(s, {"type": "finished", "imported": 5, "needs_review": 0, "duplicates": 1, "failed": 0})
    assert end["tally"] == {"imported": 5, "needsReview": 0, "alreadyImported": 1, "failed": 0} and end["phase"] == "done" and ingest.IDLE["done"] == 0
    with pytest.raises(ValueError):
        ingest.reduce_ingest(s, {"type": "?"})


def test_small_settings_and_drafts(spark, ws):
    from tallyworks.operators import classify as C

    assert ws.get_ai_settings()["vision_enabled"] is False
    ws.set_ai_settings({"vision_enabled": True})
    assert ws.get_ai_settings()["vision_enabled"] is True
    ws.set_setting("ai", "{broken")
    assert ws.get_ai_settings()["vision_enabled"] is False
    ws.reporting.save({"title": "a", "applicant": "张", "department": "研发"})
    fresh = ws.reporting.new("b")
    r = ws.reports.read().where(F.col("id") == fresh).first()
    assert (r["title"], r["applicant"], r["department"]) == ("b", "张", "研发") and not R.can_export(ws.reporting.invoices(r["id"]))
    assert C.new_draft()["priority"] == 150
