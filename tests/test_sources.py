import datetime

import pytest
from helpers import archive, ofd, pdf, xml
from pyspark.sql import functions as F

from tallyworks.sources import einvoice, extract, files, ofd as O, pdf as P, replies
from tallyworks import schema

TODAY = datetime.date(2024, 6, 1)
TEXT = ["电子发票（增值税专用发票）", "发票号码：24312000000000005555", "开票日期：2024年04月05日", "购买方 名称：买家公司", "销售方 名称：卖家酒店", "价税合计（小写）¥318.00", "合计¥300.00¥18.00"]


@pytest.fixture(scope="module")
def read(spark):
    def run(rows, **kw):
        df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], files.FILES)
        return {r["source_path"]: r for r in extract.extract(df, TODAY, **kw).collect()}

    return run


def test_kinds_of_file(spark):
    samples = {
        "a.jpg": (b"%PDF-1", "pdf"), "b": (ofd({1: ["x"]}), "ofd"), "c": (archive({"x": "y"}), "zip"), "d": (b"\xef\xbb\xbf<?xml ?>", "xml"), "e": (b"<EInvoice/>", "xml"),
        "f": (b"\x89PNG\r\n\x1a\n....", "image"), "g.TIFF": (b"....", "image"), "h.xml": (b"", "xml"), "i.txt": (b"hello", "unknown"), "j": (b"RIFF....WEBP", "image"),
    }
    df = spark.createDataFrame([(p, bytearray(c)) for p, (c, _) in samples.items()], files.FILES)
    got = {r["path"]: r["k"] for r in df.select("path", files.detect(F.col("content"), F.col("path")).alias("k")).collect()}
    assert got == {p: k for p, (_, k) in samples.items()}


def test_folders_and_archives(spark, tmp_path):
    deep = tmp_path / "/".join("abcdefghi")
    deep.mkdir(parents=True)
    (deep / "too_deep.xml").write_bytes(xml())
    (tmp_path / "a" / "one.xml").write_bytes(xml())
    (tmp_path / "two.zip").write_bytes(archive({"in/x.xml": xml("1" * 20), "y.zip": archive({"z.xml": b"<a/>"})}))
    (tmp_path / "three.ofd").write_bytes(ofd({1: ["t"]}))
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04nonsense")
    found = files.expand_archives(files.read_files(spark, str(tmp_path)))
    names = sorted(r["path"].split(tmp_path.name + "/")[1] for r in found.collect())
    assert names == ["a/one.xml", "three.ofd", "two.zip!in/x.xml", "two.zip!y.zip"]


def test_xml(read):
    r = read([("a.xml", xml()), ("gb.xml", xml(seller="广东店", encoding="GBK"))])
    a = r["a.xml"]
    assert a["number"].asDict() == {"value": "24312000000000009999", "confidence": 1.0, "source": "xml"}
    assert (a["kind"], a["issued_on"]["value"], a["total"]["value"], a["tax"]["value"], a["remark"]["value"]) == ("digitalGeneral", "2024-02-03", 21200, 1200, "午餐")
    assert [(i["name"], i["amount_cents"], i["tax_rate"], i["quantity"]) for i in a["items"]] == [("*餐饮服务*餐费", 20000, "6%", None), ("*餐饮服务*茶", None, None, "2")]
    assert r["gb.xml"]["seller_name"]["value"] == "广东店" and a["issues"] == [] and a["category"] is None


def test_xml_variants():
    index = einvoice.index_xml("<a><FPHM>1</FPHM><b:Total_Tax_Included_Amount xmlns:b='u'>5</b:Total_Tax_Included_Amount><x>&lt;&amp;</x><Amount>1</Amount")
    assert index["leaves"] == {"fphm": ["1"], "totaltaxincludedamount": ["5"], "x": ["<&"]}  # breaks off, keeps what was read
    swallowed = einvoice.index_xml("<r><ItemList><Item><Name>a</Name></Item><Item><Name>b</Name></Item></ItemList></r>")
    assert swallowed["rows"] == [{"name": "a"}] and swallowed["leaves"]["name"] == ["a", "b"]
    assert not einvoice.is_invoice(einvoice.index_xml("<a><InvoiceNumber> </InvoiceNumber></a>")) and einvoice.index_xml("")["leaves"] == {}


def test_ofd(read):
    drawn = ofd({10: ["价税合计（小写）¥8.00"], 9: ["发票号码：", "12345678", "销售方 名称：", "某店"]})
    both = ofd({1: ["发票号码：87654321"]}, {"Doc_0/Attachs/original.xml": xml()})
    assert O.read_ofd(drawn)["text"].splitlines()[0].startswith("发票号码： 12345678")
    r = read([("a.ofd", drawn), ("b.ofd", both)])
    assert (r["a.ofd"]["number"]["value"], r["a.ofd"]["number"]["source"], r["a.ofd"]["total"]["value"]) == ("12345678", "pdfText", 800)
    assert r["b.ofd"]["number"]["source"] == "xml" and [t["layer"] for t in r["b.ofd"]["trace"]] == ["文件类型", "OFD 附件 XML"]
    with pytest.raises(ValueError):
        O.read_ofd(b"not a package")
    assert [O.page_number(n) for n in ("P/Page_10/Content.xml", "P/Page_9/c", "x")] == [10, 9, 1 << 32]


def test_pdf_layers(read):
    big = (600, 400, bytes(600 * 400))
    rows = [("text.pdf", pdf(TEXT * 2)), ("xml.pdf", pdf(["x"], xml())), ("scan.pdf", pdf(None, None, big)), ("bad.pdf", b"%PDF broken"), ("part.pdf", pdf([x for x in TEXT * 2 if "小写" not in x], None, big))]
    r = read(rows)
    t = r["text.pdf"]
    assert (t["number"]["value"], t["kind"], t["total"]["value"], t["seller_name"]["value"]) == ("24312000000000005555", "digitalSpecial", 31800, "卖家酒店")
    assert r["xml.pdf"]["number"]["source"] == "xml" and not r["xml.pdf"]["has_image"]
    assert r["scan.pdf"]["has_image"] and r["scan.pdf"]["number"]["value"] is None
    assert r["bad.pdf"]["number"]["value"] is None and r["bad.pdf"]["file_hash"]
    assert not t["has_image"] and r["part.pdf"]["total"]["value"] == 31800  # derived from net and tax
    code = "01,32,,24312000000000005555,300.00,20240405,,x"
    q = read(rows, qr=lambda image: ["junk", code])
    assert q["scan.pdf"]["number"]["source"] == "qrCode" and q["scan.pdf"]["amount_excl_tax"]["value"] == 30000 and q["xml.pdf"]["kind"] == "digitalGeneral"
    assert ("二维码", True) in [(x["layer"], x["hit"]) for x in q["scan.pdf"]["trace"]]


def test_pdf_parts():
    d = P.read_pdf(pdf(["甲 乙", "(丙)"], b"\xef\xbb\xbf<x/>", (10, 10, bytes(100))))
    assert d["text"] == "甲 乙\n(丙)" and d["xml"] == ["<x/>"] and d["images"] == []
    assert P.Parser(rb"(a\(b\)\101\n) <</A [1 2.5 /N#20x true null 3 0 R]>>").value() == b"a(b)A\n"
    with pytest.raises(ValueError):
        P.read_pdf(b"no")


def test_other_files(read):
    r = read([("n.txt", b"hello"), ("z.zip", archive({"a": "b"})), ("p.png", b"\x89PNG\r\n\x1a\nxx")])
    assert [t["layer"] for t in r["z.zip"]["trace"]] == ["文件类型", "压缩包"] and r["n.txt"]["trace"][1]["layer"] == "未知格式"
    assert r["p.png"]["has_image"] and [i["field"] for i in r["n.txt"]["issues"]] == ["发票号码", "开票日期", "价税合计"]


def test_replies(spark):
    from helpers import invoice

    text = '读到：{"票种":"电子发票（普通发票）","发票号码":"12345678","价税合计":"¥5.50","销售方名称":"无","税额":"x","明细":[{"名称":"茶","金额":"5"},{"名称":"-"}],"看不清的字段":["价税合计那里"]} 完'
    df = spark.createDataFrame([invoice(1, number=("999", "qrCode", 0.95)), invoice(2, items=["已有"])], schema.INVOICE).withColumn("r", F.lit(text))
    a, b = replies.apply_vision(df, "r").orderBy("id").collect()
    assert a["number"]["value"] == "999" and a["total"]["value"] == 550 and a["total"]["confidence"] == pytest.approx(0.375) and a["seller_name"]["value"] is None
    assert [i["name"] for i in a["items"]] == ["茶"] and a["items"][0]["amount_cents"] == 500 and [i["name"] for i in b["items"]] == ["已有"] and b["kind"] == "digitalGeneral"
    none = replies.apply_vision(df.withColumn("r", F.lit("抱歉")), "r").first()
    assert none["reply_error"] == "模型没有返回 JSON" and none["number"]["value"] == "999"
    shop = spark.createDataFrame([invoice(1, seller_name="茶馆", kind="taxi", items=[str(k) for k in range(7)], remark="注")], schema.INVOICE)
    assert shop.select(replies.describe().alias("d")).first()["d"].split("\n") == ["票种：出租车票", "销售方：茶馆", *[f"项目：{k}" for k in range(5)], "备注：注"]
    said = lambda t: shop.select(replies.parse_suggestion(F.lit(t), ["餐饮"]).alias("s")).first()["s"]
    assert said('{"类别":" 餐饮 ","理由":"茶"}')["proposed_rule"]["name"] == "销售方名称：茶馆"
    assert "列表之外" in said('{"类别":"旅游"}')["error"] and said("x")["error"] == "模型没有返回 JSON"


def _plain(objects, root):
    """A PDF of plain objects in the given order, the newest trailer last."""
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects)
    return b"%PDF-1.7\n" + body + b"trailer << /Root %d 0 R >>\n%%%%EOF" % root


def _shown(text, info=b"", data=None):
    data = f"BT ({text}) Tj ET".encode() if data is None else data
    return b"<< %s /Length %d >>\nstream\n%s\nendstream" % (info, len(data), data)


def test_pdf_pages_in_tree_order_under_the_newest_root():
    old = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [7 0 R] >>"), (7, b"<< /Type /Page /Contents 8 0 R >>"), (8, _shown("stale"))]
    new = [
        (11, b"<< /Type /Catalog /Pages 12 0 R >>"), (12, b"<< /Type /Pages /Kids [13 0 R 4 0 R 12 0 R] >>"), (13, b"<< /Type /Pages /Kids [15 0 R 14 0 R] >>"),
        (4, b"<< /Type /Page /Contents 5 0 R >>"), (14, b"<< /Type /Page /Contents 9 0 R >>"), (15, b"<< /Type /Page /Contents 8 0 R >>"),
        (5, _shown("third")), (8, _shown("first")), (9, _shown("second")),
    ]
    assert P.read_pdf(_plain(old, 1))["text"] == "stale"
    assert P.read_pdf(_plain(old, 1) + _plain(new, 11))["text"] == "first\nsecond\nthird"


def test_pdf_filters():
    import base64
    import zlib

    text = b"BT (abc) Tj ET " * 40
    runs = b"".join(bytes([len(text[i : i + 100]) - 1]) + text[i : i + 100] for i in range(0, len(text), 100)) + bytes([255]) + b" " + bytes([128])
    packed = {"ASCIIHexDecode": text.hex().encode() + b">", "ASCII85Decode": base64.a85encode(text) + b"~>", "RunLengthDecode": runs, "FlateDecode": zlib.compress(text)}
    for name, data in packed.items():
        assert P._FILTERS[name](data, 10_000).strip() == text.strip()
    assert P._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), 99) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    both = base64.a85encode(zlib.compress(text)) + b"~>"
    page = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] >>"), (3, b"<< /Type /Page /Contents 4 0 R >>"), (4, _shown("", b"/Filter [/ASCII85Decode /FlateDecode]", both))]
    assert P.read_pdf(_plain(page, 1))["text"].split() == ["abc"] * 40


def test_pdf_predictors():
    rows = [bytes((i * 7 + r * 13) & 255 for i in range(6)) for r in range(5)]
    packed, above = bytearray(), bytes(6)
    for tag, row in enumerate(rows):
        packed.append(tag)
        for i, x in enumerate(row):
            left, up, corner = (row[i - 2] if i > 1 else 0), above[i], (above[i - 2] if i > 1 else 0)
            p = left + up - corner
            paeth = left if abs(p - left) <= min(abs(p - up), abs(p - corner)) else up if abs(p - up) <= abs(p - corner) else corner
            packed.append((x - (0, left, up, (left + up) // 2, paeth)[tag]) & 255)
        above = row
    assert P._unpredict(bytes(packed), 15, 6, 2) == b"".join(rows)


def test_pdf_that_unpacks_to_too_much_reads_as_empty(monkeypatch):
    import zlib

    monkeypatch.setattr(P, "INFLATED", 10_000)
    data = zlib.compress(b"BT (x) Tj ET " * 5_000)
    page = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] >>"), (3, b"<< /Type /Page /Contents 4 0 R >>"), (4, _shown("", b"/Filter /FlateDecode", data))]
    assert P.read_pdf(_plain(page, 1)) == {"xml": [], "text": "", "images": []}
