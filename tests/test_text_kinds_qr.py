import datetime

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import dates as D
from tallyworks.functions import kinds as K
from tallyworks.functions import qr as Q
from tallyworks.functions import text as T


def test_titles(values):
    table = {
        "31": "digitalGeneral", "04": "vatGeneral", "电子发票（普通发票）": "digitalGeneral", "电 子 发 票(增值税专用发票)": "digitalSpecial", "增值税电子普通发票": "vatElectronicGeneral",
        "增值税普通发票（卷式）": "vatRoll", "电子发票（铁路电子客票）": "train", "某市出租汽车专用": "taxi", "数电票 增值税 专票": "digitalSpecial", "普票": "vatGeneral", "高速通行费": "toll", "收据": None,
        "": None,
    }
    assert values(K.kind_from_title, list(table)) == list(table.values())
    assert values(K.kind_label, ["taxi", "nope"]) == ["出租车票", None]
    assert values(K.is_deductible, ["vatSpecial", "taxi", None]) == [True, False, False]
    assert values(K.is_fully_digital, ["digitalGeneral", None]) == [True, False]


def parsed(spark, text, source="pdfText"):
    df, parts = T.parse_text(spark.createDataFrame([(text,)], "t string"), F.col("t"), source)
    return {k: (v["value"] if k != "kind" and v is not None else v) for k, v in df.select(*[c.alias(n) for n, c in parts.items()]).first().asDict().items()}


PAGE = """电子发票（普通发票）
发 票 号 码 ： 24312000000000001234
开票日期：2024 年 5 月 9 日
购买方信息 名 称：甲乙科技有限公司 统一社会信用代码/纳税人识别号：91310000MA1FL0000X
销售方信息 名称：丙丁餐饮管理有限公司 纳税人识别号：91320500MA1WX0000Y
项目名称 规格型号 单位 数量 单价 金额
合计 ￥1,200.00 ￥72.00
价税合计（大写） 壹仟贰佰柒拾贰圆整 （小写）￥1,272.00
"""


def test_standard_page(spark):
    p = parsed(spark, PAGE)
    assert p["kind"] == "digitalGeneral" and p["number"] == "24312000000000001234" and p["issued_on"] == "2024-05-09"
    assert (p["buyer_name"], p["seller_name"]) == ("甲乙科技有限公司", "丙丁餐饮管理有限公司")
    assert (p["buyer_tax_id"], p["seller_tax_id"]) == ("91310000MA1FL0000X", "91320500MA1WX0000Y")
    assert (p["amount_excl_tax"], p["tax"], p["total"], p["code"]) == (120000, 7200, 127200, None)


def test_seller_first_and_unmarked(spark):
    p = parsed(spark, "销售方 名称：卖家 纳税人识别号：A12345678901234 购买方 名称：买家 地址：x")
    assert (p["buyer_name"], p["seller_name"], p["seller_tax_id"]) == ("买家", "卖家", "A12345678901234")
    p = parsed(spark, "名称：一号公司 电话 名称：二号公司 备注")
    assert (p["buyer_name"], p["seller_name"]) == ("一号公司", "二号公司")


def test_numbers_are_whole_or_absent(spark):
    assert parsed(spark, "发票号码：123456789")["number"] is None
    assert parsed(spark, "发票号码：12345678 发票代码：011002000111 校验码：1234 5678 9012 3456 7890")["check_code"] == "12345678901234567890"
    assert parsed(spark, "发票号码：1234567８")["number"] is None  # ten bytes
    assert parsed(spark, None)["number"] is None and parsed(spark, "hello")["kind"] is None


def test_near_total_is_less_sure(spark):
    df, parts = T.parse_text(spark.createDataFrame([("价税合计 共计 12.50",)], "t string"), F.col("t"))
    total = df.select(parts["total"].alias("f")).first()["f"]
    assert total["value"] == 1250 and total["confidence"] == pytest.approx(0.8)


def test_dates(spark, values):
    assert parsed(spark, "开票日期：2024/13/01")["issued_on"] is None
    assert parsed(spark, "开票日期：2024-3-1")["issued_on"] == "2024-03-01"
    assert values(D.date_of_eight, ["20240301", "2024-03-01", "2024年03月01日", "2024031", "19991231", "20241301", "202403011"]) == ["2024-03-01"] * 3 + [None] * 4
    assert values(D.date_of_prefix, ["2024-03-01T10:22", "20240301", "202403"]) == ["2024-03-01", "2024-03-01", None]
    assert values(D.calendar_date, ["2024-02-29", "2023-02-29", "2024-2-3", "x", None]) == [datetime.date(2024, 2, 29), None, datetime.date(2024, 2, 3), None, None]
    assert values(D.month_label, ["2024-03-01", "x"]) == ["3月", "x"]
    assert values(D.format_date, ["2024-03-01", "", None]) == ["2024/03/01", "—", "—"]
    assert values(D.default_report_title, ["2026-08-02", ""]) == ["2026年8月报销单", "报销单"]
    today = F.lit(datetime.date(2024, 3, 31))
    assert [spark.range(1).select(*D.preset_range(p, today)).first()[:] for p in ("lastMonth", "last3", "thisYear")] == [
        ("2024-02-01", "2024-02-29"), ("2024-01-01", "2024-03-31"), ("2024-01-01", "2024-03-31"),
    ]
    assert D.preset_range("custom", today) is None
    assert spark.range(1).select(*D.builder_range("last3", today)).first()[:] == ("2024-01-01", "")


PAYLOADS = [
    "01,04,011002000111,12345678,99.9,20230815,AB 1,x", " 01,32,,24312000000000001234,5,2023-08-15 ", "02,04,a,12345678,1,20230815", "01,99,,,,20230815", "01,04,,123,1,2023", "", "plain", None,
    "https://x.invalid/?FPDM=011002000111&fphm=12345678&kjje=1&KJJE=2&kprq=20230815&jym=zz&jym=", "http://x.invalid/?fphm=24312000000000001234", "https://x.invalid/?kprq=20230815",
    "https://x.invalid/?fphm=12345678&fphm=9&kjje=3&kjje=", "https://x.invalid/?a?fphm=12345678&xfphm=87654321",
]


def test_payloads_of_rows_read_alike(spark, values):
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(PAYLOADS)], "k int, v string")
    assert [r["q"] for r in Q.with_reading(rows, F.col("v"), "q").orderBy("k").collect()] == values(Q.parse_payload, PAYLOADS)


def test_payloads(values):
    rows = values(Q.parse_payload, PAYLOADS)
    assert rows[11]["amount_cents"] is None and rows[11]["number"] == "12345678"
    assert rows[12] is None  # the key is "a?fphm", the other "xfphm"
    assert rows[0].asDict() == {"kind": "vatGeneral", "code": "011002000111", "number": "12345678", "amount_cents": 9990, "issued_on": "2023-08-15", "check_code": None}
    assert (rows[1]["kind"], rows[1]["number"], rows[1]["code"]) == ("digitalSpecial", "24312000000000001234", None)
    assert rows[3]["kind"] is None and rows[3]["issued_on"] == "2023-08-15"
    assert [rows[k] for k in (2, 4, 5, 6, 7, 10)] == [None] * 6
    assert (rows[8]["amount_cents"], rows[8]["check_code"], rows[8]["kind"]) == (200, "zz", None)
    assert rows[9]["kind"] == "digitalGeneral"


def test_small_helpers(values):
    assert values(T.tax_category, ["*住宿服务*房费", "住宿*x*", "**x", "* *x", "*a"]) == ["住宿服务", None, None, None, None]
    assert values(T.has_usable_text, ["字" * 40, "a" * 39, None]) == [True, False, False]
    assert values(T.normalise_tag, ["ns2:Total-Tax_Am", "A:B:C"]) == ["totaltaxam", "c"]
    assert values(T.extract_json, ["x {1} y {2} z", "none"]) == ["{1} y {2}", None]
    assert values(T.unescape_xml, ["&amp;lt;", "&lt;&quot;"]) == ["&lt;", '<"']
    assert values(T.safe_file_name, ['a/b:"c', " ? "]) == ["abc", "报销单"]
    assert values(T.base_name, ["a/b\\c.x", "c/"]) == ["c.x", "c/"]
    assert values(lambda c: T.like_ascii(c, "B_\\%"), ["ab1\\z", "AB2\\", "abx", "ÀB1\\"]) == [True, True, False, True]
    assert values(lambda c: T.like_ascii(c, "É"), ["é", "É"]) == [False, True]
    assert values(T.split_keywords, ["a，b、 c ;;d\te"]) == [["a", "b", "c", "d", "e"]]
    assert values(T.file_hash, [bytearray(b"abc")], "binary")[0].startswith("ba7816bf")
