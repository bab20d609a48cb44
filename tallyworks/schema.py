"""Types, names and constants of the ledger."""

from __future__ import annotations

from pyspark.sql import types as T

UNCATEGORISED = "未分类"
NO_NUMBER = "(无号码)"
REVIEW_THRESHOLD = 0.90

# Sources from least to most trusted, with the confidence a fresh reading starts at and the label.
SOURCES = {
    "missing": (0.0, "未识别"),
    "vision": (0.75, "AI 识别"),
    "pdfText": (0.90, "PDF 文本层"),
    "qrCode": (0.95, "二维码"),
    "xml": (1.0, "发票 XML"),
    "manual": (1.0, "人工录入"),
}
RANKS = {name: rank for rank, name in enumerate(SOURCES)}

# Invoice kinds and their labels.
KINDS = {
    "digitalSpecial": "数电票（专用）",
    "digitalGeneral": "数电票（普通）",
    "vatSpecial": "增值税专用发票",
    "vatGeneral": "增值税普通发票",
    "vatElectronicGeneral": "增值税电子普通发票",
    "vatRoll": "增值税普通发票（卷式）",
    "train": "铁路电子客票",
    "airItinerary": "航空运输电子客票行程单",
    "taxi": "出租车票",
    "fixedAmount": "定额发票",
    "toll": "过路过桥费发票",
    "other": "其他票据",
}
FULLY_DIGITAL = ("digitalSpecial", "digitalGeneral")
EIGHT_DIGITS = ("vatSpecial", "vatGeneral", "vatElectronicGeneral", "vatRoll")
DEDUCTIBLE = ("digitalSpecial", "vatSpecial")

# What a rule's condition can look at, kinds of file, outcomes of an import.
MATCH_FIELDS = {"taxCategory": "税收分类简称", "itemName": "项目名称", "sellerName": "销售方名称", "remark": "备注", "kind": "票种"}
FILE_KINDS = {"pdf": "PDF", "ofd": "OFD", "image": "图片", "xml": "XML", "zip": "压缩包", "unknown": "未知格式"}
STATUSES = ("imported", "needsReview", "alreadyImported", "failed")

TEXT_FIELDS = ("number", "code", "issued_on", "check_code", "buyer_name", "buyer_tax_id", "seller_name", "seller_tax_id", "remark")
MONEY_FIELDS = ("amount_excl_tax", "tax", "total")
MERGED_FIELDS = (*TEXT_FIELDS[:8], *MONEY_FIELDS, "remark")


def field_of(value: T.DataType) -> T.StructType:
    """A value with how sure and from where it is."""
    return T.StructType([T.StructField("value", value), T.StructField("confidence", T.FloatType()), T.StructField("source", T.StringType())])


TEXT_FIELD, MONEY_FIELD = field_of(T.StringType()), field_of(T.LongType())

ITEM = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("spec", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("quantity", T.StringType()),
        T.StructField("unit_price_cents", T.LongType()),
        T.StructField("amount_cents", T.LongType()),
        T.StructField("tax_rate", T.StringType()),
        T.StructField("tax_cents", T.LongType()),
    ]
)
ISSUE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("expected_cents", T.LongType()),
        T.StructField("found_cents", T.LongType()),
        T.StructField("found_len", T.IntegerType()),
        T.StructField("expected_len", T.IntegerType()),
        T.StructField("raw", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("field", T.StringType()),
    ]
)
INVOICE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("kind", T.StringType()),
        *(T.StructField(n, TEXT_FIELD) for n in TEXT_FIELDS[:8]),
        *(T.StructField(n, MONEY_FIELD) for n in MONEY_FIELDS),
        T.StructField("items", T.ArrayType(ITEM)),
        T.StructField("remark", TEXT_FIELD),
        T.StructField("category", T.StringType()),
        T.StructField("category_rule", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("issues", T.ArrayType(ISSUE)),
    ]
)
CONDITION = T.StructType([T.StructField("field", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType()))])
RULE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("conditions", T.ArrayType(CONDITION)),
    ]
)
#: The ledger: the invoice and the flat columns that lists filter and sort by.
LEDGER = T.StructType(
    [
        *INVOICE.fields,
        T.StructField("number_s", T.StringType()),
        T.StructField("code_s", T.StringType()),
        T.StructField("dedup_key", T.StringType()),
        T.StructField("issued_on_s", T.StringType()),
        T.StructField("kind_label", T.StringType()),
        T.StructField("seller_s", T.StringType()),
        T.StructField("buyer_s", T.StringType()),
        T.StructField("total_cents", T.LongType()),
        T.StructField("tax_cents", T.LongType()),
        T.StructField("category_s", T.StringType()),
        T.StructField("category_rule_s", T.StringType()),
        T.StructField("min_confidence", T.DoubleType()),
        T.StructField("issue_count", T.LongType()),
        T.StructField("reviewed", T.BooleanType()),
        T.StructField("imported_at", T.StringType()),
    ]
)
#: Which invoice a file became.
FILE_HASH = T.StructType([T.StructField("file_hash", T.StringType()), T.StructField("id", T.LongType())])


def columns(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


#: Counts that follow the ledger, and the postings of its search.
COUNT_KEYS = columns(dedup_key=T.StringType(), n=T.LongType())
COUNT_CATEGORIES = columns(category_s=T.StringType(), n=T.LongType(), total_cents=T.LongType(), tax_cents=T.LongType())
COUNT_REPORTS = columns(report_id=T.LongType(), n=T.LongType(), total_cents=T.LongType())
COUNT_BAR = columns(name=T.StringType(), n=T.LongType(), review=T.LongType(), duplicates=T.LongType(), total_cents=T.LongType())
POSTING = columns(gram=T.StringType(), id=T.LongType())
REPORT = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("title", "applicant", "department", "note", "created_at"))])
REPORT_INVOICE = T.StructType([T.StructField("report_id", T.LongType()), T.StructField("invoice_id", T.LongType()), T.StructField("position", T.IntegerType())])
SETTING = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
