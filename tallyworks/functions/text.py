"""Fields read off flattened invoice text, and small text helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import labelled_date
from .fields import empty_field, make_field
from .kinds import kind_from_title
from .money import parse_money
from .staging import staged

# Labels that end a name.
BOUNDARIES = [
    "统一社会信用代码", "纳税人识别号", "识别号", "名称", "地址电话", "地址", "电话", "开户行及账号", "开户行", "账号", "销售方", "购买方",
    "项目名称", "货物或应税劳务", "规格型号", "合计", "价税合计", "备注", "开票人", "收款人", "复核", "销售方信息", "购买方信息",
]
_AMOUNT = r"(\d+(?:,\d{3})*\.\d{2})"
NAME = rf"(?U)名称:(.+?)(?:{'|'.join(BOUNDARIES)}|$)"
TAX_ID = r"(?:统一社会信用代码/?纳税人识别号|纳税人识别号|识别号):?([0-9A-Z]{15,20})"
TOTAL_MARKED = rf"(?U)\(小写\)¥?{_AMOUNT}"
TOTAL_NEAR = rf"(?U)价税合计[^\d]{{0,20}}¥?{_AMOUNT}"
SUBTOTALS = rf"(?U)合计¥{_AMOUNT}¥{_AMOUNT}"
#: Confidence of a total that only stands near its label.
NEAR_CONFIDENCE = 0.80


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def compact(text: Column) -> Column:
    """Without any white space; full-width punctuation as ASCII, one yen sign."""
    return F.translate(F.regexp_replace(text, r"(?U)\s", ""), "：（），￥", ":(),¥")


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def digits_after(text: Column, label: str, lengths: tuple[int, ...]) -> Column:
    """The whole run of digits after a label, if it has one of the lengths in bytes."""
    found = F.regexp_extract(text, rf"(?U){label}:?(\d+)", 1)
    return F.when(F.octet_length(found).isin(*lengths), found)


def number_of(text: Column) -> Column:
    return digits_after(text, "发票号码", (8, 20))


def code_of(text: Column) -> Column:
    return digits_after(text, "发票代码", (10, 12))


def check_code_of(text: Column) -> Column:
    return digits_after(text, "校验码", (20,))


def _marks(text: Column) -> dict[str, Column]:
    """Where the buyer's and the seller's parts start in compacted text, null without their markers."""
    at = lambda words: F.coalesce(*[F.when(F.locate(w, text) > 0, F.locate(w, text)) for w in words])
    return {"b": at(("购买方信息", "购买方")), "s": at(("销售方信息", "销售方"))}


def _parts(text: Column, b: Column, s: Column) -> dict[str, Column]:
    """The buyer's and the seller's part: up to the other one's start, else to the end."""
    end = F.length(text) + 1
    return {
        "buyer": F.when(b.isNotNull(), text.substr(b, F.when(s > b, s).otherwise(end) - b)),
        "seller": F.when(s.isNotNull(), text.substr(s, F.when(b > s, b).otherwise(end) - s)),
    }


def _own(part: Column, pattern: str) -> Column:
    found = strip(F.regexp_extract(part, pattern, 1))
    return F.nullif(found, F.lit(""))


def _every(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), strip), lambda x: x != "")


def parse_text(df: DataFrame, text: Column, source: str | Column = "pdfText") -> tuple[DataFrame, dict[str, Column]]:
    """(df with helper columns _t*, columns of an invoice (kind, fields, remark) read off a text layer); never fails.

    Parties are read from their parts where these are marked, else as the first and second in the text.
    """
    df, at = staged(df, {"c": compact(F.coalesce(text, F.lit("")))}, "_t0_")
    c = at["c"]
    df, m = staged(df, _marks(c), "_t1_")
    df, part = staged(df, {**_parts(c, m["b"], m["s"]), "marked": m["b"].isNotNull() | m["s"].isNotNull()}, "_t2_")
    unmarked = lambda pattern: F.when(~part["marked"], _every(c, pattern))
    df, v = staged(
        df,
        {
            "kind": kind_from_title(c),
            "number": number_of(c),
            "code": code_of(c),
            "issued_on": labelled_date(c),
            "check_code": check_code_of(c),
            "names": unmarked(NAME),
            "ids": unmarked(TAX_ID),
            "buyer_name": _own(part["buyer"], NAME),
            "seller_name": _own(part["seller"], NAME),
            "buyer_tax_id": _own(part["buyer"], TAX_ID),
            "seller_tax_id": _own(part["seller"], TAX_ID),
            "net": _group(c, SUBTOTALS, 1),
            "tax": _group(c, SUBTOTALS, 2),
            "marked_total": _group(c, TOTAL_MARKED),
            "near_total": _group(c, TOTAL_NEAR),
        },
        "_t3_",
    )
    df, cents = staged(df, {n: parse_money(v[n]) for n in ("net", "tax", "marked_total", "near_total")}, "_t4_")
    party = lambda name, every, k: make_field(F.when(part["marked"], v[name]).otherwise(F.get(v[every], k)), source)
    sure = cents["marked_total"].isNotNull()
    total = F.when(sure, make_field(cents["marked_total"], source)).otherwise(make_field(cents["near_total"], source, NEAR_CONFIDENCE))
    return df, {
        "kind": v["kind"],
        **{n: make_field(v[n], source) for n in ("number", "code", "issued_on", "check_code")},
        "buyer_name": party("buyer_name", "names", 0),
        "buyer_tax_id": party("buyer_tax_id", "ids", 0),
        "seller_name": party("seller_name", "names", 1),
        "seller_tax_id": party("seller_tax_id", "ids", 1),
        "amount_excl_tax": make_field(cents["net"], source),
        "tax": make_field(cents["tax"], source),
        "total": total,
        "remark": empty_field(),
    }


def legible_count(text: Column) -> Column:
    """ASCII letters and digits and unified ideographs."""
    return F.length(F.regexp_replace(text, r"[^0-9A-Za-z一-鿿]", ""))


def has_usable_text(text: Column) -> Column:
    return F.coalesce(legible_count(text) >= 40, F.lit(False))


def tax_category(name: Column) -> Column:
    """What stands between a leading pair of stars, or null."""
    found = strip(F.regexp_extract(name, r"(?s)^\*([^*]*)\*", 1))
    return F.when(found != "", found)


def normalise_tag(tag: Column) -> Column:
    """Local name in lower case, letters and digits only."""
    local = F.regexp_extract(tag, r"(?s)([^:]*)$", 1)
    return F.lower(F.regexp_replace(local, "[^0-9A-Za-z]", ""))


def meaningful(value: Column) -> Column:
    """Null for the ways in which a reply says nothing."""
    text = strip(value)
    return F.when((text != "") & ~text.isin("null", "N/A", "无", "-", "—", "未知"), text)


def extract_json(reply: Column) -> Column:
    """From the first { to the last }, or null."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def escape_xml(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape_xml(text: Column) -> Column:
    for safe, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def safe_file_name(title: Column) -> Column:
    cleaned = strip(F.regexp_replace(title, r'[\\/:*?"<>|]', ""))
    return F.when(cleaned != "", cleaned).otherwise("报销单")


def base_name(path: Column) -> Column:
    last = F.regexp_extract(path, r"(?s)([^\\/]*)$", 1)
    return F.when(last != "", last).otherwise(path)


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(value: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(value, _UPPER, _LOWER)


def like_ascii(value: Column, needle: str) -> Column:
    """value LIKE %needle% where only A-Z fold case, % and _ in the needle stay wild and nothing escapes."""
    pattern = needle.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\")
    return fold_ascii(value).like(f"%{pattern}%")


def split_keywords(raw: Column) -> Column:
    """Pasted keywords at the usual separators, without blanks."""
    return F.filter(F.transform(F.split(raw, "[,，、;；\n\t]"), strip), lambda x: x != "")


def add_keywords(own: Column, raw: Column) -> Column:
    """own and what a paste adds, first occurrence first."""
    return F.concat(own, F.array_except(split_keywords(raw), own))
