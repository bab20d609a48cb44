"""Invoice kinds from titles, codes and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEDUCTIBLE, FULLY_DIGITAL, KINDS

# A title that is one of these codes.
TITLE_CODES = {"01": "vatSpecial", "04": "vatGeneral", "10": "vatElectronicGeneral", "31": "digitalGeneral", "32": "digitalSpecial"}
# Words in a title, the first that it contains decides.
TITLE_WORDS = [
    ("电子发票(增值税专用发票)", "digitalSpecial"),
    ("电子发票(铁路电子客票)", "train"),
    ("电子发票(航空运输电子客票行程单)", "airItinerary"),
    ("电子发票(普通发票)", "digitalGeneral"),
    ("数电票(专用)", "digitalSpecial"),
    ("数电票(普通)", "digitalGeneral"),
    ("全电发票(专用)", "digitalSpecial"),
    ("全电发票(普通)", "digitalGeneral"),
    ("增值税电子专用发票", "vatSpecial"),
    ("增值税电子普通发票", "vatElectronicGeneral"),
    ("增值税专用发票", "vatSpecial"),
    ("增值税普通发票(卷式)", "vatRoll"),
    ("增值税普通发票", "vatGeneral"),
    ("铁路电子客票", "train"),
    ("火车票", "train"),
    ("航空运输电子客票行程单", "airItinerary"),
    ("行程单", "airItinerary"),
    ("出租汽车", "taxi"),
    ("出租车", "taxi"),
    ("定额发票", "fixedAmount"),
    ("通行费", "toll"),
]
# Kind codes of QR payloads.
QR_CODES = {
    "01": "vatSpecial", "02": "vatSpecial", "03": "other", "04": "vatGeneral", "10": "vatElectronicGeneral", "11": "vatRoll",
    "14": "toll", "15": "other", "20": "vatSpecial", "22": "taxi", "31": "digitalGeneral", "32": "digitalSpecial",
}


def _choose(key: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()])


def kind_from_title(raw: Column) -> Column:
    """Exact code, else the first known words, else special or general by single words; null if nothing fits."""
    title = F.translate(F.regexp_replace(raw, r"(?U)\s", ""), "（）", "()")
    digital = title.contains("数电") | title.contains("全电")
    special = title.contains("专用") | title.contains("专票")
    general = title.contains("普通") | title.contains("普票")
    return F.coalesce(
        _choose(title, TITLE_CODES),
        *[F.when(title.contains(words), F.lit(kind)) for words, kind in TITLE_WORDS],
        F.when(special, F.when(digital, "digitalSpecial").otherwise("vatSpecial")),
        F.when(general, F.when(digital, "digitalGeneral").otherwise("vatGeneral")),
    )


def kind_from_qr_code(code: Column) -> Column:
    return _choose(code, QR_CODES)


def kind_label(kind: Column) -> Column:
    return _choose(kind, KINDS)


def is_fully_digital(kind: Column) -> Column:
    return F.coalesce(kind.isin(*FULLY_DIGITAL), F.lit(False))


def is_deductible(kind: Column) -> Column:
    return F.coalesce(kind.isin(*DEDUCTIBLE), F.lit(False))


def inferred_kind(number: Column, has_code: Column) -> Column:
    """A number of 20 bytes without a code is a general digital invoice."""
    return F.when((F.octet_length(number) == 20) & ~has_code, F.lit("digitalGeneral"))
