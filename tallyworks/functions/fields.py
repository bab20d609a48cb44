"""Values with provenance: making, merging and trusting them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import RANKS, REVIEW_THRESHOLD, SOURCES
from .money import clamp_confidence


def threshold() -> Column:
    """0.9 as a float: fields compare as floats, so a reading of exactly 0.90 needs no review."""
    return F.lit(REVIEW_THRESHOLD).cast("float")


def make_field(value: Column, source: str | Column, confidence: float | Column | None = None) -> Column:
    """A field of a reading; a null value gives the missing field."""
    name = F.lit(source) if isinstance(source, str) else source
    if confidence is None:
        sure = F.coalesce(*[F.when(name == s, F.lit(c).cast("float")) for s, (c, _) in SOURCES.items()])
    else:
        sure = clamp_confidence(F.lit(confidence) if isinstance(confidence, int | float) else confidence)
    return F.struct(
        value.alias("value"),
        F.when(value.isNull(), F.lit(0.0).cast("float")).otherwise(sure).alias("confidence"),
        F.when(value.isNull(), F.lit("missing")).otherwise(name).alias("source"),
    )


def empty_field(kind: str = "string") -> Column:
    return make_field(F.lit(None).cast(kind), "missing")


def manual_field(value: Column) -> Column:
    return make_field(value, "manual")


def rank(source: Column) -> Column:
    return F.coalesce(*[F.when(source == name, F.lit(k)) for name, k in RANKS.items()], F.lit(0))


def source_label(source: Column) -> Column:
    return F.coalesce(*[F.when(source == name, F.lit(label)) for name, (_, label) in SOURCES.items()])


def present(field: Column) -> Column:
    return field["value"].isNotNull()


def merge_from(own: Column, other: Column) -> Column:
    """The newcomer wins iff it has a value and the incumbent has none, a lower rank, or equal rank and lower confidence."""
    return merge_all(own, other)


def merge_all(*fields: Column) -> Column:
    """Folds readings from first to last; a full tie keeps the earlier, and without any value the first stays."""

    def ranked(field: Column, order: int) -> Column:
        only = lambda c: F.when(present(field), c)
        return F.struct(
            present(field).alias("has"), only(rank(field["source"])).alias("rank"), only(field["confidence"]).alias("sure"), F.lit(-order).alias("order"), field.alias("field")
        )

    return F.greatest(*[ranked(f, k) for k, f in enumerate(fields)])["field"] if len(fields) > 1 else fields[0]


def merge_agg(field: Column, order: Column) -> Column:
    """The same fold as an aggregate over rows: best rank, then confidence, then the least order; null values never win."""
    key = F.struct(rank(field["source"]), field["confidence"], -order)
    return F.max_by(F.when(present(field), field), F.when(present(field), key))


def needs_review(field: Column) -> Column:
    return field["value"].isNull() | (field["confidence"] < threshold())


def trust(field: Column) -> Column:
    return F.when(field["value"].isNull(), "missing").when(field["confidence"] < threshold(), "review").otherwise("ok")


# Labels of trust, names of the fields that a reviewer is sent to.
TRUST_LABELS = {"ok": "已确认", "review": "待复核", "missing": "未识别"}
REVIEWED = {"number": "发票号码", "issued_on": "开票日期", "seller_name": "销售方名称", "total": "价税合计"}


def trust_label(field: Column) -> Column:
    t = trust(field)
    return F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in TRUST_LABELS.items()])


def fields_needing_review() -> Column:
    """Names, in order, of the key fields of an invoice row that are missing or unsure."""
    return F.array_compact(F.array(*[F.when(needs_review(F.col(n)), F.lit(label)) for n, label in REVIEWED.items()]))


def min_key_confidence() -> Column:
    one = F.lit(1.0).cast("float")
    return F.least(*[F.coalesce(F.col(f"{n}.confidence"), F.lit(0.0).cast("float")) for n in ("number", "issued_on", "total")], one)


def is_complete() -> Column:
    """Number, date and total trusted, and a seller at any confidence."""
    return ~needs_review(F.col("number")) & ~needs_review(F.col("issued_on")) & ~needs_review(F.col("total")) & present(F.col("seller_name"))
