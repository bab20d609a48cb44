"""Derived amounts and consistency checks of invoice rows. Nothing is ever rejected, only noted."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import calendar_date
from ..functions.fields import make_field, rank
from ..functions.prose import is_error
from ..schema import EIGHT_DIGITS, FULLY_DIGITAL, ISSUE


def _derived(own: Column, a: Column, b: Column, value: Column) -> Column:
    """own, or the value that its two parents give: the weaker source, 0.95 of the lower confidence."""
    source = F.when(rank(a["source"]) <= rank(b["source"]), a["source"]).otherwise(b["source"])
    sure = (F.least(a["confidence"], b["confidence"]) * F.lit(0.95).cast("float")).cast("float")
    lone = own["value"].isNull() & a["value"].isNotNull() & b["value"].isNotNull()
    return F.when(lone, make_field(value, source, sure)).otherwise(own)


def infer_missing(net: Column, tax: Column, total: Column) -> dict[str, Column]:
    """The amounts, with the one that is missing derived from the other two."""
    return {
        "amount_excl_tax": _derived(net, tax, total, total["value"] - tax["value"]),
        "tax": _derived(tax, net, total, total["value"] - net["value"]),
        "total": _derived(total, net, tax, net["value"] + tax["value"]),
    }


def expected_number_length(kind: Column) -> Column:
    return F.when(kind.isin(*FULLY_DIGITAL), 20).when(kind.isin(*EIGHT_DIGITS), 8)


def _issue(kind: str, **parts: Column) -> Column:
    members = [F.lit(kind).alias("kind")]
    for f in ISSUE.fields[1:]:
        members.append(parts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name))
    return F.struct(*members)


def check(
    today: datetime.date | Column, kind: Column, number: Column, issued_on: Column, net: Column, tax: Column, total: Column
) -> Column:
    """Issues of an invoice, errors first, otherwise in the order of the checks. Takes plain values, not fields."""
    now = F.lit(today) if isinstance(today, datetime.date) else today
    sum_, wanted, date = net + tax, expected_number_length(kind), calendar_date(issued_on)
    missing = lambda value, name: F.when(value.isNull(), _issue("missingField", field=F.lit(name)))
    found = F.array_compact(
        F.array(
            F.when(sum_ != total, _issue("totalMismatch", expected_cents=sum_, found_cents=total)),
            missing(number, "发票号码"),
            missing(issued_on, "开票日期"),
            missing(total, "价税合计"),
            F.when(F.octet_length(number) != wanted, _issue("numberLength", found_len=F.octet_length(number), expected_len=wanted)),
            F.when(issued_on.isNotNull() & date.isNull(), _issue("badDate", raw=issued_on)).when(date > now, _issue("futureDate", date=issued_on)),
        )
    )
    return F.concat(F.filter(found, is_error), F.filter(found, lambda x: ~is_error(x)))


def infer_and_check(invoices: DataFrame, today: datetime.date) -> DataFrame:
    """Invoice rows with missing amounts derived and issues renewed."""
    derived = invoices.withColumns(infer_missing(F.col("amount_excl_tax"), F.col("tax"), F.col("total")))
    value = lambda n: F.col(f"{n}.value")
    return derived.withColumn("issues", check(today, F.col("kind"), *(value(n) for n in ("number", "issued_on", "amount_excl_tax", "tax", "total"))))
