"""Dates as ISO text; "today" is always given, never read from the clock inside an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))


def _ranged(digits: Column) -> Column:
    """The first eight digits as a date of 2000-2999 with a month and day in range."""
    y, m, d = (F.substring(digits, a, n) for a, n in ((1, 4), (5, 2), (7, 2)))
    fits = y.between("2000", "2999") & m.between("01", "12") & d.between("01", "31")
    return F.when(fits, F.concat_ws("-", y, m, d))


def date_of_eight(raw: Column) -> Column:
    """Exactly eight ASCII digits, whatever stands between them."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(F.length(digits) == 8, _ranged(digits))


def date_of_prefix(raw: Column) -> Column:
    """Eight digits or more; the first eight count."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(F.length(digits) >= 8, _ranged(digits))


def labelled_date(text: Column) -> Column:
    """The issue date in compacted text: the Chinese form, else the ISO form."""
    chinese = r"(?U)开票日期:?(\d{4})年(\d{1,2})月(\d{1,2})日"
    iso = r"(?U)开票日期:?(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
    parts = lambda p: [F.regexp_extract(text, p, k) for k in (1, 2, 3)]
    (y, m, d), (y2, m2, d2) = parts(chinese), parts(iso)
    y, m, d = F.when(y != "", y).otherwise(y2), F.when(y != "", m).otherwise(m2), F.when(y != "", d).otherwise(d2)
    return F.when((y != "") & m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31), _iso(y, m, d))


def calendar_date(text: Column) -> Column:
    """A real calendar date, or null."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date"))


def format_date(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", "—").otherwise(F.replace(text, F.lit("-"), F.lit("/")))


def month_label(text: Column) -> Column:
    month = F.split_part(text, F.lit("-"), F.lit(2))
    return F.when(month != "", F.concat(month.try_cast("int").cast("string"), F.lit("月"))).otherwise(text)


def months_ago(today: Column, back: int) -> Column:
    """First day of the month that many months before."""
    return F.date_format(F.add_months(F.trunc(today, "month"), -back), "yyyy-MM-dd")


def preset_range(preset: str, today: Column) -> tuple[Column, Column] | None:
    """(from, to) as ISO text, '' for no bound; None for custom."""
    now = F.date_format(today, "yyyy-MM-dd")
    match preset:
        case "all":
            return F.lit(""), F.lit("")
        case "thisMonth":
            return months_ago(today, 0), now
        case "lastMonth":
            return months_ago(today, 1), F.date_format(F.last_day(F.add_months(today, -1)), "yyyy-MM-dd")
        case "last3":
            return months_ago(today, 2), now
        case "thisYear":
            return F.date_format(F.trunc(today, "year"), "yyyy-MM-dd"), now
        case "custom":
            return None
    raise ValueError(f"unknown preset {preset!r}")


def builder_range(preset: str, today: Column) -> tuple[Column, Column]:
    """Presets of the report builder: no upper bound."""
    return months_ago(today, {"thisMonth": 0, "last3": 2}[preset]), F.lit("")


def default_report_title(date: Column) -> Column:
    y, m = F.split_part(date, F.lit("-"), F.lit(1)), F.split_part(date, F.lit("-"), F.lit(2))
    titled = F.concat(y, F.lit("年"), m.try_cast("int").cast("string"), F.lit("月报销单"))
    return F.when((y != "") & (m != ""), titled).otherwise("报销单")
