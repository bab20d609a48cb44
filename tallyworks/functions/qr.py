"""Fields read off decoded QR payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import date_of_eight
from .fields import make_field, merge_from
from .kinds import kind_from_qr_code
from .money import parse_money
from .staging import staged, unstaged
from .text import strip

_NUMBER, _CODE = "^([0-9]{8}|[0-9]{20})$", "^([0-9]{10}|[0-9]{12})$"


def _only(value: Column, pattern: str) -> Column:
    return F.when(value.rlike(pattern), value)


def _reading(kind: Column, code: Column, number: Column, amount: Column, issued_on: Column, check: Column) -> Column:
    return F.struct(
        kind.alias("kind"), code.alias("code"), number.alias("number"), amount.alias("amount_cents"), issued_on.alias("issued_on"), check.alias("check_code")
    )


def _of_parts(parts: Column) -> Column:
    part = lambda k: F.get(parts, k)
    number, issued_on = _only(part(3), _NUMBER), date_of_eight(part(5))
    reading = _reading(kind_from_qr_code(part(1)), _only(part(2), _CODE), number, parse_money(part(4)), issued_on, _only(strip(part(6)), "^[0-9A-Za-z]+$"))
    return F.when((F.size(parts) >= 6) & (part(0) == "01") & (number.isNotNull() | issued_on.isNotNull()), reading)


def parse_list(payload: Column) -> Column:
    """The comma form, version 01 and six parts at least; needs a number or a date."""
    return _of_parts(F.split(payload, ",", -1))


def _last(payload: Column, key: str, value: str) -> Column:
    """The last value of a key (in any case) of a URL's query that fits a pattern, else null."""
    return F.nullif(F.regexp_extract(payload, rf"(?s)^[^?]*\?(?:.*&)?(?i:{key})=({value})(?:&|$)", 1), F.lit(""))


def parse_url(payload: Column) -> Column:
    """The verification URL; keys in any case, the last usable value of a key counts; needs a number."""
    number, code = _last(payload, "fphm", "[0-9]{8}|[0-9]{20}"), _last(payload, "fpdm", "[0-9]{10}|[0-9]{12}")
    kind = F.when(code.isNull() & (F.length(number) == 20), F.lit("digitalGeneral"))
    cents, day = parse_money(_last(payload, "kjje", "[^&]*")), date_of_eight(_last(payload, "kprq", "[^&]*"))
    return F.when(number.isNotNull(), _reading(kind, code, number, cents, day, _last(payload, "jym", "[^&]+")))


def _is_url(payload: Column) -> Column:
    return payload.startswith("http://") | payload.startswith("https://")


def parse_payload(raw: Column) -> Column:
    """struct(kind, code, number, amount_cents, issued_on, check_code), or null for what is no invoice's code."""
    payload = strip(raw)
    return F.when(_is_url(payload), parse_url(payload)).otherwise(parse_list(payload))


def with_reading(df: DataFrame, raw: Column, name: str = "reading") -> DataFrame:
    """df with the same struct as a column, for rows of one payload each: texts are picked first, then read once whichever form they came in."""
    df, t = staged(df, {"text": strip(raw)}, "_q0_")
    df, s = staged(df, {"text": t["text"], "url": _is_url(t["text"]), "parts": F.split(t["text"], ",", -1)}, "_q1_")
    part = lambda k: F.get(s["parts"], k)
    either = lambda key, value, k: F.when(s["url"], _last(s["text"], key, value)).otherwise(part(k))
    df, v = staged(
        df,
        {
            "number": either("fphm", "[0-9]{8}|[0-9]{20}", 3), "code": either("fpdm", "[0-9]{10}|[0-9]{12}", 2), "amount": either("kjje", "[^&]*", 4),
            "day": either("kprq", "[^&]*", 5), "check": F.when(s["url"], _last(s["text"], "jym", "[^&]+")).otherwise(_only(strip(part(6)), "^[0-9A-Za-z]+$")),
            "kind": F.when(~s["url"], part(1)), "url": s["url"], "fits": s["url"] | ((F.size(s["parts"]) >= 6) & (part(0) == "01")),
        },
        "_q2_",
    )
    df, w = staged(df, {"number": _only(v["number"], _NUMBER), "code": _only(v["code"], _CODE), "cents": parse_money(v["amount"]), "day": date_of_eight(v["day"])}, "_q3_")
    by_length = F.when(w["code"].isNull() & (F.length(w["number"]) == 20), F.lit("digitalGeneral"))
    kind = F.when(v["url"], by_length).otherwise(kind_from_qr_code(v["kind"]))
    found = v["fits"] & (w["number"].isNotNull() | (~v["url"] & w["day"].isNotNull()))
    return unstaged(df.withColumn(name, F.when(found, _reading(kind, w["code"], w["number"], w["cents"], w["day"], v["check"]))), "_q0_", "_q1_", "_q2_", "_q3_")


def apply_reading(qr: Column, invoice: dict[str, Column]) -> dict[str, Column]:
    """The invoice's columns with the reading merged in; special kinds print the amount without tax, others the total."""
    total = ~F.coalesce(qr["kind"].isin("vatSpecial", "digitalSpecial"), F.lit(False))
    amount = lambda wanted: make_field(F.when(wanted, qr["amount_cents"]), "qrCode")
    out = dict(invoice)
    out["kind"] = F.coalesce(invoice["kind"], qr["kind"])
    for name in ("code", "number", "issued_on", "check_code"):
        out[name] = merge_from(invoice[name], make_field(qr[name], "qrCode"))
    out["total"] = merge_from(invoice["total"], amount(total))
    out["amount_excl_tax"] = merge_from(invoice["amount_excl_tax"], amount(~total))
    return out
