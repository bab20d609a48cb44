"""Money in exact integer cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What is left of an amount and ".00": whole yuan, then two decimals, of which a single digit or none is filled up from the ending.
_PARTS = r"^(?=.*\d.*\.00$)-*(\d*)\.(?:(\d\d)(?:\d[^.]*)?(?:\.00)?|(\d)\.(0)0|\.?(00))$"
#: The same with a minus sign for the first decimal, which counts down from the yuan.
_MINUS = r"^-*(\d*)\.-(\d)(?:\d[^.]*)?$"


def _cents(kept: Column) -> Column:
    """Cents of a text of digits, points and minus signs with at most one point; half up on the third decimal alone; null where it doesn't parse or overflows."""
    point = F.locate(".", kept)
    up = F.when((point > 0) & F.substring(kept, point + 3, F.lit(1)).between("5", "9"), 1).otherwise(0)
    plain = F.regexp_replace(F.concat(kept, F.lit(".00")), _PARTS, "$1$2$3$4$5").try_cast("long")
    down = F.regexp_replace(kept, _MINUS, "$100").try_cast("long") - F.regexp_replace(kept, _MINUS, "$2").try_cast("long")
    size = F.try_add(F.when(kept.contains(".-"), down).otherwise(plain), up)
    return size * F.when(kept.startswith("-"), -1).otherwise(1)


def parse_money(raw: Column) -> Column:
    """Lenient text -> cents: only digits, points and minus signs count; null where no single amount is left."""
    return _cents(F.regexp_replace(raw, r"[^0-9.\-]", ""))


SAFE = (1 << 53) - 1


def parse_yuan(raw: Column) -> Column:
    """Strict form input -> cents: currency signs, commas and blanks go, the rest must be one decimal number in 53 bits."""
    cleaned = F.regexp_replace(raw, r"(?U)[¥￥,，\s]", "")
    value = _cents(cleaned)
    return F.when(cleaned.rlike(r"^-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$") & value.between(-SAFE, SAFE), value)


def to_decimal_string(cents: Column) -> Column:
    """1234 -> 12.34; minus in front."""
    return (cents.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(22,2)").cast("string")


def display(cents: Column) -> Column:
    """1234 -> ¥12.34, -5 -> -¥0.05."""
    text = to_decimal_string(cents)
    return F.when(cents < 0, F.concat(F.lit("-¥"), F.substring(text, 2, 40))).otherwise(F.concat(F.lit("¥"), text))


def format_money(cents: Column) -> Column:
    """With thousands separators; a dash for null."""
    size = F.abs(cents.cast("decimal(20,0)"))
    whole = F.format_number(F.floor(size / 100).cast("decimal(20,0)"), 0)
    text = F.concat(F.when(cents < 0, "-").otherwise(""), F.lit("¥"), whole, F.lit("."), F.lpad((size % 100).cast("int").cast("string"), 2, "0"))
    return F.coalesce(text, F.lit("—"))


def format_amount(cents: Column) -> Column:
    return F.replace(format_money(cents), F.lit("¥"), F.lit(""))


def yuan_input(cents: Column) -> Column:
    return F.coalesce(to_decimal_string(cents), F.lit(""))


def share_of(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def format_share(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def clamp_confidence(value: Column) -> Column:
    return F.greatest(F.least(value.cast("float"), F.lit(1.0).cast("float")), F.lit(0.0).cast("float"))


# Capital digits, places in a group of four, groups.
_DIGITS = "零壹贰叁肆伍陆柒捌玖"
_PLACES = ("", "拾", "佰", "仟")
_GROUPS = ("", "万", "亿", "万亿", "亿亿")


def capital(cents: int | None) -> str | None:
    """The amount in capital Chinese numerals; null stays null."""
    if cents is None:
        return None
    size = abs(cents)
    yuan, jiao, fen = size // 100, size // 10 % 10, size % 10
    if size == 0:
        return "零圆整"
    words: list[str] = []

    def gap() -> None:
        if words and words[-1] != "零":
            words.append("零")

    text = str(yuan) if yuan else ""
    text = text.zfill(-(-len(text) // 4) * 4)
    count = len(text) // 4
    for k in range(count):
        group = text[4 * k : 4 * k + 4]
        if group == "0000" or group[0] == "0":
            gap()
        if group == "0000":
            continue
        shown = group.lstrip("0")
        body = shown.rstrip("0")
        for i, digit in enumerate(body):
            if digit != "0":
                words.append(_DIGITS[int(digit)] + _PLACES[len(shown) - 1 - i])
            elif body[i - 1] != "0":
                words.append("零")
        words.append(_GROUPS[count - 1 - k])
    integer = "".join(words).rstrip("零") + ("圆" if yuan else "")
    if not jiao and not fen:
        tail = "整"
    elif not fen:
        tail = f"{_DIGITS[jiao]}角整"
    elif not jiao:
        tail = f"{'零' if yuan else ''}{_DIGITS[fen]}分"
    else:
        tail = f"{_DIGITS[jiao]}角{_DIGITS[fen]}分"
    return ("负" if cents < 0 else "") + integer + tail


#: From spelt-out digits to words, in order: places of zeros, empty groups, zeros that end a group, the tail, runs of zeros, what leads.
_CAPITAL_RULES = (
    ("零[仟佰拾]", "零"),
    ("零零零零(?:亿亿|万亿|亿|万)", "零"),
    ("零+(亿亿|万亿|亿|万|圆)", "$1"),
    ("零角零分|零分", "整"),
    ("零角", "零"),
    ("零+", "零"),
    ("^(?:零|圆零?)", ""),
)


def chinese_capital(cents: Column) -> Column:
    """The same as a column: every digit with its place, unit or part of a yuan, then shortened rule by rule."""
    yuan = 4 * len(_GROUPS)
    places = [_PLACES[3 - k % 4] + ("" if k % 4 < 3 else (*reversed(_GROUPS[1:]), "圆")[k // 4]) for k in range(yuan)]
    figures = F.translate(F.lpad(F.abs(cents.cast("decimal(20,0)")).cast("string"), yuan + 2, "0"), "0123456789", _DIGITS)
    words = F.regexp_replace(figures, "(.)" * (yuan + 2), "".join(f"${k + 1}{p}" for k, p in enumerate([*places, "角", "分"])))
    for pattern, short in _CAPITAL_RULES:
        words = F.regexp_replace(words, pattern, short)
    return F.when(cents == 0, "零圆整").otherwise(F.concat(F.when(cents < 0, "负").otherwise(""), words))
