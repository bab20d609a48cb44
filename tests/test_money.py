from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyworks.functions import money as M
from tallyworks.functions.qr import parse_payload

LENIENT = [
    ("88.20", 8820), ("¥ 1,020.5", 102050), ("7", 700), ("7.", 700), (".5", 50), ("-3.07", -307), ("--3", -300), ("0.999", 100), ("1.234", 123), ("1.235", 124),
    ("1.2.3", None), ("", None), ("-", None), (".", None), ("abc", None), ("1-2", None), ("99999999999999999999", None), ("92233720368547758.08", None), ("1.23-", None),
    (None, None), ("共12元", 1200),
]
STRICT = [("1,234.5", 123450), ("￥ 8", 800), ("-0.05", -5), ("8元", None), ("1.2.3", None), ("", None), ("--1", None), (".75", 75), ("3.", 300), ("9007199254740993", None), ("0.125", 13)]


def test_lenient(values):
    assert values(M.parse_money, [a for a, _ in LENIENT]) == [b for _, b in LENIENT]


def test_strict(values):
    assert values(M.parse_yuan, [a for a, _ in STRICT]) == [b for _, b in STRICT]


def test_formats(values):
    cents = [0, 5, -5, 123456789, -100, None]
    assert values(M.to_decimal_string, cents, "bigint") == ["0.00", "0.05", "-0.05", "1234567.89", "-1.00", None]
    assert values(M.display, cents, "bigint") == ["¥0.00", "¥0.05", "-¥0.05", "¥1234567.89", "-¥1.00", None]
    assert values(M.format_money, cents, "bigint") == ["¥0.00", "¥0.05", "-¥0.05", "¥1,234,567.89", "-¥1.00", "—"]
    assert values(M.format_amount, cents, "bigint")[3] == "1,234,567.89"
    assert values(M.yuan_input, cents, "bigint")[-1] == ""
    assert values(lambda c: M.format_share(M.share_of(c, F.lit(400))), [100, 0], "bigint") == ["25.0%", "0.0%"]
    assert values(lambda c: M.share_of(c, F.lit(0)), [100], "bigint") == [0.0]
    assert values(M.clamp_confidence, [-1.0, 0.5, 7.0], "double") == [0.0, 0.5, 1.0]


def test_round_trip(spark):
    cents = spark.range(-3000, 12000, 7).withColumn("back", M.parse_money(M.to_decimal_string(F.col("id")))).where("back is distinct from id")
    assert cents.isEmpty()


@pytest.mark.parametrize(
    ("cents", "words"),
    [
        (0, "零圆整"), (5, "伍分"), (50, "伍角整"), (105, "壹圆零伍分"), (1000, "壹拾圆整"), (10_100, "壹佰零壹圆整"), (106_000, "壹仟零陆拾圆整"), (1_000_000, "壹万圆整"),
        (1_010_000, "壹万零壹佰圆整"), (10_000_000_100, "壹亿零壹圆整"), (123_456, "壹仟贰佰叁拾肆圆伍角陆分"), (-1, "负壹分"), (20_000_030_000, "贰亿零叁佰圆整"), (None, None),
    ],
)
def test_capital(cents, words):
    assert M.capital(cents) == words


def test_capital_column_agrees(values):
    places = [d * 10**k + e for k in range(18) for d in (1, 3, 9) for e in (0, 1, 50, 20_005, 10**k // 7)]
    cents = [x for x in [*places, *[-x for x in places], *range(0, 20_000, 77), 2**63 - 1, None] if x is None or abs(x) < 2**63]
    assert values(M.chinese_capital, cents, "bigint") == [M.capital(x) for x in cents]


def test_plans_hold_no_lambdas(spark):
    text = spark.createDataFrame([("1",)], "s string")
    plan = text.select(M.parse_money(F.col("s")), M.parse_yuan(F.col("s")), parse_payload(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


@given(st.integers(min_value=0, max_value=10**13))
@settings(max_examples=300)
def test_capital_reads_back(cents):
    """The words, read back by place, give the amount."""
    digits = {c: k for k, c in enumerate("零壹贰叁肆伍陆柒捌玖")}
    places = {"拾": 10, "佰": 100, "仟": 1000}
    total = Decimal(0)
    group = digit = whole = 0
    for c in M.capital(cents):
        if c in digits:
            digit = digits[c]
        elif c in places:
            group, digit = group + digit * places[c], 0
        elif c == "万":
            whole, group, digit = whole + (group + digit) * 10**4, 0, 0
        elif c == "亿":
            whole, group, digit = (whole + group + digit) * 10**8, 0, 0
        elif c == "圆":
            total, group, digit, whole = total + whole + group + digit, 0, 0, 0
        elif c in "角分":
            total, digit = total + Decimal(digit) / (10 if c == "角" else 100), 0
    assert total * 100 == cents


@given(st.lists(st.text("0123456789.-,¥ x", max_size=12), min_size=1, max_size=60))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_lenient_against_a_plain_reading(values, raws):
    def plain(raw):
        kept = "".join(c for c in raw if c in "0123456789.-")
        body = kept.lstrip("-")
        if body.count(".") > 1 or not body.replace(".", ""):
            return None
        yuan, _, fraction = body.partition(".")
        try:
            whole = int(yuan) if yuan else 0
            if "-" in yuan:
                return None
            if len(fraction) < 3:
                part = int(fraction) * (10 if len(fraction) == 1 else 1) if fraction else 0
            else:
                part = int(fraction[:2]) + (int(fraction[2]) >= 5)
        except ValueError:
            return None
        value = whole * 100 + part
        return (-value if kept.startswith("-") else value) if whole < 2**63 and whole * 100 + part < 2**63 else None

    assert values(M.parse_money, raws) == [plain(r) for r in raws]
