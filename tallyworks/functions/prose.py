"""Sentences for people: issues, rules, counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MATCH_FIELDS
from .money import display, format_money


def issue_message(issue: Column, grouped: bool = False) -> Column:
    """Text of an issue; grouped: amounts with thousands separators, as on screen."""
    money = format_money if grouped else display
    found = F.lit("，票面") if grouped else F.lit("，票面=")
    return (
        F.when(issue["kind"] == "totalMismatch", F.concat(F.lit("价税合计对不上：金额+税额="), money(issue["expected_cents"]), found, money(issue["found_cents"])))
        .when(issue["kind"] == "numberLength", F.format_string("发票号码位数异常：%d 位，应为 %d 位", issue["found_len"], issue["expected_len"]))
        .when(issue["kind"] == "badDate", F.concat(F.lit("开票日期无法识别："), issue["raw"]))
        .when(issue["kind"] == "futureDate", F.concat(F.lit("开票日期晚于今天："), issue["date"]))
        .when(issue["kind"] == "missingField", F.concat(F.lit("缺少"), issue["field"]))
    )


def is_error(issue: Column) -> Column:
    return issue["kind"].isin("totalMismatch", "badDate")


def issue_messages(issues: Column) -> Column:
    """All messages in one cell."""
    return F.coalesce(F.array_join(F.transform(issues, lambda i: issue_message(i)), "；"), F.lit(""))


def match_field_label(field: Column) -> Column:
    return F.coalesce(*[F.when(field == k, F.lit(v)) for k, v in MATCH_FIELDS.items()])


def describe_keywords(keywords: Column) -> Column:
    return F.array_join(keywords, " 或 ")


def describe_condition(condition: Column) -> Column:
    label = match_field_label(condition["field"])
    return F.when(F.size(condition["keywords"]) == 0, F.concat(label, F.lit(" 未填写关键词"))).otherwise(
        F.concat(label, F.lit(" 包含 "), describe_keywords(condition["keywords"]))
    )


def describe_rule(conditions: Column) -> Column:
    return F.when(F.size(conditions) == 0, "没有条件，不会匹配任何发票").otherwise(F.array_join(F.transform(conditions, describe_condition), " 并且 "))


def default_rule_name(conditions: Column) -> Column:
    first = F.get(conditions, 0)
    base = F.concat(match_field_label(first["field"]), F.lit("："), F.array_join(first["keywords"], "、"))
    more = F.concat(base, F.lit(" 等 "), F.size(conditions).cast("string"), F.lit(" 项条件"))
    usable = (F.size(conditions) > 0) & (F.size(first["keywords"]) > 0)
    return F.when(usable, F.when(F.size(conditions) > 1, more).otherwise(base)).otherwise("")


def is_auto_name(name: Column, conditions: Column) -> Column:
    return F.regexp_replace(name, r"(?U)^\s+|\s+$", "") == default_rule_name(conditions)


# Bands of priority, highest first.
BANDS = [
    (200, "AI 建议采纳", "接受 AI 建议时自动生成，压过全部内置规则"),
    (150, "税收分类简称", "税局自己的分类，最可靠"),
    (120, "项目名称", "分类简称不够细时的补充"),
    (100, "票种", "火车票、行程单这类票据本身就说明了用途"),
    (50, "销售方兜底", "最容易误伤，排最后"),
]


def priority_note(priority: Column) -> Column:
    """struct(text, warn) about where a priority stands among the bands."""
    note = lambda text, warn=False: F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(warn).alias("warn"))
    out = F.when(priority > BANDS[0][0], note(f"高于全部内置规则（最高 {BANDS[0][0]}），会盖过更可靠的税收分类简称规则", True))
    for value, label, hint in BANDS:
        out = out.when(priority == value, note(f"与内置的「{label}」同档：{hint}"))
    for (above, a, _), (below, b, _) in zip(BANDS, BANDS[1:], strict=False):
        out = out.when((priority < above) & (priority > below), note(f"介于「{b}」({below}) 和「{a}」({above}) 之间"))
    return out.otherwise(note("低于全部内置规则，只有在没有别的规则命中时才轮得到它"))


def validate_draft(category: Column, conditions: Column, priority: Column) -> Column:
    """Why a rule can't be saved yet, or null."""
    return (
        F.when(F.regexp_replace(F.coalesce(category, F.lit("")), r"(?U)\s", "") == "", "请先选择或填写费用类别")
        .when(F.coalesce(F.size(conditions), F.lit(0)) <= 0, "至少要有一个条件：没有条件的规则会匹配所有发票，因此会被直接忽略")
        .when(F.exists(conditions, lambda c: F.size(c["keywords"]) <= 0), "每个条件都要至少填一个关键词，否则这条规则永远不会命中")
        .when(priority.isNull() | (priority.cast("double") != F.floor(priority.cast("double"))), "优先级必须是整数")
    )


def count_label(count: Column) -> Column:
    return F.concat(count.cast("string"), F.lit(" 张"))
