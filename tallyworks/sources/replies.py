"""Replies of a model, as pure functions of their text; calling a model is left to a hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import make_field, merge_from
from ..functions.kinds import kind_from_title, kind_label
from ..functions.money import parse_money
from ..functions.text import extract_json, meaningful, strip
from ..operators.classify import proposed_rule
from ..schema import ITEM, SOURCES

# Members of a reading, the field each fills and the name under which the model says that it is unsure.
READING = {
    "发票号码": ("number", "发票号码"),
    "发票代码": ("code", "发票代码"),
    "开票日期": ("issued_on", "开票日期"),
    "购买方名称": ("buyer_name", "购买方名称"),
    "购买方纳税人识别号": ("buyer_tax_id", "购买方"),
    "销售方名称": ("seller_name", "销售方名称"),
    "销售方纳税人识别号": ("seller_tax_id", "销售方"),
    "备注": ("remark", "备注"),
    "金额": ("amount_excl_tax", "金额"),
    "税额": ("tax", "税额"),
    "价税合计": ("total", "价税合计"),
}
_TEXT = T.StringType()
_ROW = T.StructType([T.StructField(n, _TEXT) for n in ("名称", "金额", "税率", "税额")])
SCHEMA = T.StructType(
    [T.StructField("票种", _TEXT), *(T.StructField(n, _TEXT) for n in READING), T.StructField("明细", T.ArrayType(_ROW)), T.StructField("看不清的字段", T.ArrayType(_TEXT))]
)
ANSWER = T.StructType([T.StructField("类别", _TEXT), T.StructField("理由", _TEXT)])
MONEY = ("amount_excl_tax", "tax", "total")


def _mentions(texts: Column, name: str) -> Column:
    return F.exists(texts, lambda t: t.contains(name))


def apply_vision(invoices: DataFrame, reply: str) -> DataFrame:
    """Invoice rows with the reading in column ``reply`` merged in, and reply_error; fields the model is unsure of count half."""
    read = F.from_json(extract_json(F.col(reply)), SCHEMA, {"mode": "PERMISSIVE"})
    rows = invoices.withColumn("_r", read)
    base = SOURCES["vision"][0]
    unsure = F.coalesce(F.col("_r.看不清的字段"), F.array().cast("array<string>"))
    parts: dict[str, Column] = {}
    for member, (field, said) in READING.items():
        value = meaningful(F.col(f"_r.{member}"))
        value = parse_money(value) if field in MONEY else value
        sure = F.when(_mentions(unsure, said), F.lit(base * 0.5)).otherwise(F.lit(base))
        parts[field] = merge_from(F.col(field), make_field(value, "vision", sure))
    parts["kind"] = F.coalesce("kind", kind_from_title(meaningful(F.col("_r.票种"))))
    item = lambda i: F.struct(
        *[
            {"name": meaningful(i["名称"]), "amount_cents": parse_money(meaningful(i["金额"])), "tax_rate": meaningful(i["税率"]), "tax_cents": parse_money(meaningful(i["税额"]))}
            .get(f.name, F.lit(None).cast(f.dataType))
            .alias(f.name)
            for f in ITEM.fields
        ]
    )
    read_items = F.filter(F.transform(F.coalesce(F.col("_r.明细"), F.array().cast(T.ArrayType(_ROW))), item), lambda i: i["name"].isNotNull())
    parts["items"] = F.when(F.coalesce(F.size("items"), F.lit(0)) > 0, F.col("items")).otherwise(read_items)
    parts["reply_error"] = F.when(extract_json(F.col(reply)).isNull(), "模型没有返回 JSON")
    return rows.withColumns(parts).drop("_r")


def describe() -> Column:
    """What a model is told about an invoice row: kind, seller, at most five items, remark."""
    line = lambda head, c: F.concat(F.lit(head), c)
    items = F.transform(F.slice("items", 1, 5), lambda i: line("项目：", i["name"]))
    parts = F.concat(
        F.array(line("票种：", kind_label(F.col("kind"))), line("销售方：", F.col("seller_name.value"))), items, F.array(line("备注：", F.col("remark.value")))
    )
    return F.array_join(F.array_compact(parts), "\n")


def parse_suggestion(reply: Column, categories: list[str]) -> Column:
    """struct(category, reason, proposed_rule, error) of an invoice row; the category must be one of the list."""
    json = extract_json(reply)
    answer = F.from_json(json, ANSWER)
    category, reason = strip(answer["类别"]), strip(F.coalesce(answer["理由"], F.lit("")))
    rule = proposed_rule(category)
    error = (
        F.when(json.isNull(), "模型没有返回 JSON")
        .when(category.isNull(), "模型返回的 JSON 无法解析")
        .when(~category.isin(*categories), F.concat(F.lit("模型给出了列表之外的类别「"), category, F.lit("」，已忽略。")))
        .when(rule.isNull(), "这张发票没有可以写成规则的特征。")
    )
    ok = error.isNull()
    return F.struct(F.when(ok, category).alias("category"), F.when(ok, reason).alias("reason"), F.when(ok, rule).alias("proposed_rule"), error.alias("error"))


def ask(rows: DataFrame, prompt: str, reply_fn: Callable[[str], str], reply: str = "reply") -> DataFrame:
    """rows with the hook's reply to column ``prompt``; a failing call gives null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{reply}` string"

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else reply_fn(text)
        except Exception:  # one failed call is one row without a reply
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{reply: [one(x) for x in batch[prompt]]})

    return rows.mapInPandas(run, schema)
