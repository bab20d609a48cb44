"""Categories by priority-ordered keyword rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kinds import kind_label
from ..functions.text import tax_category
from ..schema import MATCH_FIELDS, RULE, UNCATEGORISED
from .snapshot import materialize

# Fixed values: (category, priority, field, keywords) of the built-in rules, in their order.
SEEDS = [
    ("住宿", 150, "taxCategory", ["住宿服务"]),
    ("餐饮", 150, "taxCategory", ["餐饮服务"]),
    ("市内交通", 150, "taxCategory", ["旅客运输服务", "运输服务"]),
    ("办公用品", 150, "taxCategory", ["办公用品", "文具", "计算机", "耗材"]),
    ("通讯费", 150, "taxCategory", ["电信服务", "信息服务"]),
    ("软件与服务", 150, "taxCategory", ["信息技术服务", "软件", "技术服务", "咨询服务"]),
    ("快递邮寄", 150, "taxCategory", ["邮政服务", "收派服务", "物流辅助服务"]),
    ("会议费", 150, "taxCategory", ["会议", "会展服务"]),
    ("油费", 150, "taxCategory", ["成品油", "汽油", "柴油"]),
    ("过路过桥费", 150, "taxCategory", ["通行费"]),
    ("培训费", 150, "taxCategory", ["培训服务", "教育服务"]),
    ("广告宣传", 150, "taxCategory", ["广告服务", "设计服务", "印刷"]),
    ("房租物业", 150, "taxCategory", ["经营租赁", "不动产租赁", "物业管理"]),
    ("长途交通", 100, "kind", ["铁路电子客票"]),
    ("长途交通", 100, "kind", ["航空运输电子客票行程单"]),
    ("市内交通", 100, "kind", ["出租车票"]),
    ("过路过桥费", 100, "kind", ["过路过桥费发票"]),
    ("长途交通", 120, "itemName", ["高铁", "动车", "火车票", "机票", "客票"]),
    ("市内交通", 120, "itemName", ["网约车", "打车", "代驾", "停车"]),
    ("市内交通", 50, "sellerName", ["滴滴", "出行", "网约车", "出租汽车"]),
    ("长途交通", 50, "sellerName", ["航空", "铁路", "12306", "航空票务"]),
    ("住宿", 50, "sellerName", ["酒店", "宾馆", "旅馆", "民宿", "住宿"]),
    ("餐饮", 50, "sellerName", ["餐饮", "饭店", "餐厅", "食品", "茶饮", "咖啡"]),
    ("软件与服务", 50, "sellerName", ["科技", "网络", "信息技术", "云计算"]),
    ("快递邮寄", 50, "sellerName", ["顺丰", "快递", "速运", "物流", "邮政"]),
    ("油费", 50, "sellerName", ["石油", "石化", "加油"]),
]
#: Priority of a rule that an accepted suggestion makes.
SUGGESTED = 200
#: Rules that are compiled into one expression; more are matched by a join.
COMPILED = 500
#: Texts that hold a pair of characters, from which its postings are dealt over shares.
HOT = 100_000
# The kinds that a category usually comes on.
KIND_HINTS = {"长途交通": ["train", "airItinerary"], "市内交通": ["taxi"]}


def kinds_for_hint(category: str) -> list[str]:
    return KIND_HINTS.get(category, [])


def seed_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules, without ids."""
    rows = [
        (None, f"{MATCH_FIELDS[field]}：{'、'.join(keywords)}", category, priority, True, [(field, keywords)]) for category, priority, field, keywords in SEEDS
    ]
    return spark.createDataFrame(rows, RULE)


def seed_categories() -> list[str]:
    """Categories of the built-in rules, first seen first, the uncategorised last."""
    return [*dict.fromkeys(c for c, *_ in SEEDS), UNCATEGORISED]


def haystacks(items: Column | None = None) -> dict[str, Column]:
    """What each field of a condition looks at, as an array of an invoice row; nulls never match."""
    items = F.col("items") if items is None else items
    one = lambda c: F.array(c)
    return {
        "taxCategory": F.transform(items, lambda i: tax_category(i["name"])),
        "itemName": F.transform(items, lambda i: i["name"]),
        "sellerName": one(F.col("seller_name.value")),
        "remark": one(F.col("remark.value")),
        "kind": one(kind_label(F.col("kind"))),
    }


def _matches(hay: Column, keywords: list[str]) -> Column:
    words = [k for k in keywords if k]
    if not words:
        return F.lit(False)

    def any_of(h: Column) -> Column:
        out = h.contains(words[0])
        for w in words[1:]:
            out = out | h.contains(w)
        return F.coalesce(out, F.lit(False))

    return F.coalesce(F.exists(hay, any_of), F.lit(False))


def compile_rules(rules: list, hay: dict[str, Column] | None = None) -> Column:
    """struct(category, rule) of the first rule that holds, or null: highest priority, then lowest id, null ids last."""
    hay = hay or haystacks()
    order = sorted(
        enumerate(rules), key=lambda p: (-p[1]["priority"], p[1]["id"] is None, p[1]["id"] if p[1]["id"] is not None else 0, p[0])
    )
    out = F.lit(None).cast("struct<category: string, rule: string>")
    for _, r in reversed(order):
        if not r["enabled"] or not r["conditions"]:
            continue
        holds = F.lit(True)
        for c in r["conditions"]:
            holds = holds & _matches(hay[c["field"]], c["keywords"] or [])
        out = F.when(holds, F.struct(F.lit(r["category"]).alias("category"), F.lit(r["name"]).alias("rule"))).otherwise(out)
    return out


def _grams(text: Column) -> Column:
    """The characters and pairs of neighbouring characters of a text, once each."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    pairs = F.transform(F.arrays_zip(chars.alias("a"), F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0))).alias("b")), lambda z: F.concat(z["a"], F.coalesce(z["b"], F.lit(""))))
    return F.array_distinct(F.concat(chars, pairs))


def _asked(c: Column) -> Column:
    """What a condition asks, in one form."""
    return F.struct(c["field"].alias("field"), F.array_sort(F.array_distinct(F.filter(c["keywords"], lambda w: w != ""))).alias("words"))


def _condition(c: Column) -> Column:
    """The number of a condition: equal for equal fields and keywords."""
    return F.xxhash64(F.to_json(_asked(c)))


def match_by_join(invoices: DataFrame, rules: DataFrame, key: str, hot: int = HOT) -> DataFrame:
    """(key, category, rule) of the winning rule, for rule sets too large to compile.

    Every keyword is filed under its pair of characters that the fewest texts hold (one character if it is no
    longer), and meets only the texts that hold that pair; keywords are then checked in full. A text counts
    once however many invoices have it, a condition once however many rules have it. Pairs that more than ``hot``
    texts hold are dealt over shares. Rules then meet the different sets of conditions that invoices hold, each rule
    through its rarest condition.
    """
    # ties of priority and id go to the smaller name and conditions: the same on every run
    usable = materialize(rules.where("enabled and size(conditions) > 0").select(
        F.col("id").alias("_id"), "name", "category", "priority", F.xxhash64("id", "name", "category", "priority", F.to_json("conditions")).alias("_rule"),
        F.array_distinct(F.transform("conditions", _condition)).alias("_parts"), F.transform("conditions", _asked).alias("_asked"),
    ))
    parts = usable.select(F.explode("_asked").alias("c")).distinct().select(F.xxhash64(F.to_json("c")).alias("part"), "c.field", F.explode("c.words").alias("word"))
    parts = materialize(parts)
    hay = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("texts")) for n, c in haystacks().items()])
    looked_at = parts.select("field").distinct()
    seen = invoices.select(key, F.explode(hay).alias("h")).select(key, "h.field", F.explode("h.texts").alias("text")).where("text is not null")
    seen = materialize(seen.join(F.broadcast(looked_at), "field", "left_semi"))  # no more fields than a condition can name
    words = parts.select("field", "word").distinct()
    tried = words.select("field", "word", F.explode(_grams(F.col("word"))).alias("gram")).where((F.length("gram") == 2) | (F.length("word") == 1))
    texts = materialize(seen.select("field", "text").distinct())
    held = texts.select("field", "text", F.explode(_grams(F.col("text"))).alias("gram"))
    sizes = held.join(tried.select("field", "gram").distinct(), ["field", "gram"], "left_semi").groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"))
    # a keyword with a pair that no text holds can't match
    whole = Window.partitionBy("field", "word")
    filed = tried.join(sizes, ["field", "gram"], "left").withColumn("least", F.min(F.coalesce("n", F.lit(0))).over(whole)).where("least > 0")
    filed = filed.groupBy("field", "word").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.min("n").alias("n"))
    filed = materialize(filed.withColumn("shares", F.ceil(F.col("n") / hot).cast("int")))
    wanted = materialize(filed.select("field", "gram", "shares").distinct())
    dealt = held.join(wanted, ["field", "gram"]).withColumn("share", F.pmod(F.xxhash64("text"), F.col("shares")).cast("int"))
    spread = filed.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("field", "gram", "share", "word")
    met = dealt.join(spread, ["field", "gram", "share"]).where(F.expr("contains(text, word)")).select("field", "text", "word")
    hits = materialize(met.join(parts, ["field", "word"]).select("field", "text", "part").distinct())
    # the conditions that an invoice meets; invoices that meet the same ones count once
    met_by = materialize(seen.join(hits, ["field", "text"]).groupBy(key).agg(F.array_sort(F.collect_set("part")).alias("_met")))
    sets = materialize(met_by.select("_met").distinct())
    each = sets.select("_met", F.explode("_met").alias("part"))
    common = each.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # a rule meets the sets that hold its rarest condition; one that nothing meets can't match
    asked = usable.select("_rule", F.explode("_parts").alias("part")).join(common, "part", "left")
    rarest = asked.groupBy("_rule").agg(F.min_by("part", F.struct(F.coalesce("n", F.lit(0)), "part")).alias("part"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
    ruled = usable.join(rarest.select("_rule", "part"), "_rule").drop("_asked")
    won = each.join(ruled, "part").where(F.size(F.array_except("_parts", "_met")) == 0)
    best = F.min_by(F.struct("category", F.col("name").alias("rule")), F.struct(-F.col("priority"), F.col("_id").isNull(), "_id", "_rule"))
    return met_by.join(won.groupBy("_met").agg(best.alias("b")), "_met").select(key, "b.*")


def classify(invoices: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """Invoice rows with category and category_rule of the winning rule; rows that none matches get nulls."""
    few = rules.limit(COMPILED + 1).collect()
    if len(few) <= COMPILED:
        return invoices.withColumn("_m", compile_rules([r.asDict(True) for r in few])).withColumns(
            {"category": F.col("_m.category"), "category_rule": F.col("_m.rule")}
        ).drop("_m")
    found = match_by_join(invoices, rules, key).withColumnsRenamed({"category": "_c", "rule": "_r"})
    return invoices.join(found, key, "left").withColumns({"category": F.col("_c"), "category_rule": F.col("_r")}).drop("_c", "_r").select(*invoices.columns)


def is_manual(category: Column, rule: Column) -> Column:
    """Set by hand: a category without a rule's name."""
    return (F.coalesce(category, F.lit("")) != "") & (F.coalesce(rule, F.lit("")) == "")


def reclassify(invoices: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """Invoice rows with changed boolean; only the category decides whether a row changes, so a stale rule name may stay."""
    fresh = classify(invoices.withColumns({"_old": F.col("category"), "_old_rule": F.col("category_rule")}), rules, key)
    changed = ~is_manual(F.col("_old"), F.col("_old_rule")) & ~F.col("_old").eqNullSafe(F.col("category"))
    return (
        fresh.withColumn("changed", changed)
        .withColumns(
            {
                "category": F.when(F.col("changed"), F.col("category")).otherwise(F.col("_old")),
                "category_rule": F.when(F.col("changed"), F.col("category_rule")).otherwise(F.col("_old_rule")),
            }
        )
        .drop("_old", "_old_rule")
    )


def proposed_rule(category: Column) -> Column:
    """The rule that an accepted suggestion implies, of an invoice row: its first tax category, else its seller; null without either."""
    tax = F.get(F.array_compact(haystacks()["taxCategory"]), 0)
    seller = F.col("seller_name.value")
    field = F.when(tax.isNotNull(), "taxCategory").when(seller.isNotNull(), "sellerName")
    word = F.coalesce(tax, seller)
    label = F.when(field == "taxCategory", MATCH_FIELDS["taxCategory"]).otherwise(MATCH_FIELDS["sellerName"])
    rule = F.struct(
        F.lit(None).cast("bigint").alias("id"),
        F.concat(label, F.lit("："), word).alias("name"),
        category.alias("category"),
        F.lit(SUGGESTED).alias("priority"),
        F.lit(True).alias("enabled"),
        F.array(F.struct(field.alias("field"), F.array(word).alias("keywords"))).alias("conditions"),
    )
    return F.when(word.isNotNull(), rule)


def rule_categories(rules: DataFrame) -> DataFrame:
    """(category): distinct categories of rules and the uncategorised, in code point order with that last if no rule has it."""
    own = rules.select("category").where("category <> ''").distinct()
    pinned = own.sparkSession.createDataFrame([(UNCATEGORISED,)], "category string").join(own, "category", "left_anti")
    return own.withColumn("_k", F.lit(0)).unionByName(pinned.withColumn("_k", F.lit(1))).orderBy("_k", "category").drop("_k")


def group_by_category(rules: DataFrame) -> DataFrame:
    """(category, rules): rules of a category by priority and id, categories in pinyin order, the uncategorised last."""
    entry = F.struct((-F.col("priority")).alias("p"), F.coalesce("id", F.lit(9223372036854775807)).alias("i"), F.struct(*RULE.fieldNames()).alias("rule"))
    grouped = rules.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["rule"]).alias("rules"))
    return grouped.orderBy(F.col("category") == UNCATEGORISED, F.expr("category collate zh"))


def type_ahead(categories: DataFrame, typed: str) -> tuple[DataFrame, bool]:
    """(categories that contain what was typed, whether it would be a new one)."""
    word = typed.strip()
    return categories.where(F.col("category").contains(word)), bool(word) and categories.where(F.col("category") == word).isEmpty()


def disabled_count(rules: DataFrame) -> DataFrame:
    """One row: rules that are switched off."""
    return rules.agg(F.count_if(~F.col("enabled")).alias("disabled"))


def missing_defaults(defaults: DataFrame, rules: DataFrame) -> DataFrame:
    """The default rules of which no rule has the same category and conditions."""
    keyed = lambda df: df.withColumn("_c", F.to_json("conditions"))
    return keyed(defaults).join(keyed(rules).select("category", "_c"), ["category", "_c"], "left_anti").select(*defaults.columns)


def ordered(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("priority"), F.asc_nulls_last("id"))


def new_draft() -> dict:
    """What the editor starts a rule from."""
    return {"id": None, "name": "", "category": "", "priority": 150, "enabled": True, "conditions": [{"field": "taxCategory", "keywords": []}]}
