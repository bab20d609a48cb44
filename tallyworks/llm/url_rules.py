"""URL verdicts: fixed rules by host and path, association rules mined by FP-growth for the rest.

URLs that a fixed rule judges are the labelled examples, counted once for each distinct
URL. Their tokens (host labels, host suffixes, path segments, words of them, query keys)
with a verdict item are mined by Spark's FP-growth on a bounded sample (``SAMPLE`` rows, in
which every URL keeps its share of the rows). Tokens that occur in the same sampled rows are
one item, so a URL that comes very often costs one item and not every subset of its tokens;
an item is there where any of its tokens is. Rules ``items => verdict`` below the least
support or confidence are pruned, and so are rules no more confident than one of their
parts; no other bound cuts rules. The rest is an inverted index: each rule is filed under
its rarest item, so a URL looks up only its own tokens. The matching rule of highest
confidence (then support, then more items, then text order) gives the verdict; no rule
gives allow.

Edge cases: a null URL or one without ``://`` has an empty host and path, no
rule and verdict allow; without labelled URLs of both kinds nothing is mined;
repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: (host and path, verdict); a rule fits its host and all subdomains.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Most URLs mined, least support (share of them) and confidence of a rule.
SAMPLE, SUPPORT, CONFIDENCE = 20_000, 0.005, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to / ? # or the end, A-Z in lower case; path: then up to ? or #."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


_WORDS = re.compile(r"[^\W\d_]{2,}")


def tokens(url: str | None) -> list[str]:
    """Distinct tokens of a URL; numbers stand as one token."""
    rest = (url or "").partition("://")[2]
    if not rest:
        return []
    authority = re.match(r"[^/?#]*", rest)[0]
    host = authority.lower().split("@")[-1].split(":")[0]
    tail = rest[len(authority) :]
    path, _, query = tail.partition("#")[0].partition("?")
    labels = [x for x in host.split(".") if x]
    out = {f"h:{x}" for x in labels} | {"s:" + ".".join(labels[i:]) for i in range(max(0, len(labels) - 3), len(labels))}
    out |= {f"w:{w}" for x in labels for w in _WORDS.findall(x) if "-" in x}
    for x in (s for s in path.split("/") if s):
        low = x.lower()
        out |= {"p:#" if low.isdigit() else f"p:{low}"} | {f"w:{w}" for w in _WORDS.findall(low)}
    out |= {f"q:{x.partition('=')[0].lower()}" for x in query.split("&") if x}
    return sorted(out)


def _with_tokens(df: DataFrame) -> DataFrame:
    """``df`` (url, verdict, n) as (verdict, n, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([tokens(x.as_py()) for x in batch.column("url")], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("verdict"), batch.column("n"), made], ["verdict", "n", "tokens"])

    return df.select("url", "verdict", "n").mapInArrow(run, "verdict string, n bigint, tokens array<string>")


#: An item (the tokens of the same rows), and a rule: items, verdict, confidence, support.
Item = tuple[str, ...]
Rule = tuple[frozenset[Item], str, float, float]


def sampled(labelled: DataFrame, bound: int) -> DataFrame:
    """(url, verdict, n): distinct labelled URLs with their rows, or with their share of about ``bound`` rows."""
    distinct = labelled.select("url", "verdict").where("url is not null and verdict is not null").groupBy("url", "verdict").agg(F.count(F.lit(1)).alias("n"))
    distinct = materialize(distinct, "urls")
    total = distinct.agg(F.sum("n")).first()[0] or 0
    if total <= bound:
        return distinct
    part = F.col("n") * F.lit(bound / total)
    # what is left of a row after whole ones is a row for that share of the URLs
    odd = (F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < (part - F.floor(part)) * 1_000_000).cast("long")
    return distinct.select("url", "verdict", (F.floor(part) + odd).alias("n")).where("n > 0")


def mine(labelled: DataFrame, bound: int = SAMPLE) -> list[Rule]:
    """The rules, best first, from at most about ``bound`` labelled (url, verdict) rows."""
    key = F.xxhash64("verdict", "tokens")
    # hashed before tokens are exploded, else a long URL would be hashed once for each of its tokens
    summed = _with_tokens(sampled(labelled, bound)).groupBy("verdict", "tokens").agg(F.sum("n").alias("n"))
    rows = materialize(summed.select("*", key.alias("k"), F.xxhash64(F.lit(1), key).alias("k2")), "baskets")
    total = rows.agg(F.sum("n")).first()[0] or 0
    if not total:
        return []
    # tokens of equal occurrence: the same rows, by their number and two sums of their hashes
    alike = rows.select("n", "k", "k2", F.explode("tokens").alias("t")).groupBy("t").agg(
        F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("k2").alias("k2")
    )
    # an item is named by what its tokens have in common, never by the tokens, which may be very many
    items = materialize(alike.where(F.col("n") >= SUPPORT * total).select(F.concat(F.hex("k"), F.hex("k2")).alias("item"), "t"), "items")
    baskets = materialize(
        rows.select("k", "verdict", "n", F.explode("tokens").alias("t")).join(items, "t").groupBy("k", "verdict", "n").agg(F.collect_set("item").alias("items")),
        "baskets",
    )
    # a basket for each row of the bounded sample
    each = baskets.select(F.explode(F.sequence(F.lit(1), F.col("n"))), F.array_append("items", F.concat(F.lit("="), "verdict")).alias("items"))
    n = each.count()
    least = SUPPORT * total / max(1, n) * (1 - 1e-9)
    if least > 1:  # too few rows hold any frequent token
        return []
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=CONFIDENCE).fit(each.select("items"))
    verdict = F.col("consequent")[0]
    found = model.associationRules.where(verdict.startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("="))).select(
        F.sort_array("antecedent").alias("left"), F.substring(verdict, 2, 100).alias("verdict"), "confidence", (F.col("support") * F.lit(n / total)).alias("support")
    )
    found = materialize(found, "rules")
    part = F.explode(F.transform("left", lambda x: F.array_remove("left", x)))
    parts = found.select("left", "verdict", "confidence", part.alias("part")).join(
        found.select(F.col("left").alias("part"), "verdict", F.col("confidence").alias("c")), ["part", "verdict"]
    )
    kept = found.join(parts.where("c >= confidence").select("left", "verdict"), ["left", "verdict"], "left_anti")
    found = [(r["left"], r["verdict"], r["confidence"], r["support"]) for r in kept.toLocalIterator()]
    held: dict[str, list[str]] = {x: [] for left, *_ in found for x in left}
    for r in items.join(F.broadcast(kept.select(F.explode("left").alias("item")).distinct()), "item").toLocalIterator():
        held[r["item"]].append(r["t"])
    rules = [(frozenset(tuple(sorted(held[x])) for x in left), verdict, c, s) for left, verdict, c, s in found]
    return sorted(rules, key=lambda r: (-r[2], -r[3], -len(r[0]), sorted(r[0]), r[1]))


class RuleIndex:
    """Rules filed under their rarest item (the one in the fewest rules, then text order)."""

    def __init__(self, rules: list[Rule]):
        often: dict[Item, int] = {}
        for left, *_ in rules:
            for x in left:
                often[x] = often.get(x, 0) + 1
        self.rules = rules
        self.item = {t: x for x in often for t in x}
        self.index: dict[Item, list[int]] = {}
        for k, (left, *_) in enumerate(rules):
            self.index.setdefault(min(left, key=lambda x: (often[x], x)), []).append(k)

    def best(self, url: str | None) -> int | None:
        """Number of the first rule whose items the URL all has."""
        own = {self.item[t] for t in tokens(url) if t in self.item}
        return min((k for x in own for k in self.index.get(x, ()) if self.rules[k][0] <= own), default=None)


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, bound: int = SAMPLE) -> DataFrame:
    """``pages`` with host, path, rule, verdict, mined (the association rule that decided, else null) and confidence."""
    made = ("host", "path", "rule", "verdict", "mined", "confidence", "_fixed")
    keep = [c for c in pages.columns if c not in made]
    host, path = host_path(F.col("url"))
    seen = pages.select(*keep, host.alias("host"), path.alias("path")).withColumn("_fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    mined = mine(seen.select("url", F.col("_fixed.verdict").alias("verdict")), bound)
    sent = pages.sparkSession.sparkContext.broadcast(RuleIndex(mined))
    flat = seen.select(*keep, "host", "path", F.col("_fixed.rule").alias("rule"), F.col("_fixed.verdict").alias("verdict"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            verdict = batch.column("verdict").to_pylist()
            why: list[str | None] = [None] * len(verdict)
            sure: list[float | None] = [None] * len(verdict)
            for i, (url, given) in enumerate(zip(batch.column("url").to_pylist(), verdict, strict=True)):
                if given is None:
                    k = index.best(url)
                    verdict[i] = "allow" if k is None else index.rules[k][1]
                    if k is not None:
                        why[i], sure[i] = " ".join("|".join(x) for x in sorted(index.rules[k][0])), index.rules[k][2]
            columns = [pa.array(verdict, pa.string()) if n == "verdict" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(why, pa.string()), pa.array(sure, pa.float64())], [*batch.schema.names, "mined", "confidence"])

    return flat.mapInArrow(run, f"{schema}, mined string, confidence double")


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "mined", "confidence")
