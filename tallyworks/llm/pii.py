"""Personal data: pattern spans, and terms that give the protected values away; DataFrame functions only.

1. Base spans (e-mail and IP addresses, card and phone numbers) come from patterns whose matches can't start
   inside one another, so long texts cost linear time. A text is cut by each pattern into pieces and
   matches; running sums of their lengths, in one window per text and kind, are the places.
2. Every value is a protected entity c. A word t within ``CONTEXT`` characters of it, in at least ``SUPPORT``
   different texts (copies are no evidence), is a candidate. How strongly t reveals c is the pointwise mutual
   information of both over the whole corpus as a share of what there is to know of c:
   PMI(t; c) / IC(c) = 1 + log P(c|t) / IC(c), with P(c|t) from counts of documents and IC(c) = -log P(c).
3. Counts near entities alone bound P(c|t) from above, which rules out common words before the corpus is read
   for the words that are left; nothing is decided on that bound.
4. Terms with a share of at least ``GENERALISE`` are generalised wherever they occur, those of at least ``REMOVE``
   are removed. A term inside a base span goes with that span.

Words are runs of three letters or more, compared in lower case. Only word counts, spans and, for documents that hold a
disclosing term, texts are ever shuffled.

Edge cases: a null text is empty and has no span; rows equal in id and text are one document, each of them
gets the result; an empty table gives an empty result; spans may overlap between kinds; an entity in every
document has nothing to disclose; extra columns are ignored by ``find_spans`` and carried by ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, row_key, table

#: The kinds in their order, and what stands for them.
KINDS = ["email", "ip", "card", "phone", "term"]
TERM = KINDS.index("term")
PATTERNS = [
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
#: What a text must hold for a pattern to be tried.
NEEDS = ["@", ".", "", "+"]
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
WORD = r"(?<![\p{L}\p{M}])\p{L}[\p{L}\p{M}]{2,}+"
#: Characters on either side of an entity, different texts, shares of an entity's information.
CONTEXT, SUPPORT, GENERALISE, REMOVE = 60, 3, 0.9, 0.97
#: Most candidate words, and most ids of documents with disclosing terms, that are broadcast; more are joined by a shuffle.
BROADCAST = 200_000


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 16 to 19 digits pass: every second one from the right counts double, its own digits added."""
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for k in range(19):
        one = F.substring(padded, k + 1, 1)
        total = total + F.ascii(F.translate(one, "0123456789", "0246813579") if k % 2 else one) - 48
    return total % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    n = F.length(_digits(match))
    return F.when(kind == 1, match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")).when(kind == 2, n.between(16, 19) & _luhn(_digits(match))).when(kind == 3, n.between(8, 15)).otherwise(F.lit(True))


def _entity(kind: Column, match: Column) -> Column:
    """A value's name, the same for its different spellings."""
    return F.when(match.isNotNull() & _valid(kind, match), F.xxhash64(kind, F.when(kind == 0, F.lower(match)).when(kind == 1, match).otherwise(_digits(match))))


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def base_matches(texts: DataFrame) -> DataFrame:
    """(d, h, kind, i, gap characters before the match, size, valid, c entity, before, p entity before the piece, after) of texts (d, h, text).

    A row per match and one for the rest of the text: before are the words that end the piece, after those that start it.
    """
    tries = [
        F.struct(F.lit(k).alias("kind"), F.when(F.contains("text", F.lit(need)), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("found"))
        for k, (pattern, need) in enumerate(zip(PATTERNS, NEEDS, strict=True))
    ]
    met = texts.select("d", "h", "text", F.inline(F.array(*tries))).where(F.size("found") > 0)
    pieces = F.coalesce(*[F.when(F.col("kind") == k, F.split("text", pattern, -1)) for k, pattern in enumerate(PATTERNS)])
    zipped = F.arrays_zip(pieces.alias("piece"), F.col("found").alias("match"), F.concat(F.array(F.lit(None).cast("string")), "found").alias("last"))
    each = met.select("d", "h", "kind", F.posexplode(zipped).alias("i", "z")).select("d", "h", "kind", "i", "z.*")
    size = F.length("piece")
    # words that the cut goes through don't count, nor parts of addresses
    cut = lambda x, partial: F.lower(F.regexp_replace(F.when(size > CONTEXT, F.regexp_replace(x, partial, "")).otherwise(x), r"\S*@\S*", " "))
    before, after = cut(F.right("piece", F.lit(CONTEXT)), r"^[\p{L}\p{M}]+"), cut(F.left("piece", F.lit(CONTEXT)), r"[\p{L}\p{M}]+$")
    own, last = _entity(F.col("kind"), F.col("match")), _entity(F.col("kind"), F.col("last"))
    return each.select(
        "d", "h", "kind", "i", size.alias("gap"), F.length("match").alias("size"), own.isNotNull().alias("valid"), own.alias("c"),
        F.when(own.isNotNull(), words(before)).alias("before"), last.alias("p"), F.when(last.isNotNull(), words(after)).alias("after"),
    )


def places(matches: DataFrame) -> DataFrame:
    """(d, h, kind, start, end, share) of matches (d, h, kind, i, gap, size, share): code points, end exclusive."""
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("d", "h", "kind").orderBy("i"))
    return matches.where("size IS NOT NULL").withColumn("end", upto).select("d", "h", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "share", "valid").where("valid").drop("valid")


def disclosing_terms(texts: DataFrame, matches: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """((t, share) of the terms that reveal an entity, (d, h, t, word) of all candidates' occurrences by document)."""
    spark = texts.sparkSession
    near = matches.where("c IS NOT NULL").select("d", "h", "c", F.explode("before").alias("t")).unionAll(matches.where("p IS NOT NULL").select("d", "h", F.col("p").alias("c"), F.explode("after").alias("t")))
    near = materialize(near.distinct(), "near")
    pairs = near.groupBy("c", "t", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("c", "t").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support)
    entities = matches.where("c IS NOT NULL").select("d", "h", "c").distinct().groupBy("c").agg(F.count(F.lit(1)).alias("nc"))
    pairs = materialize(pairs.join(entities, "c"), "pairs")
    nothing = spark.createDataFrame([], "t string, share double"), spark.createDataFrame([], "d bigint, h bigint, t string, word string")
    if pairs.isEmpty():
        return nothing
    total = float(texts.select("d", "h").distinct().count())

    def share(with_term: str) -> Column:
        ic = F.log2(F.lit(total) / F.col("nc"))
        return F.when(ic > 0, 1 + F.log2(F.col("n") / F.col(with_term)) / ic)

    seen = materialize(near.select("d", "h", "t").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("some")), "seen")
    pairs = materialize(pairs.join(seen, "t").withColumn("most", share("some")).where(F.col("most") >= least), "candidates")
    terms = materialize(pairs.select("t").distinct(), "terms")
    n = terms.count()
    if not n:
        return nothing
    spoken = texts.select("d", "h", F.explode(words(F.col("text"))).alias("word")).withColumn("t", F.lower("word"))
    held = materialize(spoken.join(F.broadcast(terms) if n <= BROADCAST else terms, "t").select("d", "h", "t", "word").distinct(), "held")
    everywhere = materialize(held.select("d", "h", "t").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("nt")), "everywhere")
    found = pairs.join(everywhere, "t").withColumn("share", share("nt")).where(F.col("share") >= least)
    return materialize(found.groupBy("t").agg(F.max("share").alias("share")), "disclosing"), held


def term_matches(texts: DataFrame, terms: DataFrame, held: DataFrame) -> DataFrame:
    """Matches of the terms in the documents that hold them, as ``places`` takes them."""
    by_doc = materialize(held.join(terms, "t").groupBy("d", "h").agg(F.collect_set("word").alias("own"), F.map_from_entries(F.collect_set(F.struct("word", "share"))).alias("shares")), "holders")
    few = by_doc.count() <= BROADCAST
    keys = by_doc.select("d", "h")
    read = texts.join(F.broadcast(keys) if few else keys, ["d", "h"], "left_semi").dropDuplicates(["d", "h"])
    read = read.join(by_doc, ["d", "h"])
    # words are letters and marks, so none needs escaping
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), F.array_join("own", "|"), F.lit(r")(?![\p{L}\p{M}])"))
    read = read.select("d", "h", "text", "shares", pattern.alias("pattern"))
    found = F.regexp_extract_all("text", F.col("pattern"), F.lit(0))
    zipped = F.arrays_zip(F.split("text", F.col("pattern"), F.lit(-1)).alias("piece"), found.alias("match"))
    each = read.select("d", "h", "shares", F.posexplode(zipped).alias("i", "z")).where("z.match IS NOT NULL")
    return each.select(
        "d", "h", F.lit(TERM).alias("kind"), "i", F.length("z.piece").alias("gap"), F.length("z.match").alias("size"), F.element_at("shares", F.col("z.match")).alias("share"), F.lit(True).alias("valid")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d, h = row_key(docs, id_col, text_col)
    return docs.select(d.alias("d"), h.alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(d, h, kind, start, end, share of disclosure for terms) of all spans, keyed as by ``row_key``."""
    texts = _keyed(docs, id_col, text_col)
    matches = materialize(base_matches(texts), "matches")
    base = matches.select("d", "h", "kind", "i", "gap", "size", F.lit(None).cast("double").alias("share"), "valid").distinct()
    terms, held = disclosing_terms(texts, matches, support, least)
    if terms.isEmpty():
        return places(base)
    spans = places(base.unionByName(term_matches(texts, terms, held)))
    order = Window.partitionBy("d", "h").orderBy("start", "end", "kind")
    is_base = F.col("kind") != TERM
    covered = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)) > F.col("start")
    met = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing)) < F.col("end")
    return spans.withColumn("inside", ~is_base & (F.coalesce(covered, F.lit(False)) | F.coalesce(met, F.lit(False)))).where("NOT inside").drop("inside")


def _named(spans: Column) -> Column:
    """kind:start:end, joined by commas, of sorted structs."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def by_document(spans: DataFrame) -> DataFrame:
    """(d, h, n_email, n_ip, n_card, n_phone, base, spans) of documents with spans."""
    per = spans.groupBy("d", "h").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{name}") for k, name in enumerate(KINDS[:TERM])],
        F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("all"),
    )
    return per.select("d", "h", *[f"n_{name}" for name in KINDS[:TERM]], _named(F.filter("all", lambda s: s["kind"] != TERM)).alias("base"), _named(F.col("all")).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, least: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with sanitised texts: values stand as [EMAIL] and so on, disclosing terms as [TERM] or not at all."""
    spans = find_spans(docs, id_col, text_col, support, least)
    # overlapping spans go as one, under the first one's name
    order = Window.partitionBy("d", "h").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    mark = F.when((F.col("kind") == TERM) & (F.col("share") >= remove), "").otherwise(F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)), F.lit("]")))
    runs = spans.withColumns({"fresh": fresh, "mark": mark}).withColumn("run", F.sum("fresh").over(order))
    runs = runs.groupBy("d", "h", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("mark", F.struct("start", "end", "kind")).alias("mark"))
    lists = runs.groupBy("d", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end", "mark"))).alias("runs"))
    d, h = row_key(docs, id_col, text_col)
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), d.alias("d"), h.alias("h")).join(lists, ["d", "h"], "left")
    text = F.col(f"row.`{text_col}`")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("runs", lambda r: r["end"]))
    clean = F.concat(
        F.array_join(F.transform(F.arrays_zip(F.col("runs").alias("run"), starts.alias("from")), lambda z: F.when(z["run"].isNotNull(), F.concat(F.substring(text, (z["from"] + 1).cast("int"), (z["run"]["start"] - z["from"]).cast("int")), z["run"]["mark"])).otherwise(F.lit(""))), ""),
        F.substring(text, (F.element_at("runs", -1)["end"] + 1).cast("int"), F.lit(2**31 - 1)),
    )
    return own.select(*[F.when(F.col("runs").isNull(), text).otherwise(clean).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = by_document(find_spans(docs))
    d, h = row_key(docs)
    out = docs.select("doc_id", d.alias("d"), h.alias("h")).join(found, ["d", "h"], "left")
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:TERM]]
    base, spans = F.coalesce("base", F.lit("")), F.coalesce("spans", F.lit(""))
    return out.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))
