"""Benchmark decontamination by canonical templates; DataFrame functions only.

Texts become template tokens: numbers (digits or words), names and units after numbers turn into
typed slots, other words into lower case, punctuation and layout go. A text is
read in three ways: names are the capitalised words that follow a lower-case
word (so not at the start of a sentence), or none (copies in other case), or
all capitalised words (names that start a sentence). Windows of ``WINDOW`` tokens are hashed and joined with the benchmark's. Windows with
fewer than ``LITERALS`` words besides slots say little, so those count where their real
values are equal, or where the document holds the whole item along that
alignment: all tokens in order, slots one-to-one. Windows without any word join
by their values only.

A document leaks an item when it has at least ``COVERAGE`` of the item's
distinct windows, or ``LONG`` of them (a run of 20 tokens of a long item), and
the slots agree: along one alignment (equal distance of
positions) each value of the item must stand for one value of the document, and
the other way round, in at least ``CONSISTENT`` of the cases. The alignments of a document and an item
are taken together, or else those that agree, so uses of the template that
don't agree never hide a copy. A re-parameterised question changes its values
consistently and is caught; an accidental template match is not.

Items shorter than a window are matched by one window of their own length; those
under ``SHORTEST`` tokens only by their real values, and one-token items only by
documents that are nothing else.

Documents are read once for the hashes, which carry no text. They meet an item only
through its telling windows, the rarest ones of which every leak must hold one, so a
phrase that many items share makes no pairs of documents and items. The few documents
that meet an item are read once more for its other windows and their values.

Edge cases: null and empty texts match nothing; items are
one item where id and text are equal, so each text of a repeated id is searched
and reported by itself; a text without id has a null item, unless the same text
has ids; rows equal in id and text are one document; a doc_id that is no number counts as null; an empty
benchmark keeps every document.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, row_key, table

WINDOW, LITERALS, SHORTEST, COVERAGE, LONG, CONSISTENT = 8, 4, 4, 0.5, 13, 0.8
#: Most benchmark windows, and most ids of documents with hits, that are broadcast; more are joined by a shuffle.
BROADCAST = 500_000
#: Unit words that make a slot after a number.
UNITS = [
    "%", "°c", "°f", "kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "ft", "in", "yd", "l", "ml", "s", "ms", "min", "h", "hr",
    "km/h", "mph", "m/s", "w", "kw", "v", "a", "hz", "j", "kj", "cal", "kcal", "pa", "k", "b", "kb", "mb", "gb", "tb", "usd", "eur", "gbp",
    "grams", "gram", "kilograms", "kilogram", "pounds", "pound", "ounces", "meters", "meter", "metres", "metre", "kilometers", "kilometer",
    "miles", "mile", "feet", "foot", "inches", "inch", "yards", "liters", "liter", "litres", "litre", "seconds", "second", "minutes", "minute",
    "hours", "hour", "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar", "euros", "euro", "cents", "percent", "degrees",
]
#: Number words that are slots.
NUMBERS = [
    "zero", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million",
]
NAME, UNIT, START = "\u0002", "\u0003", "\u0004"
_NUMBER = r"[\p{Nd}]+(?:[.,][\p{Nd}]+)*"
_WORD = r"[\p{L}][\p{L}\p{M}]*+"


def tokens(text: Column) -> Column:
    """Tokens of a text in lower case; names, units and other capitalised words carry a mark in front."""
    gap = rf"\s\p{{Z}}{NAME}{UNIT}{START}"
    # the characters looked for come first and what must stand before them is checked then: far fewer tries
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{gap}&&[^ ]][{gap}]*+| [{gap}]++", " ")
    marked = F.regexp_replace(marked, r"(?=\p{Lu}\p{Ll})(?<![\p{L}\p{M}])", START)
    marked = F.regexp_replace(marked, rf"{START}(?<=\p{{Ll}}[,;]? {START})", NAME)
    units = "|".join(sorted((u.replace("/", "\\/") for u in UNITS), key=len, reverse=True))
    marked = F.regexp_replace(F.lower(marked), rf"(\p{{Nd}} ?){START}?({units})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}$2")
    return F.regexp_extract_all(marked, F.lit(rf"[{NAME}{START}]?{_WORD}|{_NUMBER}|{UNIT}[^\s,;.!?)]+"), F.lit(0))


def bare(token: Column) -> Column:
    """The token without the mark of a capitalised word."""
    return F.when(F.substring(token, 1, 1).isin(NAME, START), F.substring(token, 2, 2**31 - 1)).otherwise(token)


def kind(token: Column) -> Column:
    """'' for a word, else the slot's type."""
    c = F.substring(token, 1, 1)
    number = c.between("0", "9") | bare(token).isin(NUMBERS) | c.rlike(r"\p{Nd}")
    return F.when(c == UNIT, "<unit>").when(number, "<number>").when(c == NAME, "<name>").otherwise("")


def _slot_hash(marks: tuple[str, ...], token: Column) -> Column:
    """Hash of the template token, where capitalised words of these marks are names."""
    c = F.substring(token, 1, 1)
    number = F.lit(1).cast("long")
    out = F.when(c > "9", F.when(token.isin(NUMBERS), number).otherwise(F.xxhash64(token)))
    for mark in (NAME, START):
        out = out.when(c == mark, F.when(bare(token).isin(NUMBERS), number).otherwise(F.lit(2).cast("long") if mark in marks else F.xxhash64(bare(token))))
    return out.when(c == UNIT, F.lit(3).cast("long")).otherwise(number)


def _shown(marks: tuple[str, ...], token: Column) -> Column:
    """The token, where capitalised words of these marks carry the mark of a name and others none."""
    named = F.substring(token, 1, 1).isin(*marks) if marks else F.lit(False)
    return F.when(named, F.concat(F.lit(NAME), bare(token))).otherwise(bare(token))


#: Which capitalised words are names: those inside sentences, none, all. A text is read in each way, so neither
#: case nor the place in a sentence decides.
READINGS = ((NAME,), (), (NAME, START))


def _all_windows(df: DataFrame, lengths: list[int], raw: bool) -> DataFrame:
    """``df`` (with _t tokens) with a row for each place and length: _length, _at, _read (hash in each reading; with raw one more, of the real values).

    Places are exploded before windows are hashed, so that the hashes are generated code and each text is read once.
    """
    hashes = [f"_hash{k}" for k in range(len(READINGS))] + (["_own"] if raw else [])
    made = df.withColumns({f"_hash{k}": F.transform("_t", partial(_slot_hash, m)) for k, m in enumerate(READINGS)})
    if raw:
        made = made.withColumn("_own", F.transform("_t", lambda x: F.xxhash64(bare(x))))
    at = made.withColumn("_at", F.explode(F.when(F.size("_t") >= min(lengths), F.sequence(F.lit(0), F.size("_t") - min(lengths)))))

    def window(n: int) -> Column:
        reads = [F.xxhash64(F.lit(n), F.slice(F.col(h), F.col("_at") + 1, F.lit(n))) for h in hashes]
        return F.struct(F.lit(n).alias("_length"), F.array(*reads).alias("_read"))

    if len(lengths) == 1 < lengths[0]:
        return at.select(*df.columns, "_at", F.inline(F.array(window(lengths[0]))))
    fits = [F.when((F.col("_at") + n <= F.size("_t")) & (F.lit(n > 1) | (F.size("_t") == 1)), window(n)) for n in lengths]
    return at.select(*df.columns, "_at", F.explode(F.array(*fits)).alias("_z")).where("_z is not null").select(*df.columns, "_at", "_z.*")


def benchmark_windows(bench: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame, list[int], bool]:
    """(_ik (of id and text), _item, _w, _length, _key, _ip, _n (tokens of the item), _thin (few words), _is, _windows), (_whole_ik, _it) of all
    items, window lengths in use, whether any window joins by real values.

    A window has a row for each reading that hashes it differently (_w) and one name for all (_key).
    """
    items = bench.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("_text")).agg(F.collect_set(item).alias("_ids"))
    items = items.select("_text", F.explode_outer("_ids").alias("_item")).select(
        F.xxhash64("_item", "_text").alias("_ik"), "_item", tokens(F.col("_text")).alias("_t")
    )
    items = items.where(F.size("_t") > 0)
    lengths = sorted({window, *(r[0] for r in items.where(F.size("_t") < window).select(F.size("_t")).distinct().collect())})
    w = _all_windows(items, lengths, True).where(
        ((F.size("_t") >= window) & (F.col("_length") == window)) | ((F.size("_t") < window) & (F.col("_length") == F.size("_t")))
    )
    w = w.withColumn("_s", F.slice("_t", F.col("_at") + 1, F.col("_length")))
    own = F.get("_read", F.lit(len(READINGS)))
    short = F.col("_length") < F.least(F.lit(SHORTEST), F.lit(window))
    rows, words, few = [], [], []
    for k, marks in enumerate(READINGS):
        shown, hashed = F.transform("_s", partial(_shown, marks)), F.get("_read", F.lit(k))
        words.append(F.size(F.filter(shown, lambda x: kind(x) == "")))
        few.append(words[k] < F.least(F.lit(LITERALS), F.col("_length")))
        # a row of its own only where the reading differs
        differs = F.lit(True) if not k else hashed != F.get("_read", F.lit(0))
        rows.append(F.when((words[k] > 0) & ~short & differs, F.struct(hashed.alias("w"), few[k].alias("thin"), F.lit(False).alias("raw"), shown.alias("s"))))
    none = (words[READINGS.index(())] == 0) | short
    rows.append(F.when(none, F.struct(own.alias("w"), F.lit(False).alias("thin"), F.lit(True).alias("raw"), F.transform("_s", bare).alias("s"))))
    w = w.withColumns({"_rows": F.array_compact(F.array(*rows)), "_key": F.struct(few[0].alias("few"), F.when(few[0], own).otherwise(F.get("_read", F.lit(0))).alias("w"))})
    total = w.groupBy("_ik").agg(F.countDistinct("_key").alias("_windows"))
    w = w.select("_ik", "_item", "_length", "_key", F.col("_at").alias("_ip"), F.size("_t").alias("_n"), F.explode("_rows").alias("_r")).join(total, "_ik")
    raw = not w.where("_r.raw").isEmpty()
    w = w.select("_ik", "_item", F.col("_r.w").alias("_w"), "_length", "_key", "_ip", "_n", F.col("_r.thin").alias("_thin"), F.col("_r.s").alias("_is"), "_windows")
    return w, items.select(F.col("_ik").alias("_whole_ik"), F.col("_t").alias("_it")), lengths, raw


def _slot(token: Column) -> Column:
    """The slot's type, where every capitalised word is a name."""
    named = (F.substring(token, 1, 1) == START) & ~bare(token).isin(NUMBERS)
    return F.when(named, "<name>").otherwise(kind(token))


def _pairs(i: str, v: str, slots: bool = False) -> Column:
    """Pairs of tokens without marks; all of them, or those that are slots."""
    pairs = F.arrays_zip(F.col(i).alias("i"), F.col(v).alias("v"))
    pairs = F.filter(pairs, lambda p: _slot(p["i"]) != "") if slots else pairs
    return F.transform(pairs, lambda p: F.struct(bare(p["i"]).alias("i"), bare(p["v"]).alias("v")))


def _one_to_one(pairs: Column) -> Column:
    n = F.size(F.array_distinct(pairs))
    return (n == F.size(F.array_distinct(pairs["i"]))) & (n == F.size(F.array_distinct(pairs["v"])))


def telling_windows(windows: DataFrame, coverage: float, long: int) -> DataFrame:
    """(_w, _length, _ik): of each item the windows of which every leak holds one at least.

    A leak holds some number of the item's windows, so it holds one of the rarest all - number + 1. Rarest means shared by the fewest items:
    a stock phrase of many items meets nobody unless an item consists of such. Windows of few words always tell, since
    a whole item may be found through one of them alone.
    """
    shared = windows.groupBy("_w", "_length").agg(F.countDistinct("_ik").alias("_f"))
    keys = windows.join(shared, ["_w", "_length"]).groupBy("_ik", "_key").agg(F.max("_f").alias("_f"), F.bool_or("_thin").alias("_few"), F.first("_windows").alias("_all"))
    place = F.row_number().over(Window.partitionBy("_ik").orderBy("_f", "_key"))
    needed = F.greatest(F.lit(1), F.least(F.ceil(F.col("_all") * F.lit(coverage) - F.lit(1e-9)), F.lit(long)))
    front = keys.withColumn("_place", place).where((F.col("_place") <= F.col("_all") - needed + 1) | F.col("_few")).select("_ik", "_key")
    return materialize(windows.join(front, ["_ik", "_key"], "left_semi").select("_w", "_length", "_ik").distinct(), "front")


def _doc_windows(texts: DataFrame, lengths: list[int], raw: bool) -> DataFrame:
    """(_d, _h, _length, _at, _w) of every place and reading of the texts."""
    exploded = _all_windows(texts.select("_d", "_h", tokens(F.col("_text")).alias("_t")), lengths, raw)
    # every other reading only where it differs from all before it
    reads = [F.get("_read", F.lit(k)) for k in range(len(READINGS) + raw)]
    other = [F.when(~r.isin(reads[:k]), r) if k else r for k, r in enumerate(reads)]
    return exploded.select("_d", "_h", "_length", "_at", F.explode(F.array(*other)).alias("_w")).where("_w is not null")


def find_leaks(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, coverage: float = COVERAGE, long: int = LONG, consistent: float = CONSISTENT,
) -> DataFrame:
    """(_d, _h, item, n_windows, n_matched, coverage, slots, agreement, first_at) of every leak."""
    windows, items, lengths, raw = benchmark_windows(bench, item, item_text, window)
    windows = materialize(windows, "windows")
    front = telling_windows(windows, coverage, long)
    if windows.count() <= BROADCAST:
        windows, items, front = F.broadcast(windows), F.broadcast(items), F.broadcast(front)
    d, h = row_key(docs, id_col, text_col)
    texts = docs.select(d.alias("_d"), h.alias("_h"), F.col(text_col).alias("_text"))
    # what an item's telling windows meet, counts before any value or other window is looked at
    pairs = materialize(_doc_windows(texts, lengths, raw).join(front, ["_w", "_length"]).select("_d", "_h", "_ik").distinct(), "pairs")
    own = pairs.select("_d", "_h").distinct()
    own = F.broadcast(own) if own.count() <= BROADCAST else own
    again = _doc_windows(texts.join(own, ["_d", "_h"], "left_semi").dropDuplicates(["_d", "_h"]), lengths, raw)
    line = F.col("_at") - F.col("_ip")
    met = materialize(again.join(pairs.join(windows, "_ik"), ["_d", "_h", "_w", "_length"]).withColumn("_line", line), "met")
    # values are read from the documents met, each once; what is sliced is written, so no row carries a whole text
    keys = met.select("_d", "_h").distinct()
    if keys.count() <= BROADCAST:
        keys = F.broadcast(keys)
    read = texts.join(keys, ["_d", "_h"], "left_semi").dropDuplicates(["_d", "_h"]).select("_d", "_h", tokens(F.col("_text")).alias("_t"))
    inside = F.when(F.col("_thin") & (F.col("_line") >= 0), F.slice("_t", F.greatest("_line", F.lit(0)) + 1, F.col("_n")))
    hits = materialize(
        met.join(read, ["_d", "_h"]).select(*met.columns, F.slice("_t", F.col("_at") + 1, F.col("_length")).alias("_v"), inside.alias("_there")), "hits"
    )
    hits = hits.select(
        "_d", "_h", "_ik", "_item", "_key", "_windows", "_thin", "_at", "_n", "_there", "_line",
        F.transform(
            F.filter(F.arrays_zip(F.col("_is").alias("i"), F.col("_v").alias("v")), lambda p: kind(p["i"]) != ""),
            lambda p: F.struct(bare(p["i"]).alias("i"), bare(p["v"]).alias("v")),
        ).alias("_slots"),
    )
    # a window of few words counts by its real values, or where the whole item is there
    hits = hits.withColumn("_counts", ~F.col("_thin") | F.forall("_slots", lambda p: p["i"] == p["v"]))
    hits = hits.withColumn("_there", F.when(~F.col("_counts"), F.col("_there")))
    # the key of other windows meets no item and is spread
    hits = hits.withColumn("_whole_ik", F.when(F.col("_there").isNotNull(), F.col("_ik")).otherwise(F.xxhash64("_d", "_h", "_at"))).join(items, "_whole_ik", "left")
    fits = F.forall(
        F.arrays_zip(F.col("_it").alias("i"), F.col("_there").alias("v")),
        lambda p: (bare(p["i"]) == bare(p["v"])) | ((_slot(p["i"]) != "") & (_slot(p["i"]) == _slot(p["v"]))),
    )
    whole = (F.size("_there") == F.col("_n")) & fits & _one_to_one(_pairs("_it", "_there", True))
    hits = hits.withColumn("_whole", F.when(F.col("_there").isNotNull() & F.col("_it").isNotNull(), F.coalesce(whole, F.lit(False))).otherwise(False))
    hits = hits.where("_counts or _whole")
    lines = hits.groupBy("_d", "_h", "_ik", "_line").agg(
        F.first("_item").alias("_item"),
        F.first("_windows").alias("n_windows"),
        F.collect_set(F.when(F.col("_counts"), F.col("_key"))).alias("_matched"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("_counts"), F.col("_slots"))))).alias("_slots"),
        F.max(F.when(F.col("_whole"), F.size(F.array_distinct(_pairs("_it", "_there", True))))).alias("_whole"),
        F.min("_at").alias("_at"),
    )
    # one item value for one document value and the other way round
    both = F.least(F.size(F.array_distinct("_slots.i")), F.size(F.array_distinct("_slots.v")))
    lines = lines.withColumns({"_pairs": F.size("_slots"), "_keys": both})
    agrees = (F.col("_pairs") == 0) | (F.col("_keys") / F.col("_pairs") >= consistent)

    def together(of: Column) -> Column:
        """The lines for which ``of`` holds, as one."""
        only = lambda c: F.when(of, F.col(c))
        n = F.size(F.array_distinct(F.flatten(F.collect_list(only("_matched")))))
        pairs = F.coalesce(F.sum(only("_pairs")), F.lit(0)).cast("int")
        return F.struct(
            n.alias("n_matched"),
            (n / F.first("n_windows")).alias("coverage"),
            pairs.alias("slots"),
            F.when(pairs == 0, 1.0).otherwise(F.sum(only("_keys")) / pairs).alias("agreement"),
            F.min(only("_at")).alias("first_at"),
        )

    def passes(c: str) -> Column:
        return ((F.col(f"{c}.coverage") >= coverage) | (F.col(f"{c}.n_matched") >= long)) & (F.col(f"{c}.agreement") >= consistent)

    one = F.lit(1.0)
    held = F.struct(
        F.first("n_windows").cast("int").alias("n_matched"), one.alias("coverage"), F.max("_whole").alias("slots"), one.alias("agreement"),
        F.min(F.when(F.col("_whole").isNotNull(), F.col("_line"))).alias("first_at"),
    )
    per = lines.groupBy("_d", "_h", "_ik").agg(
        F.first("_item").alias("_item"),
        F.first("n_windows").alias("n_windows"),
        together(F.lit(True)).alias("_all"),
        together(agrees).alias("_agreeing"),
        held.alias("_held"),
    )
    return (
        per.where(passes("_all") | passes("_agreeing") | F.col("_held.slots").isNotNull())
        .withColumn("_found", F.when(passes("_all"), F.col("_all")).when(passes("_agreeing"), F.col("_agreeing")).otherwise(F.col("_held")))
        .select("_d", "_h", F.col("_item").alias(item), "n_windows", "_found.*")
    )


def drop_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    leaks = find_leaks(docs, bench, id_col, text_col, **params).select("_d", "_h").distinct()
    d, h = row_key(docs, id_col, text_col)
    return docs.join(leaks, (d == leaks["_d"]) & (h == leaks["_h"]), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    # the id of a row whose id is null is reported as the largest long
    return leaks.select(F.col("_d").alias("doc_id"), "item_id", "n_windows", "n_matched", "coverage", "slots", "agreement", "first_at")
