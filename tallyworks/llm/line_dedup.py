"""Line dedup by pairwise alignment of overlapping documents.

1. A document is its non-blank lines, hashed without blanks at their ends. The
   seeds of a document are its shortest runs of lines of at least ``LEAST``
   characters, one from each line on and one up to each line; a line that long is
   a seed by itself. Two documents share a passage of ``LEAST`` characters just
   when they share a seed, and the seeds they share cover the passage: what
   follows from the first line of a passage lies inside it, and so does what ends
   at any line behind that first seed.
2. The documents that hold a seed are counted in one pre-aggregated pass; its
   holder is the earliest (by id, null last, then text hash). A later document is
   paired with the holders of its seeds, the holders of rare seeds first. A line
   that a third of all documents hold yields one pair for each of them, never
   pairs among them, and only the places of shared seeds travel, so a long holder
   that many documents meet is never copied whole.
3. A pair's shared seeds are aligned by patience diff: seeds that occur once in
   both anchor, the longest rising run of anchors is kept, the gaps are aligned in
   turn. Where a gap has no such seeds, the k-th occurrence in one is held against
   the k-th in the other. What is left over (passages in another order, repeats) is
   aligned again, up to ``ROUNDS`` times; after that, what is left of it is taken
   seed by seed, so nothing depends on that number but the time.
4. The aligned lines are deleted from the later document.

So a later document keeps no passage of ``LEAST`` characters that an earlier one
holds, whoever holds which part of it, and the first holder keeps its lines, its
own repeats included: every passage stays in one document.

Edge cases: rows equal in id and text are one document and lose the same lines;
a null text stays null, an empty one empty; a document whose every line is
deleted stays with an empty text; blank lines neither part nor make a passage and
go where the lines on both sides go; columns named like the results are replaced, others are carried.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, row_key, table

#: Characters that a deleted passage has at least; alignments of one pair before the rest is taken as it stands.
LEAST, ROUNDS = 20, 8
BLOCKS = "array<struct<at: int, lines: int, first_doc: bigint>>"
_SEED = pa.struct([("w", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("blank", pa.int32())])


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (sorted by the first number) that rises in the second."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back[k] = at[p - 1] if p else -1
        if p == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _anchors(a: list[int], b: list[int], i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int]]:
    """Lines that occur once in both gaps, else k-th occurrences; hash 0 is a blank line and never anchors."""
    ca, cb = Counter(a[i0:i1]), Counter(b[j0:j1])
    if any(n == 1 and x and cb.get(x) == 1 for x, n in ca.items()):
        where = {b[j]: j for j in range(j0, j1) if cb[b[j]] == 1}
        return _rising([(i, where[a[i]]) for i in range(i0, i1) if a[i] and ca[a[i]] == 1 and a[i] in where])
    seen: Counter = Counter()
    place = {}
    for j in range(j0, j1):
        if b[j] and b[j] in ca:
            place[b[j], seen[b[j]]] = j
            seen[b[j]] += 1
    seen.clear()
    pairs = []
    for i in range(i0, i1):
        if a[i] and a[i] in cb:
            if (j := place.get((a[i], seen[a[i]]))) is not None:
                pairs.append((i, j))
            seen[a[i]] += 1
    return _rising(pairs)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned (line of a, line of b), rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        anchors = _anchors(a, b, i0, i1, j0, j1)
        if not anchors:
            continue
        out += anchors
        for (p, q), (r, s) in zip([(i0 - 1, j0 - 1), *anchors], [*anchors, (i1, j1)], strict=True):
            if p + 1 < r and q + 1 < s:
                todo.append((p + 1, r, q + 1, s))
    return sorted(out)


def seeds(text: str | None, least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """(hash, first line, lines, blank lines between it and another line) of the shortest runs of ``least`` characters from every line on and up to every line."""
    where, size, hashes = [], [], []
    for i, raw in enumerate((text or "").split("\n")):
        if line := raw.strip():
            where.append(i)
            size.append(len(line))
            hashes.append(xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")))
    own = np.array(hashes, np.uint64)
    spans = set()
    end = total = 0
    for i in range(len(size)):  # from i on
        while end < len(size) and total < least:
            total += size[end]
            end += 1
        if total < least:
            break
        spans.add((i, end))
        total -= size[i]
    start = total = 0
    for j in range(len(size)):  # up to j
        total += size[j]
        while total - size[start] >= least:
            total -= size[start]
            start += 1
        if total >= least:
            spans.add((start, j + 1))
    out = []
    for i, j in sorted(spans):
        w = hashes[i] if j == i + 1 else xxhash.xxh3_64_intdigest(own[i:j].tobytes(), j - i)
        after = where[j] - where[j - 1] - 1 if j < len(where) else 0
        out.append((w - (1 << 64) if w >> 63 else w, where[i], where[j - 1] - where[i] + 1, after))
    return out


def owners(spots: list[tuple], rounds: int = ROUNDS) -> list[tuple[int, int, int | None]]:
    """(first line, lines, holder's id) of the passages of one document, from its shared seeds.

    A spot is (first line, lines, hash, holder, place in the holder, documents that hold it, blank lines after it); a holder is (id, hash).
    """
    by: dict[tuple, list[tuple]] = {}
    for s in sorted(set(spots)):
        by.setdefault(s[3], []).append(s)
    taken: list[tuple | None] = [None] * max((s[0] + s[1] for s in spots), default=0)
    left = lambda group: [s for s in group if None in taken[s[0] : s[0] + s[1]]]
    # the holder of the rarest seed first, then the one that shares most
    for holder in sorted(by, key=lambda h: (min(s[5] for s in by[h]), -len(by[h]), h)):
        rest = left(by[holder])
        theirs = [w for _, _, w in sorted({(s[4], s[1], s[2]) for s in rest})]
        for k in range(rounds + 1):
            if not rest:
                break
            aligned = range(len(rest)) if k == rounds else [j for _, j in patience(theirs, [s[2] for s in rest])]
            for j in aligned:
                at, n = rest[j][:2]
                for i in range(at, at + n):
                    taken[i] = taken[i] or holder
            rest = left(rest)
    for at, n, *_, blank in spots:
        if at + n + blank < len(taken) and taken[at + n + blank]:
            taken[at + n : at + n + blank] = [taken[at + n - 1]] * blank
    out: list[list] = []
    for i, holder in enumerate(taken):
        if holder and out and i and taken[i - 1] == holder:
            out[-1][1] += 1
        elif holder:
            out.append([i, 1, holder[0]])
    return [tuple(x) for x in out]


def _seeds(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(_d, _h, _seeds) of every document, once for rows equal in id and text."""
    d, h = row_key(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found = [seeds(x.as_py(), least) for x in part.column("_t")]
                flat = [s for f in found for s in f]
                parts = [pa.array([s[k] for s in flat], t) for k, t in enumerate(f.type for f in _SEED)]
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                made = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, fields=list(_SEED)))
                yield pa.RecordBatch.from_arrays([part.column("_d"), part.column("_h"), made], ["_d", "_h", "_seeds"])

    rows = docs.select(d.alias("_d"), h.alias("_h"), F.col(text_col).alias("_t")).where(F.col("_t") != "")
    made = rows.mapInArrow(run, "_d bigint, _h bigint, _seeds array<struct<w: bigint, at: int, n: int, blank: int>>")
    return materialize(made.dropDuplicates(["_d", "_h"]), "seeds")


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            found = []
            for spots in part.column("_spots").to_pylist():
                own = owners([(s["at"], s["n"], s["w"], (s["od"], s["oh"]), s["oat"], s["often"], s["blank"]) for s in spots])
                found.append([{"at": at, "lines": n, "first_doc": first} for at, n, first in own])
            kind = pa.list_(pa.struct([("at", pa.int32()), ("lines", pa.int32()), ("first_doc", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("_d"), part.column("_h"), pa.array(found, kind)], ["_d", "_h", "blocks"])


def find_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(_d, _h, blocks): for each later document the lines it shares with earlier ones, in order."""
    held = _seeds(docs, id_col, text_col, least).select("_d", "_h", F.explode("_seeds").alias("_s")).select("_d", "_h", "_s.*")
    # written first: a join with a plain table, not an aggregate, lets a hot seed be split over tasks
    first = materialize(
        held.groupBy("w")
        .agg(F.min(F.struct("_d", "_h", "at")).alias("f"), F.max(F.struct("_d", "_h")).alias("_last"), F.count(F.lit(1)).alias("often"))
        .where((F.col("f._d") != F.col("_last._d")) | (F.col("f._h") != F.col("_last._h")))
        .select("w", F.col("f._d").alias("od"), F.col("f._h").alias("oh"), F.col("f.at").alias("oat"), "often"),
        "holders",
    )
    shared = held.join(first, "w").where("_d <> od or _h <> oh")
    # a group is one document's own seeds
    per = shared.groupBy("_d", "_h").agg(F.collect_list(F.struct("at", "n", "w", "od", "oh", "oat", "often", "blank")).alias("_spots"))
    return per.mapInArrow(_align, f"_d bigint, _h bigint, blocks {BLOCKS}")


def delete_blocks(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with text_col without the lines of its blocks, and n_lines, n_removed, blocks."""
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed", "blocks")]
    d, h = row_key(docs, id_col, text_col)
    # the row's own columns travel in one, so none can be taken for a key
    row = F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row")
    joined = docs.select(row, d.alias("_d"), h.alias("_h")).join(found, ["_d", "_h"], "left").select("row.*", "blocks")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*keep).schema)
    spot = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts, lines, removed = [], [], []
                for text, own in zip(part.column(spot).to_pylist(), part.column(len(keep)).to_pylist(), strict=True):
                    all_lines = [] if text is None else text.split("\n")
                    gone = {i for b in own or () for i in range(b["at"], b["at"] + b["lines"])}
                    texts.append("\n".join(x for i, x in enumerate(all_lines) if i not in gone) if gone else text)
                    lines.append(len(all_lines))
                    removed.append(len(gone))
                columns = [*part.columns]
                columns[spot] = pa.array(texts, columns[spot].type)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(lines, pa.int32()), pa.array(removed, pa.int32())], [*part.schema.names, "n_lines", "n_removed"]
                )

    return joined.mapInArrow(run, f"{schema}, blocks {BLOCKS}, n_lines int, n_removed int")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with the text cleaned, and n_lines, n_removed and blocks array<struct<at, lines, first_doc>>."""
    return delete_blocks(docs, find_blocks(docs, id_col, text_col, least), id_col, text_col)


def op8_line_dedup(spark: SparkSession, sf_dir: str, least: int = LEAST) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, least=least).select("doc_id", "n_lines", "n_removed", "blocks", "text")
