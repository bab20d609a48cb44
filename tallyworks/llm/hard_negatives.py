"""Hard-negative mining by a two-dimensional block matrix multiply (in the manner of SUMMA).

Scores are integer inner products of quantised vectors, so partial sums add up exactly in any order.

1. Rows are dealt to blocks of about ``ROWS`` and anchors to blocks of about ``ANCHORS``; each block is cut into
   chunks of dimensions (two at least, ``DIMS`` at most) and packed as a matrix per (block, chunk).
2. Anchor chunks meet row chunks of the same dimensions; a task multiplies them to tiles of partial int64
   scores (``GROUP`` anchor blocks at a time). The tiles of a block pair are shuffled together and added.
3. The summed tile gives each anchor's best rows of its own label. Rows of other labels stay in the running
   only if the tile's own positives don't rule them out: the window of a worse positive begins lower, so
   what lies below the window of the tile's last positive (0 at least) can never be an answer. That is exact.
4. The best positives over all tiles set the windows; each tile gives its best rows per window, and those of
   all tiles are ranked. Only short lists leave a tile.

Every anchor is compared with every row, in blocks: a stated query set against all rows. A label that a third
of the rows share changes nothing, since blocks are dealt by rows.

Edge cases: rows with a null label, a null vector or any null or non-finite component take no part; vectors are
compared with those of their own length (an empty one scores 0); repeated rows are rows of their own; a
null vec_id comes after all others in ties and is never an anchor; quantised components beyond +-2**23
(values beyond +-32,768) count as that bound, so that every score fits a long up to 65,536 dimensions; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LONG_MAX, materialize, table

#: Rows and anchors of a block, most dimensions of a chunk, anchor blocks that meet a row block in one task.
ROWS, ANCHORS, DIMS, GROUP = 2_048, 128, 512, 8
#: Vector lengths up to which their counts are broadcast.
LENGTHS = 1_000
SCALE, BOUND = 256, 1 << 23
POSITIVES, NEGATIVES = 5, 5
#: The window of negatives, in hundredths of the positive's score.
LOW, HIGH = 80, 100


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(u row number, id, label, dim, q int32 components as binary) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("v"):
                x = None
                if not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    with np.errstate(over="ignore"):
                        x = np.clip(np.floor(SCALE * x), -BOUND, BOUND).astype(np.int32).tobytes() if np.isfinite(x).all() else None
                out.append(x)
            dims = pa.array([None if x is None else len(x) // 4 for x in out], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("id"), batch.column("label"), dims, pa.array(out, pa.binary())], ["u", "id", "label", "dim", "q"])

    rows = vectors.where(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("u"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v")
    )
    return rows.mapInArrow(run, "u bigint, id bigint, label bigint, dim int, q binary").where("q IS NOT NULL")


def block_counts(rows: DataFrame, size: int) -> DataFrame:
    """(dim, blocks): how many blocks of about ``size`` rows each vector length has."""
    return materialize(rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks")), "counts")


def _with(df: DataFrame, counts: DataFrame) -> DataFrame:
    """A row per vector length is small enough to send to every task, if the lengths are few."""
    return df.join(F.broadcast(counts) if counts.count() <= LENGTHS else counts, "dim")


def _packed(rows: DataFrame, size: int, label: str) -> DataFrame:
    """(dim, block, d chunk, n, m int32 matrix; chunk 0 also us, ids, labels) of blocks of about ``size`` rows."""
    dealt = _with(rows, block_counts(rows, size)).withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks")))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("u")
        dim, n = group.column("dim")[0].as_py(), group.num_rows
        m = np.frombuffer(b"".join(group.column("q").to_pylist()), np.int32).reshape(n, dim)
        width = min(DIMS, max(1, -(-dim // 2)))
        cuts = list(range(0, dim, width)) or [0]
        whole = lambda c: [group.column(c).to_pylist()] + [None] * (len(cuts) - 1)
        long_ = pa.list_(pa.int64())
        return pa.table({
            "dim": pa.array([dim] * len(cuts), pa.int32()), "block": pa.array([group.column("block")[0].as_py()] * len(cuts), pa.int64()), "d": pa.array(range(len(cuts)), pa.int32()),
            "n": pa.array([n] * len(cuts), pa.int32()), "m": pa.array([np.ascontiguousarray(m[:, c : c + width]).tobytes() for c in cuts], pa.binary()),
            "us": pa.array(whole("u"), long_), "ids": pa.array(whole("id"), long_), "labels": pa.array(whole("label"), long_),
        })

    schema = "dim int, block bigint, d int, n int, m binary, us array<bigint>, ids array<bigint>, labels array<bigint>"
    return materialize(dealt.select("dim", "block", "u", "id", "label", "q").groupBy("dim", "block").applyInArrow(run, schema), label)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of int32 matrices as int64: through doubles where no sum can leave their exact range."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a.astype(np.int64)).max(initial=0)) * int(np.abs(b.astype(np.int64)).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _narrow(tile: np.ndarray) -> bytes:
    """int32 where all of it fits; the reader tells by the length."""
    small = tile.size == 0 or (tile.min() >= -(1 << 31) and tile.max() < 1 << 31)
    return tile.astype(np.int32 if small else np.int64).tobytes()


def _wide(raw: bytes, rows: int, columns: int) -> np.ndarray:
    kind = np.int64 if rows * columns * 8 == len(raw) else np.int32
    return np.frombuffer(raw, kind).reshape(rows, columns).astype(np.int64)


def score_tiles(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """(dim, a, b, d, na, nb, tile): partial scores of each anchor block against each row block, per chunk of dimensions."""
    blocks, groups = (df.groupBy("dim").agg((F.max("block") + 1).alias("blocks")) for df in (rows, anchors))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    shift = GROUP.bit_length() - 1
    left = _with(anchors, materialize(blocks, "counts")).select("dim", "d", F.col("block").alias("a"), F.shiftright("block", shift).alias("g"), "n", "m", every(F.col("blocks")).alias("b"))
    right = _with(rows, materialize(groups, "counts")).select("dim", "d", F.col("block").alias("b"), "n", "m", every(F.ceil(F.col("blocks") / GROUP)).alias("g"))

    def run(own: pa.Table, other: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("dim", "a", "b", "d", "na", "nb", "tile")}
        if own.num_rows and other.num_rows:
            r = other.slice(0, 1).to_pylist()[0]
            y = np.frombuffer(r["m"], np.int32).reshape(r["n"], -1)
            for row in own.to_pylist():
                x = np.frombuffer(row["m"], np.int32).reshape(row["n"], -1)
                for c, v in zip(out, (row["dim"], row["a"], r["b"], row["d"], row["n"], r["n"], _narrow(multiply(x, y))), strict=True):
                    out[c].append(v)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})

    key = ["dim", "b", "d", "g"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "dim int, a bigint, b bigint, d int, na int, nb int, tile binary")


def _first(scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, us: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best by score, then id (null last), then row number."""
    if len(scores) > most:  # what lies below the last place's score can't be among them
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
        return at[np.lexsort((us[at], ids[at], missing[at], -scores[at]))][:most]
    return np.lexsort((us, ids, missing, -scores))[:most]


class _Block:
    """Row numbers, ids and labels of a block."""

    def __init__(self, us, ids, labels):
        self.us, self.labels = np.array(us, np.int64), np.array(labels, np.int64)
        self.missing = np.array([x is None for x in ids], bool)
        self.ids = np.array([LONG_MAX if x is None else x for x in ids], np.int64)

    def name(self, k: int) -> int | None:
        return None if self.missing[k] else int(self.ids[k])


def tops(tiles: DataFrame, anchors: DataFrame, rows: DataFrame, positives: int, low: int) -> DataFrame:
    """(dim, a, b, au, aid, pos places of own label, rest places of others, with scores): what each summed tile keeps per anchor."""
    info = lambda df, block, p: df.where("d = 0").select("dim", F.col("block").alias(block), *[F.col(c).alias(f"{p}_{c}") for c in ("us", "ids", "labels")])
    # labels and ids ride along as one more row of the group, so that no tile is copied by a join
    pairs = tiles.select("dim", "a", "b").distinct()
    sides = pairs.join(info(anchors, "a", "x"), ["dim", "a"]).join(info(rows, "b", "y"), ["dim", "b"])
    group = tiles.unionByName(sides, allowMissingColumns=True)
    candidate = "array<struct<score: bigint, id: bigint, u: bigint>>"

    def run(group: pa.Table) -> pa.Table:
        total, side = None, None
        for row in group.to_batches():
            for r in row.to_pylist():
                if r["tile"] is None:
                    side = r
                else:
                    part = _wide(r["tile"], r["na"], r["nb"])
                    total = part if total is None else total + part
        x, y = _Block(side["x_us"], side["x_ids"], side["x_labels"]), _Block(side["y_us"], side["y_ids"], side["y_labels"])
        pos, rest = [], []
        for k, scores in enumerate(total):
            same = np.flatnonzero((y.labels == x.labels[k]) & (y.us != x.us[k]))
            best = same[_first(scores[same], y.ids[same], y.missing[same], y.us[same], positives)]
            pos.append([{"score": int(scores[j]), "id": y.name(j), "u": int(y.us[j])} for j in best])
            least = max(0, low * int(scores[best[-1]])) if len(best) == positives else 0
            other = np.flatnonzero((y.labels != x.labels[k]) & (scores >= -(-least // 100)))
            rest.append(np.concatenate([scores[other], other]).astype(np.int64).tobytes())
        n = len(total)
        kind = pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64()), ("u", pa.int64())]))
        return pa.table({
            "dim": pa.array([side["dim"]] * n, pa.int32()), "b": pa.array([side["b"]] * n, pa.int64()), "au": pa.array(x.us, pa.int64()),
            "aid": pa.array([x.name(k) for k in range(n)], pa.int64()), "pos": pa.array(pos, kind), "rest": pa.array(rest, pa.binary()),
        })

    return group.groupBy("dim", "a", "b").applyInArrow(run, f"dim int, b bigint, au bigint, aid bigint, pos {candidate}, rest binary")


def hard_negatives(
    rows: DataFrame, anchor: str, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """(anchor_id, anchor_row, positive_id, place, rank, negative_id, positive_score, negative_score) of quantised rows; ``anchor``: which of them ask."""
    rows = materialize(rows, "quantised")
    left, right = _packed(rows.where(anchor), ANCHORS, "anchors"), _packed(rows, ROWS, "blocks")
    kept = materialize(tops(score_tiles(left, right), left, right, positives, low), "tops")

    by_rank = lambda *key: Window.partitionBy(*key).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "u")
    first = kept.select("au", "aid", F.explode("pos").alias("p")).select("au", "aid", "p.*").withColumn("place", F.row_number().over(by_rank("au"))).where(F.col("place") <= positives)
    windows = materialize(first.groupBy("au").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("windows")), "windows")
    # a handful of places and ids; the block's ids come once more for the rows that are left
    ids = right.where("d = 0").select("dim", F.col("block").alias("b"), "us", "ids")
    asked = kept.select("dim", "b", "au", "aid", "rest").where(F.octet_length("rest") > 0).join(windows, "au")

    def run(own: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and block.num_rows:
            b = block.slice(0, 1).to_pylist()[0]
            y = _Block(b["us"], b["ids"], b["us"])
            for batch in own.to_batches(max_chunksize=256):
                for r in batch.to_pylist():
                    both = np.frombuffer(r["rest"], np.int64)
                    scores, at = both[: len(both) // 2], both[len(both) // 2 :]
                    for w in r["windows"]:
                        hit = np.flatnonzero((scores >= -(-low * w["score"] // 100)) & (scores <= high * w["score"] // 100))
                        k = at[hit]
                        for j in _first(scores[hit], y.ids[k], y.missing[k], y.us[k], negatives):
                            out.append((r["au"], r["aid"], w["place"], w["id"], w["score"], int(scores[hit[j]]), y.name(k[j]), int(y.us[k[j]])))
        columns = list(zip(*out, strict=True)) or [()] * 8
        return pa.table({c: pa.array(v, pa.int32() if c == "place" else pa.int64()) for c, v in zip(("au", "aid", "place", "pid", "ps", "score", "id", "u"), columns, strict=True)})

    # anchors of a row block are dealt over tasks, each with the block's ids
    share = F.pmod(F.xxhash64("au"), F.col("shares"))
    shares = kept.groupBy("dim", "b").agg(F.ceil(F.count(F.lit(1)) / (GROUP * ANCHORS)).alias("shares"))
    asked = asked.join(shares, ["dim", "b"]).withColumn("s", share).drop("shares")
    ids = ids.join(shares, ["dim", "b"]).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    schema = "au bigint, aid bigint, place int, pid bigint, ps bigint, score bigint, id bigint, u bigint"
    found = asked.groupBy("dim", "b", "s").cogroup(ids.groupBy("dim", "b", "s")).applyInArrow(run, schema)
    ranked = found.withColumn("rank", F.row_number().over(by_rank("au", "place"))).where(F.col("rank") <= negatives)
    return ranked.select(
        F.col("aid").alias("anchor_id"), F.col("au").alias("anchor_row"), F.col("pid").alias("positive_id"), "place", "rank", F.col("id").alias("negative_id"),
        F.col("ps").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label")))
    found = hard_negatives(rows, "id % 100 = 0")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
