"""Near-duplicate documents by one-permutation MinHash, banded buckets and star edges.

1. Documents with equal shingle sets form one class; its representative is the
   smallest (id, text hash), null ids last. One pre-aggregated pass, so a class
   that holds a third of all rows costs no more than any other.
2. Signatures of representatives (see minhash.py) are cut into bands. A bucket's
   members are each tied to its smallest one only: the star keeps candidate
   pairs at (members - 1) per bucket however large it is.
3. Star edges are confirmed on full shingle sets. A centre's members are dealt
   over tasks by a salt; its set travels once per salt and is held while members
   stream past.
4. A star can't see a link between two members that both differ from the centre.
   Families (components of all star edges) that the confirmed links leave in
   more than one piece are therefore compared inside: members are dealt into
   blocks of bounded size, each task holds two blocks, skips pairs already
   joined, passes pairs whose signatures agree far too little (by more than
   ``SIGMAS`` standard deviations below the threshold) and confirms the rest on
   full sets. Only links leave the task, never pairs.
5. Connected components of all links; each document gets the smallest id of its
   component.

The bands miss a pair of exactly the threshold's similarity with a probability
under 1e-5 (``banding``); confirmation is exact but for 64-bit hash collisions.

Edge cases: null, empty and blank texts have an empty set and link with
nothing; a text of fewer words than a shingle is one shingle; rows equal in id
and text are one node; a component without any id has a null component_id;
extra columns are carried by drop_near_duplicates and ignored elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG_MAX, materialize, row_key, table
from .graph import components
from .minhash import Signer, jaccard_at_least, shingles

#: Candidate ids (a long and a hash each) that are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST = 500_000
#: Members of a star per salt; members and shingles of a block.
SALT_ROWS, BLOCK_ROWS, BLOCK_SHINGLES = 2_000, 1_000, 2_000_000
SIGMAS = 5.0
NODE = "struct<d: bigint, h: bigint>"
_NODE = pa.struct([("d", pa.int64()), ("h", pa.int64())])


def banding(hundredths: int) -> tuple[int, int]:
    """(bands, rows): rows so that dissimilar pairs seldom collide, bands so that a pair at the threshold is missed with p < 1e-5."""
    t = hundredths / 100
    rows = max(1, min(8, round(math.log(0.26) / math.log(min(t, 0.999)))))
    return math.ceil(math.log(1e-5) / math.log(1 - t**rows)), rows


_signers: dict[tuple[int, int], Signer] = {}


def signer(bands: int, rows: int) -> Signer:
    if (bands, rows) not in _signers:
        _signers[bands, rows] = Signer(bands, rows)
    return _signers[bands, rows]


def _signatures(docs: DataFrame, k: int, hundredths: int, id_col: str, text_col: str) -> DataFrame:
    """(n node, n_shingles, d1, d2 digest of the set, bands) of every row."""
    bands, rows = banding(hundredths)
    d, h = row_key(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = signer(bands, rows)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sizes, d1, d2, hashes = [], [], [], []
                for x in part.column("_t"):
                    s = shingles(x.as_py(), k)
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    sizes.append(len(s))
                    d1.append(int.from_bytes(digest[:8], "big", signed=True))
                    d2.append(int.from_bytes(digest[8:], "big", signed=True))
                    hashes.append(sign.band_hashes(sign.signature(s)).view(np.int64) if len(s) else np.empty(0, np.int64))
                flat = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, hashes)]), pa.int32()), pa.array(np.concatenate([*hashes, np.empty(0, np.int64)]), pa.int64())
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("n"), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), flat],
                    ["n", "n_shingles", "d1", "d2", "bands"],
                )

    rows_in = docs.select(F.struct(d.alias("d"), h.alias("h")).alias("n"), F.col(text_col).alias("_t"))
    return materialize(rows_in.mapInArrow(run, f"n {NODE}, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>"), "signatures")


def _sets(docs: DataFrame, nodes: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(n, s): the sorted shingle hashes, 8 bytes each, of the nodes' texts."""
    d, h = row_key(docs, id_col, text_col)
    texts = docs.select(F.struct(d.alias("d"), h.alias("h")).alias("n"), F.col(text_col).alias("_t"))
    if nodes.count() <= BROADCAST:
        nodes = F.broadcast(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                yield pa.RecordBatch.from_arrays(
                    [part.column("n"), pa.array([shingles(x.as_py(), k).tobytes() for x in part.column("_t")], pa.binary())], ["n", "s"]
                )

    found = texts.join(nodes, "n", "left_semi").mapInArrow(run, f"n {NODE}, s binary")
    return materialize(found.dropDuplicates(["n"]), "sets")


def _confirm(edges: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """The (c, n) edges whose sets are similar enough."""
    fan = materialize(edges.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts")), "fans")
    members = edges.join(fan, "c").select("c", F.pmod(F.xxhash64("n"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"), "n")
    centres = fan.select("c", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("c").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for c, salt, member, n, s in zip(*(batch.column(x) for x in ("c", "salt", "member", "n", "s")), strict=True):
                own = np.frombuffer(s.as_buffer(), np.uint64)
                key = (c.as_py(), salt.as_py())
                if not member.as_py():
                    at, held = key, own.copy()
                elif at == key and jaccard_at_least(held, own, hundredths):
                    out.append((key[0], n.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], _NODE), pa.array([b for _, b in out], _NODE)], ["c", "n"])

    rows = members.unionByName(centres).join(sets, "n").select("c", "salt", "member", "n", "s")
    dealt = rows.repartition("c", "salt").sortWithinPartitions("c", "salt", "member")
    return materialize(dealt.mapInArrow(run, f"c {NODE}, n {NODE}"), "links")


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def block_links(sets: list[np.ndarray], comps: list, side: list[int], sign: Signer, hundredths: int) -> list[tuple[int, int]]:
    """Links between members not yet in one component; with two sides (0, 1) only between them."""
    n = len(sets)
    sig = np.array([sign.signature(s) for s in sets]).astype(np.uint8)
    size = np.array([len(s) for s in sets])
    t = hundredths / 100
    least = max(0.0, t - SIGMAS * math.sqrt(t * (1 - t) / sign.bins)) * sign.bins
    number = {}
    parent = list(range(n))
    for i, c in enumerate(comps):
        parent[i] = number.setdefault(c, i)
    sides = np.array(side)
    across = len(set(side)) > 1
    out = []
    for i in range(n - 1):
        near = (sig[i + 1 :] == sig[i]).sum(1) >= least
        near &= 100 * np.minimum(size[i + 1 :], size[i]) >= hundredths * np.maximum(size[i + 1 :], size[i])
        if across:
            near &= sides[i + 1 :] != sides[i]
        for j in np.flatnonzero(near) + i + 1:
            a, b = _find(parent, i), _find(parent, int(j))
            if a != b and jaccard_at_least(sets[i], sets[j], hundredths):
                parent[max(a, b)] = min(a, b)
                out.append((i, int(j)))
    return out


def _inside(edges: DataFrame, links: DataFrame, sizes: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """(c, n) links inside families that the confirmed links leave in pieces."""
    bands, rows = banding(hundredths)
    family = components(edges, "c", "n").withColumnRenamed("label", "f")
    piece = components(links, "c", "n").withColumnRenamed("label", "p")
    nodes = family.join(piece, "node", "left").join(sizes, family["node"] == sizes["n"]).select(
        "f", F.col("node").alias("n"), F.coalesce("p", "node").alias("p"), "n_shingles"
    )
    nodes = materialize(nodes, "families")
    open_ = materialize(
        nodes.groupBy("f")
        .agg(F.count(F.lit(1)).alias("m"), F.min("p").alias("p0"), F.max("p").alias("p1"), F.sum("n_shingles").alias("w"))
        .where("m > 2 and p0 <> p1")
        .select("f", F.greatest(F.ceil(F.col("m") / BLOCK_ROWS), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int").alias("nb")),
        "open",
    )
    b = F.pmod(F.xxhash64("n"), F.col("nb")).cast("int")
    dealt = nodes.join(open_, "f").withColumn("b", b).select(
        "f", "n", "p", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")
    ).select("f", "n", "p", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b")

    def run(batch: pa.Table) -> pa.Table:
        node, comp, own, s = (batch.column(x).to_pylist() for x in ("n", "p", "b", "s"))
        order = sorted(range(len(node)), key=lambda k: (node[k]["d"], node[k]["h"]))
        found = block_links(
            [np.frombuffer(s[k], np.uint64) for k in order], [(comp[k]["d"], comp[k]["h"]) for k in order], [own[k] for k in order],
            signer(bands, rows), hundredths,
        )
        return pa.table({"c": pa.array([node[order[a]] for a, _ in found], _NODE), "n": pa.array([node[order[b]] for _, b in found], _NODE)})

    return dealt.join(sets, "n").groupBy("f", "i", "j").applyInArrow(run, f"c {NODE}, n {NODE}")


def near_duplicates(docs: DataFrame, k: int = 5, hundredths: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(n node, n_shingles, c): for every row its node struct<d, h> and the smallest node of its component; c is its own node if it has no links."""
    sigs = _signatures(docs, k, hundredths, id_col, text_col)
    classes = materialize(
        sigs.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("n").alias("n"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")),
        "classes",
    )
    banded = classes.select("n", F.explode("bands").alias("b"))
    # written first: a join with a plain table, not an aggregate, lets a hot bucket be split over tasks
    buckets = materialize(banded.groupBy("b").agg(F.min("n").alias("c"), F.max("n").alias("last")).where("c <> last").select("b", "c"), "buckets")
    edges = materialize(banded.join(buckets, "b").where("n <> c").select("c", "n").distinct(), "stars")
    nodes = edges.select("n").union(edges.select(F.col("c").alias("n"))).distinct()
    sets = _sets(docs, nodes, k, id_col, text_col)
    links = _confirm(edges, sets, hundredths)
    more = _inside(edges, links, classes.select("n", "n_shingles"), sets, hundredths)
    label = components(links.unionByName(more), "c", "n")
    by_class = classes.join(label, classes["n"] == label["node"], "left").select("d1", "d2", F.coalesce("label", "n").alias("c"))
    return sigs.select("n", "n_shingles", "d1", "d2").join(by_class, ["d1", "d2"], "left").select("n", "n_shingles", F.coalesce("c", "n").alias("c"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, hundredths: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component (the smallest node; rows equal in id and text count once)."""
    found = near_duplicates(docs, k, hundredths, id_col, text_col)
    kept = found.where("n = c or n_shingles = 0").select("n", "n_shingles").groupBy("n").agg(F.max("n_shingles").alias("_s"), F.count(F.lit(1)).alias("_rows"))
    d, h = row_key(docs, id_col, text_col)
    # the row's own columns travel in one, so none can be taken for a key
    joined = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), d.alias("_d"), h.alias("_h")).join(
        kept.select(F.col("n.d").alias("_d"), F.col("n.h").alias("_h"), ((F.col("_rows") > 1) & (F.col("_s") > 0)).alias("_again")), ["_d", "_h"]
    )
    once = joined.where("not _again").unionByName(joined.where("_again").dropDuplicates(["_d", "_h"]))
    return once.select("row.*")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, 3, 85)
    real = lambda c: F.when(F.col(c) != LONG_MAX, F.col(c))
    return found.select(
        real("n.d").alias("doc_id"), "n_shingles", real("c.d").alias("component_id"), (F.col("n.d") == F.col("c.d")).alias("kept")
    )
