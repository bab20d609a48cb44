"""Near-duplicate embeddings by product quantisation: inverted lists, table-lookup distances, exact rerank.

1. Vectors are scaled to length 1 in double precision; equal vectors of a label
   form one class with a count, found in one pre-aggregated pass.
2. Coarse centroids and residual codebooks are fitted by k-means on a bounded
   sample (``SAMPLE``); every class is indexed: its list, its codes and the
   distance between it and what the codes stand for.
3. A vector probes the lists that a link partner can lie in. A partner within
   distance r of q has another nearest centroid c only if q is within r of the
   plane between c and its own centroid. A partner's offset along one direction
   has a standard deviation of r / sqrt(dimension), so ``SIGMAS`` of those stand
   in for r where that is less. Up to 16 dimensions, or with slack=1, nothing can
   be missed; at 64 a link at the threshold is found with a measured 0.999.
4. Within a list, asymmetric distances come from one table per query and
   subspace; a pair is dropped if that distance less the stored code error is
   above r (never a true link). The rest is reranked by exact cosine.
5. Lists are compared in blocks of bounded size, so a hot list or label is dealt
   over many tasks; a task returns a count and one link per member, not pairs.

Edge cases: rows with a null label, a null, empty or zero vector or a null or
non-finite component link with nothing; vectors of other lengths are another
label; a null vec_id has component_id of the smallest id in reach, null if none;
rows equal in id and vector are counted as rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LONG_MAX, materialize, table
from .graph import components

THRESHOLD, SIGMAS = 0.93, 4.0
#: Vectors that the index is fitted on, coarse lists, codes per subspace, subspaces, k-means rounds.
SAMPLE, LISTS, CODES, PARTS, ROUNDS = 6_000, 64, 32, 8, 6
#: Vectors of a block on either side.
BLOCK = 2_000
NODE = "struct<d: bigint, h: bigint>"
_NODE = pa.struct([("d", pa.int64()), ("h", pa.int64())])


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    rng = np.random.default_rng(3)
    c = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(rounds):
        near = (-2 * x @ c.T + (c**2).sum(1)).argmin(1)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    """Coarse centroids and residual codebooks for vectors of one length."""

    def __init__(self, x: np.ndarray, lists: int = LISTS, codes: int = CODES, parts: int = PARTS):
        self.dim = x.shape[1]
        self.coarse = kmeans(x, min(lists, max(1, len(x) // 8)))
        self.cuts = np.linspace(0, self.dim, min(parts, self.dim) + 1).astype(int)
        residual = x - self.coarse[self.nearest(x)]
        self.books = [kmeans(residual[:, a:b], codes) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        gaps = np.sqrt(np.maximum(0, ((self.coarse[:, None] - self.coarse[None]) ** 2).sum(2)))
        self.gaps = gaps

    def distances(self, x: np.ndarray) -> np.ndarray:
        return (x**2).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse**2).sum(1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x).argmin(1)

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error): the nearest code of each subspace of the residual, and how far off they are together."""
        residual = x - self.coarse[own]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        rest = np.zeros(len(x))
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            d = ((residual[:, None, a:b] - book[None]) ** 2).sum(2)
            codes[:, m] = d.argmin(1)
            rest += d.min(1)
        return codes, np.sqrt(rest)

    def probes(self, x: np.ndarray, own: np.ndarray, reach: float) -> np.ndarray:
        """Which lists each vector probes: boolean (vectors, lists)."""
        d = self.distances(x)
        return d - d[np.arange(len(x)), own][:, None] <= 2 * reach * self.gaps[own] + 1e-9

    def adc(self, q: np.ndarray, of: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the codes of one list, from one table per subspace."""
        r = q - self.coarse[of]
        out = np.zeros((len(q), len(codes)))
        for m, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:], strict=False)):
            lookup = ((r[:, None, a:b] - book[None]) ** 2).sum(2)
            out += lookup[:, codes[:, m]]
        return out


def radius(threshold: float) -> float:
    """Largest distance between unit vectors of at least that cosine, with room for rounding."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6


def reach_share(dim: int) -> float:
    """The part of the radius that probes allow for."""
    return min(1.0, SIGMAS / math.sqrt(dim))


def _unit(raw: pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(v.as_py() for v in raw), np.float64).reshape(-1, dim)
    return x / np.sqrt((x**2).sum(1))[:, None]


def classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(n node, label, dim, v doubles as binary or null): v is null for rows that can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, dims = [], []
            for label, v in zip(batch.column("label"), batch.column("vec"), strict=True):
                value = None
                if label.is_valid and v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy().astype(np.float64) + 0.0
                    if np.isfinite(x).all() and x.any():
                        if not 1e-200 < np.abs(x).max() < 1e150:  # squares would leave the range of doubles; powers of two keep every digit
                            x = np.ldexp(x, -np.frexp(np.abs(x).max())[1])
                        value = x.tobytes()
                out.append(value)
                dims.append(0 if value is None else len(value) // 8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["d", "label", "dim", "v"]
            )

    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LONG_MAX)).alias("d"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"))
    made = rows.mapInArrow(run, "d bigint, label string, dim int, v binary")
    return made.select(F.struct("d", F.coalesce(F.xxhash64("v"), F.lit(0)).alias("h")).alias("n"), "label", "dim", "v")


def compare(base: list, queries: list, quant: Quantiser, of: int, same: bool, threshold: float) -> tuple[list[int], list[int]]:
    """Links between unit vectors of two blocks: (links of each member, weighted by the others' counts; position of a joined member).

    base and queries: (unit vectors, codes, errors, counts). Members are numbered base first; same: queries are the base.
    """
    (bx, codes, err, bn), (qx, _, _, qn) = base, queries
    nb = len(bx)
    links = np.zeros(nb + (0 if same else len(qx)), np.int64)
    to = list(range(len(links)))

    def find(x: int) -> int:
        while to[x] != x:
            to[x] = to[to[x]]
            x = to[x]
        return x

    r = radius(threshold)
    for start in range(0, len(qx), 256):
        q = qx[start : start + 256]
        near = quant.adc(q, of, codes) <= (r + err) ** 2
        for k, row in enumerate(near):
            i = start + k
            hits = np.flatnonzero(row)
            if same:
                hits = hits[hits > i]
            if len(hits):
                hits = hits[np.einsum("ij,j->i", bx[hits], q[k]) >= threshold]
            if len(hits):
                me = i if same else nb + i
                links[me] += bn[hits].sum()
                links[hits] += qn[i]
                root = find(me)
                for j in hits.tolist():
                    other = find(j)
                    if other != root:
                        low, high = min(root, other), max(root, other)
                        to[high] = low
                        root = low
    return links.tolist(), [find(x) for x in range(len(links))]


def link_embeddings(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", slack: float | None = None
) -> DataFrame:
    """(n node struct<id, hash>, n_links, c node): every row's direct links and the smallest node it reaches."""
    rows = materialize(classes(vectors, id_col, vec_col, label_col), "vectors")
    same = materialize(
        rows.where("v is not null").groupBy("label", "dim", "v").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    per_dim = {r["dim"]: r["n"] for r in same.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    reach = lambda dim: (reach_share(dim) if slack is None else slack) * radius(threshold)
    quants: dict[int, Quantiser] = {}
    for dim, n in per_dim.items():
        sample = same.where(F.col("dim") == dim).where(F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1_000_000)) < F.lit(math.ceil(1_000_000 * min(1.0, SAMPLE / n))))
        table_ = sample.select("v").toArrow()
        if not table_.num_rows:  # the hash may pick none
            table_ = same.where(F.col("dim") == dim).select("v").limit(SAMPLE).toArrow()
        # in the order of their bytes, so that every run fits the same index
        quants[dim] = Quantiser(_unit(table_.sort_by("v").column("v").combine_chunks(), dim))
    sent = vectors.sparkSession.sparkContext.broadcast(quants)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in sorted(set(batch.column("dim").to_pylist())):
                part = batch.filter(pa.compute.equal(batch.column("dim"), dim))
                x, quant = _unit(part.column("v"), dim), sent.value[dim]
                own = quant.nearest(x)
                codes, err = quant.encode(x, own)
                # a pair is compared in the higher of its two lists
                lists = [[int(c) for c in np.flatnonzero(p) if c >= o] for p, o in zip(quant.probes(x, own, reach(dim)), own, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("dim"), part.column("n"), part.column("copies"), pa.array([v.tobytes() for v in x], pa.binary()),
                     pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err, pa.float64()), pa.array(lists, pa.list_(pa.int32()))],
                    ["label", "dim", "n", "copies", "v", "own", "codes", "err", "probes"],
                )

    indexed = materialize(
        same.select("label", "dim", "v", "n", "copies").mapInArrow(
            index, f"label string, dim int, n {NODE}, copies bigint, v binary, own int, codes binary, err double, probes array<int>"
        ),
        "index",
    )
    # base rows of a list in blocks; queries from other lists (and the list itself, block against block)
    size = indexed.groupBy("label", "dim", "own").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))
    block = F.pmod(F.xxhash64("n"), F.col("nb")).cast("int")
    asked = materialize(
        indexed.select("label", "dim", "n", F.explode("probes").alias("own"))
        .groupBy("label", "dim", "own")
        .agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nq"))
        .join(size, ["label", "dim", "own"]),
        "asked",
    )
    key = ["label", "dim", "list", "i", "j"]
    payload = ["n", "copies", "v", "codes", "err", "own"]
    queries = (
        indexed.withColumn("list", F.explode("probes"))
        .join(asked.withColumnRenamed("own", "list"), ["label", "dim", "list"])
        .select("label", "dim", "list", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), F.pmod(F.xxhash64("n"), F.col("nq")).cast("int").alias("j"), F.lit(1).alias("asks"), *payload)
    )
    base = (
        indexed.join(asked, ["label", "dim", "own"])
        .withColumn("i", block)
        .select("label", "dim", F.col("own").alias("list"), "i", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("j"), F.lit(0).alias("asks"), *payload)
    )

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        dim, of = group.column("dim")[0].as_py(), group.column("list")[0].as_py()
        quant = sent.value[dim]
        asks = group.column("asks").to_numpy()
        nodes = group.column("n").to_pylist()
        x = np.frombuffer(b"".join(group.column("v").to_pylist()), np.float64).reshape(-1, dim)
        codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
        err, copies, own = group.column("err").to_numpy(), group.column("copies").to_numpy(), group.column("own").to_numpy()
        b, q = np.flatnonzero(asks == 0), np.flatnonzero(asks == 1)
        ids: list[dict] = []
        links: list[int] = []
        to: list[dict] = []
        # within the list each pair is met twice (either end asks), between lists once
        inner, outer = q[own[q] == of], q[own[q] != of]
        for asking, within in ((outer, False), (inner, True)):
            if not len(asking) or not len(b):
                continue
            take = lambda k: (x[k], codes[k], err[k], copies[k])
            if within:
                n, root, who = within_list(take(b), take(asking), quant, of, [nodes[k] for k in b], [nodes[k] for k in asking], threshold)
            else:
                n, root = compare(take(b), take(asking), quant, of, False, threshold)
                who = [nodes[k] for k in (*b, *asking)]
            for k, (count, r) in enumerate(zip(n, root, strict=True)):
                if count:
                    ids.append(who[k])
                    links.append(count)
                    to.append(who[r])
        return pa.table({"n": pa.array(ids, _NODE), "links": pa.array(links, pa.int64()), "to": pa.array(to, _NODE)})

    found = materialize(base.unionByName(queries).groupBy(*key).applyInArrow(run, f"n {NODE}, links bigint, to {NODE}"), "links")
    counts = found.groupBy("n").agg(F.sum("links").alias("links"))
    reached = components(found, "n", "to").select("node", F.col("label").alias("reached"))
    per_class = (
        same.select("label", "dim", "v", F.col("n").alias("r"), "copies")
        .join(counts.withColumnRenamed("n", "r"), "r", "left")
        .join(reached, F.col("r") == F.col("node"), "left")
        .select("label", "dim", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("reached", "r").alias("c"))
    )
    out = rows.join(per_class, ["label", "dim", "v"], "left")
    return out.select("n", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "n").alias("c"))


def within_list(base, asking, quant: Quantiser, of: int, base_nodes: list[dict], ask_nodes: list[dict], threshold: float):
    """Links inside one list: a pair counts where the larger node asks, so it counts once over all blocks."""
    rank = lambda n: (n["d"], n["h"])
    nb = len(base_nodes)
    bx, codes, err, bn = base
    qx, _, _, qn = asking
    order = {k: i for i, k in enumerate(sorted({rank(n) for n in (*base_nodes, *ask_nodes)}))}
    bo, qo = np.array([order[rank(n)] for n in base_nodes]), np.array([order[rank(n)] for n in ask_nodes])
    first: dict[tuple, int] = {}
    who = [*base_nodes, *ask_nodes]
    to = [first.setdefault(rank(n), k) for k, n in enumerate(who)]
    links = np.zeros(len(who), np.int64)

    def find(k: int) -> int:
        while to[k] != k:
            to[k] = to[to[k]]
            k = to[k]
        return k

    r = radius(threshold)
    for start in range(0, len(qx), 256):
        q = qx[start : start + 256]
        near = (quant.adc(q, of, codes) <= (r + err) ** 2) & (bo[None, :] < qo[start : start + 256, None])
        for k, row in enumerate(near):
            hits = np.flatnonzero(row)
            if len(hits):
                hits = hits[np.einsum("ij,j->i", bx[hits], q[k]) >= threshold]
            if len(hits):
                me = nb + start + k
                links[me] += bn[hits].sum()
                links[hits] += qn[start + k]
                root = find(me)
                for j in hits.tolist():
                    other = find(j)
                    if other != root:
                        low, high = min(root, other), max(root, other)
                        to[high] = low
                        root = low
    return links.tolist(), [find(k) for k in range(len(who))], who


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = link_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    real = lambda c: F.when(F.col(c) != LONG_MAX, F.col(c))
    return found.select(real("n.d").alias("vec_id"), "n_links", real("c.d").alias("component_id"), (F.col("n.d") == F.col("c.d")).alias("kept"))
