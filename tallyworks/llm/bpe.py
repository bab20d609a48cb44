"""Byte-level BPE encoding and decoding over public rank files.

A pre-token's bytes are the leaves of a segment tree; leaf i holds the rank of
the pair that starts at i (infinity: none) and every inner node the minimum
below it. The root descends to the leftmost minimum; a merge then changes three
leaves (the merged pair, its dead right half, the live neighbour to the left),
each a walk of log n nodes. Distinct pre-tokens are encoded once per worker and
remembered in a table of bounded size.

Edge cases: null and empty texts give no ids; a pre-token without any known
pair stays single bytes; texts of any length are encoded whole; repeated rows
each give a row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table, worker_cache

#: Pre-tokens in each of the two tables that a worker remembers: when the newer one is full it becomes
#: the older one, and the words that come again move on to the next (ids don't change).
REMEMBERED = 300_000
NONE = 1 << 60


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """token bytes -> rank, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the leftmost pair of lowest rank is merged until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    size = 1
    while size < n:
        size *= 2
    get = ranks.get
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], NONE)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    end = list(range(1, n + 1))  # where the part that starts at i ends: the start of the next part
    before = list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        i += size
        if tree[i] == rank:
            return
        tree[i] = rank
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a <= b else b
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1

    while tree[1] != NONE:
        i = 1
        while i < size:
            i *= 2
            if tree[i] > tree[i + 1]:
                i += 1
        i -= size
        j = end[i]  # the right half, which dies
        end[i] = e = end[j]
        if e < n:
            before[e] = i
        put(j, NONE)
        put(i, get(piece[i : end[e]], NONE) if e < n else NONE)
        if (p := before[i]) >= 0:
            put(p, get(piece[p:e], NONE))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class ByteBPE:
    """Encoder and decoder; ``raw`` is a rank file's content, ``pattern`` splits texts before merges."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = read_ranks(raw)
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def ids_of(self, word: str) -> tuple[int, ...]:
        """Ids of a word that isn't in the newer table."""
        ids = self.older.get(word)
        if ids is None:
            ids = tuple(merge(word.encode("utf-8", "replace"), self.ranks))
        if len(word) <= 64:
            if len(self.known) >= REMEMBERED:
                self.older = self.known.copy()
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known, add = self.known, out.extend
        for word in self.split(text or ""):
            ids = known.get(word)
            add(self.ids_of(word) if ids is None else ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def coder(raw: bytes, pattern: str) -> ByteBPE:
    """One coder per worker process and vocabulary."""
    made = worker_cache("bpe")
    key = (hashlib.sha256(raw).hexdigest(), pattern)
    if key not in made:
        made[key] = ByteBPE(raw, pattern)
    return made[key]


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """(content of a public rank file, its split pattern), read on the driver and sent to the tasks (under 1 MB)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, vocabulary: tuple[bytes, str], text: str = "text", check: bool = False) -> DataFrame:
    """``docs`` with ids array<int> and n_tokens long; other columns stay, but for any with these names.

    check: also round_trip boolean, whether the ids decode to the text's bytes, in the same pass.
    """
    made = ["ids", "n_tokens", *["round_trip"] * check]
    keep = [c for c in docs.columns if c not in made]
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(text).to_pylist()
                ids = [bpe.encode(x) for x in texts]
                new = [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())]
                if check:
                    new.append(pa.array([bpe.decode(i) == (x or "").encode() for i, x in zip(ids, texts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *made])

    return docs.select(*keep).mapInArrow(run, f"{schema}, ids array<int>, n_tokens long" + ", round_trip boolean" * check)


def decode_ids(df: DataFrame, vocabulary: tuple[bytes, str], ids: str = "ids") -> DataFrame:
    """``df`` with decoded binary; an unknown id fails, null ids give null."""
    keep = [c for c in df.columns if c != "decoded"]
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = [None if x is None else bpe.decode(x) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return df.select(*keep).mapInArrow(run, f"{schema}, decoded binary")


def digests(docs: DataFrame, vocabulary: tuple[bytes, str]) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes, without sending the ids themselves on."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(*sent.value)
        for batch in batches:
            n, a, b = [], [], []
            for x in batch.column("text"):
                ids = bpe.encode(x.as_py())
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_vocabulary())
