"""Hard negatives against plain loops over all rows."""

import math
import random

import numpy as np
import pytest

from tallyworks.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    own = []
    for u, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [max(-hn.BOUND, min(hn.BOUND, math.floor(256 * x))) for x in v]
        own.append((u, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, q))
    out = []
    for u, i, label, q in own:
        if i is None or i % 100:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j is None, j or 0, w, other) for w, j, other, p in own if w != u and len(p) == len(q))
        name = lambda s: None if s[1] else s[2]
        for p in [s for s in scores if s[4] == label][:5]:
            found = [s for s in scores if s[4] != label and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            out += [(i, name(p), k + 1, name(s), -p[0], -s[0]) for k, s in enumerate(found)]
    return out


def run(spark, tmp_path, rows, extra=()):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in extra:
        df = df.withColumn(c, df["label"])
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    show = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(map(tuple, hn.op12_hard_negatives(spark, str(tmp_path)).collect()), key=show), show


def made(seed, n, dim):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(12)]
    rows = [(i * 4, [round(x + rng.gauss(0, 0.05), 2) for x in rng.choice(base)], rng.choice([1, 1, 1, 2, 3])) for i in range(n)]
    bad = [(100, None, 1), (200, [None] * dim, 1), (300, [math.nan] * dim, 1), (400, [math.inf] * dim, 2), (500, [0.1] * dim, None), (None, [0.4] * dim, 2), (None, [0.4] * dim, 1)]
    return rows + bad + [(800, [0.5, 0.25], 1), (3, [0.5, 0.2], 1), (4, [0.49, 0.2], 2), (900, [], 1), (5, [], 1), (6, [], 2), (700, [0.0] * dim, 0), (1000, [50_000.0] * dim, 4), (11, [1e300] * dim, 4), (12, [40_000.0] * dim, 5)]


@pytest.mark.parametrize(("rows", "anchors"), [(2_048, 128), (16, 4)])
def test_against_loops(spark, tmp_path, monkeypatch, rows, anchors):
    monkeypatch.setattr(hn, "ROWS", rows)
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    monkeypatch.setattr(hn, "DIMS", 3)
    monkeypatch.setattr(hn, "GROUP", 2)
    given = made(rows, 260, 9)
    given += given[:2] + given[25:27]  # repeated rows, an anchor among them
    got, show = run(spark, tmp_path, given, ["u", "id", "dim", "q", "block"])
    assert got == sorted(brute(given), key=show) and len(got) > 50


def test_empty_and_long(spark, tmp_path):
    assert run(spark, tmp_path / "a", [])[0] == []
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (5, 20_000))
    rows = [(k * 100, (x[k % 2] + 0.1 * x[k]).tolist(), k % 2) for k in range(5)]
    got, show = run(spark, tmp_path / "b", rows)
    assert got == sorted(brute(rows), key=show)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for big in (1 << 7, hn.BOUND):
        a, b = (rng.integers(-big, big + 1, (5, 200)).astype(np.int32) for _ in range(2))
        want = [[sum(int(p) * int(q) for p, q in zip(r, s, strict=True)) for s in b] for r in a]
        assert hn.multiply(a, b).tolist() == want
        tile = hn.multiply(a, b)
        assert (hn._wide(hn._narrow(tile), 5, 5) == tile).all()
