import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.llm import embedding_dedup as E, graph, line_dedup as L, minhash as M, near_dedup as N


def unions(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = unions({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- MinHash -----------------------------------------------------------------------------------------


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < k else frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_components(texts, k, hundredths):
    sets = {n: shingle_set(t, k) for n, t in texts.items()}
    links = []
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= hundredths * (len(sets[a]) + len(sets[b]) - c):
                    links.append((a, b))
    return unions(sets, links), sets


def near_copies(rng, n=160):
    """Families of near copies around the threshold, so stars leave open links; plus short and blank texts."""
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(6):
        base = list(rng.choice(vocabulary, 90))
        for _ in range(n // 8):
            words = list(base)
            for _ in range(rng.integers(0, 7)):
                words[rng.integers(len(words))] = str(rng.choice(vocabulary))
            texts.append(" ".join(words))
    texts += ["", None, " \t\n", "one", "ONE", "one two", "a b c", "A  b\tc", "a b c d e f g h", "a b c d e f g h i", texts[0], texts[0].upper(), "é b c", "É b c"]
    return texts


@pytest.mark.parametrize(("k", "hundredths"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(docs, k, hundredths):
    texts = dict(enumerate(near_copies(np.random.default_rng(k))))
    want, sets = brute_components(texts, k, hundredths)
    found = N.near_duplicates(docs(*texts.items()), k, hundredths).collect()
    assert {r["n"]["d"]: r["c"]["d"] for r in found} == want and {r["n"]["d"]: r["n_shingles"] for r in found} == {n: len(s) for n, s in sets.items()}


def test_blocks_are_split_and_still_whole(docs, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 5)
    monkeypatch.setattr(N, "SALT_ROWS", 3)
    monkeypatch.setattr(N, "BROADCAST", 0)
    texts = dict(enumerate(near_copies(np.random.default_rng(9), 80)))
    want, _ = brute_components(texts, 3, 85)
    assert {r["n"]["d"]: r["c"]["d"] for r in N.near_duplicates(docs(*texts.items()), 3, 85).collect()} == want


def test_dropping_keeps_one_of_each_group(docs):
    a = " ".join(f"x{k}" for k in range(40))
    df = docs((3, a), (1, a), (1, a), (None, a + " y"), (7, None), (8, ""), (None, "lone words here now ok"), (None, "lone words here now ok"), (9, "other text that stands alone here"))
    kept = [(r["doc_id"], r["text"]) for r in N.drop_near_duplicates(df).collect()]
    assert Counter(kept) == Counter([(1, a), (7, None), (8, ""), (None, "lone words here now ok"), (9, "other text that stands alone here")])
    clash = N.drop_near_duplicates(df.withColumnRenamed("lang", "bands").withColumnRenamed("source", "n"))
    assert clash.columns == ["doc_id", "text", "bands", "n", "n_chars"] and clash.count() == 5
    assert N.drop_near_duplicates(df.limit(0)).count() == 0


def test_signatures():
    sign = N.signer(37, 8)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)
    a, b = np.unique(base[:380]), np.unique(base[20:])
    agree = np.mean(sign.signature(a) == sign.signature(b))
    assert abs(agree - 360 / 400) < 0.08
    tiny = np.unique(base[:7]), np.unique(base[:8])  # mostly borrowed bins
    assert abs(np.mean(sign.signature(tiny[0]) == sign.signature(tiny[1])) - 7 / 8) < 0.09
    assert sign.signature(np.unique(base[:1])).std() == 0
    for t in (80, 85, 95):
        bands, rows = N.banding(t)
        assert (1 - (t / 100) ** rows) ** bands <= 1e-5
    assert M.jaccard_at_least(np.arange(17, dtype=np.uint64), np.arange(20, dtype=np.uint64), 85) and not M.jaccard_at_least(np.arange(16, dtype=np.uint64), np.arange(20, dtype=np.uint64), 85)


def test_minhash_query(spark, small):
    out = N.op7_minhash(spark, small).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want, _ = brute_components(texts, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in out} == want and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


# --- embeddings --------------------------------------------------------------------------------------


def brute_links(rows, threshold=0.93):
    """(links of each row, links between rows) by cosine in double precision."""
    usable = {k: np.array(v, float) for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = [
        (a, b)
        for a in usable
        for b in usable
        if a < b and rows[a][2] == rows[b][2] and len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] / np.linalg.norm(usable[a]) / np.linalg.norm(usable[b]) >= threshold
    ]
    count = Counter(x for e in links for x in e)
    return count, links


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("block", [2000, 7])
def test_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "LISTS", 8)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(20):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.standard_normal(16) * rng.uniform(0.02, 0.4)], c % 3))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(5)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None, 1.0], 1), (n + 4, rows[3][1], None), (n + 5, [1.0, 0.0], 1), (n + 6, [2.0, 0.0], 1), (n + 7, [], 1)]
    count, links = brute_links(rows)
    found = E.link_embeddings(spark.createDataFrame(rows, VECTORS)).collect()
    got = {r["n"]["d"]: (r["n_links"], r["c"]["d"]) for r in found}
    want = unions(range(len(rows)), links)
    truth = {k: (count[k], want[k]) for k in range(len(rows))}
    assert got == truth


def test_recall_of_probes_at_the_threshold():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = rng.standard_normal(x.shape)
    d -= (d * x).sum(1, keepdims=True) * x
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    y = 0.9301 * x + math.sqrt(1 - 0.9301**2) * d
    q = E.Quantiser(x)
    found = q.probes(x, q.nearest(x), E.reach_share(64) * E.radius(0.93))[np.arange(len(x)), q.nearest(y)]
    assert found.mean() > 0.99
    assert q.probes(x, q.nearest(x), E.radius(0.93))[np.arange(len(x)), q.nearest(y)].all()  # slack 1 loses nothing
    codes, err = q.encode(x, q.nearest(x))
    for k in range(0, 50):
        of = q.nearest(x[k : k + 1])[0]
        stands_for = np.sqrt(q.adc(x[k : k + 1], of, codes[k : k + 1]))[0, 0]
        assert stands_for <= err[k] + 1e-6


def test_very_large_and_small_vectors(spark):
    rows = [(1, [3e250, 4e250], 1), (2, [3.0, 4.0], 1), (3, [3e-250, 4e-250], 1), (4, [-3e300, 1e300], 1), (5, [0.0, 0.0], 1)]
    out = [(r["n"]["d"], r["n_links"], r["c"]["d"]) for r in E.link_embeddings(spark.createDataFrame(rows, VECTORS.replace("float", "double"))).collect()]
    assert sorted(out) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (5, 0, 5)]


def test_repeats_and_nulls_of_ids(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(None, v, 1), (None, v, 1), (4, v, 1), (4, v, 1), (9, v, 2)]
    out = [(r["n"]["d"], r["n_links"], r["c"]["d"]) for r in E.link_embeddings(spark.createDataFrame(rows, VECTORS)).collect()]
    big = 9223372036854775807
    assert Counter(out) == Counter([(big, 3, 4), (big, 3, 4), (4, 3, 4), (4, 3, 4), (9, 0, 9)])
    assert E.link_embeddings(spark.createDataFrame([], VECTORS)).count() == 0


# --- lines -------------------------------------------------------------------------------------------


def brute_lines(texts, least=L.LEAST):
    """Every line of at least ``least`` characters that an earlier document holds."""
    seen, gone = set(), {}
    for k in sorted(texts):
        lines = (texts[k] or "").split("\n")
        gone[k] = {i for i, x in enumerate(lines) if len(x.strip()) >= least and x.strip() in seen}
        seen |= {x.strip() for x in lines}
    return gone


def test_patience():
    lcs = L.patience([1, 2, 3, 4, 5], [9, 2, 3, 8, 5, 1])
    assert lcs == [(1, 1), (2, 2), (4, 4)]
    assert L.patience([7, 7, 7], [7, 7]) == [(0, 0), (1, 1)] and L.patience([], [1]) == []
    rng = np.random.default_rng(7)
    for _ in range(200):
        a, b = rng.integers(1, 6, rng.integers(0, 14)).tolist(), rng.integers(1, 6, rng.integers(0, 14)).tolist()
        pairs = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_seeds_and_owners():
    long, other = "a line of more than twenty characters", "another line of such a length"
    assert [s[1:] for s in L.seeds(f"{long}\n\n{other}\r\n")] == [(0, 1, 1), (2, 1, 0)]
    assert L.seeds(long)[0] == L.seeds(f"  {long}\r")[0] and L.seeds(None) == L.seeds("\n \n") == L.seeds("too short\nstill") == []
    assert [s[1:] for s in L.seeds("ten chars.\n\nten chars.\nx")] == [(0, 3, 0), (0, 4, 0)]  # from the first line on; up to the last
    spots = [(0, 1, 1, (5, 0), 0, 2, 0), (1, 1, 2, (5, 0), 4, 2, 0), (2, 1, 3, (5, 0), 2, 2, 1), (4, 1, 1, (5, 0), 0, 2, 2), (7, 2, 9, (4, 0), 0, 7, 1)]
    for rounds in (0, 1, 8):  # the rounds decide nothing
        assert L.owners(spots, rounds) == [(0, 7, 5), (7, 2, 4)]
    assert L.owners([(0, 2, 1, (5, 0), 0, 9, 0), (1, 2, 2, (6, 0), 0, 3, 0)]) == [(0, 1, 5), (1, 2, 6)]  # the rarer seed's holder first
    assert L.owners([]) == []


def line(k):
    return f"this is line number {k} of the corpus"


def test_line_dedup_against_brute_force(docs):
    rng = np.random.default_rng(8)
    texts = {}
    for k in range(60):
        own = [line(1000 * k + j) for j in range(rng.integers(1, 6))]
        if k % 3 == 0:
            own.insert(int(rng.integers(0, len(own) + 1)), line(7))  # a line that a third of all documents hold
        if k % 5 == 0:
            own[0:0] = [line(50), "", line(51)]
        if k % 7 == 0:
            own.append("short")
        texts[k] = "\n".join(own)
    texts |= {70: texts[3], 71: None, 72: "", 73: "\n\n", 74: f"  {line(7)}\r\nx"}
    out = {r["doc_id"]: r for r in L.dedup_lines(docs(*texts.items())).collect()}
    gone = brute_lines(texts)
    for k, t in texts.items():
        lines = (t or "").split("\n")
        dropped = {i for b in out[k]["blocks"] or [] for i in range(b["at"], b["at"] + b["lines"])}
        assert gone[k] <= dropped and all(i in gone[k] or len(lines[i].strip()) < L.LEAST for i in dropped), k
        assert out[k]["text"] == (t if not dropped else "\n".join(x for i, x in enumerate(lines) if i not in dropped))
        assert out[k]["n_removed"] == len(dropped) and out[k]["n_lines"] == (0 if t is None else len(lines))
    assert out[70]["text"] == "" and out[71]["text"] is None


def test_line_dedup_keys_and_columns(docs):
    t = "\n".join(line(k) for k in range(3))
    df = docs((1, t), (1, t), (None, t), (None, t), (2, t + "\nnew words at the end of it")).withColumnRenamed("lang", "blocks")
    out = L.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "blocks", "n_lines", "n_removed"]
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(1, t), (1, t), (None, ""), (None, ""), (2, "new words at the end of it")])
    assert L.dedup_lines(df.limit(0)).count() == 0


def passages(texts, least=L.LEAST):
    """Of each document, the lines of every run of at least ``least`` characters that any earlier document holds: all pairs, all runs."""
    rows = {k: [(i, x.strip()) for i, x in enumerate((t or "").split("\n")) if x.strip()] for k, t in texts.items()}
    gone = {}
    for k in sorted(texts):
        own, gone[k] = rows[k], set()
        for e in sorted(texts):
            if e >= k:
                break
            theirs = rows[e]
            for p in range(len(own)):
                for q in range(len(theirs)):
                    if p and q and own[p - 1][1] == theirs[q - 1][1]:
                        continue  # not the start of a longest run
                    n = 0
                    while p + n < len(own) and q + n < len(theirs) and own[p + n][1] == theirs[q + n][1]:
                        n += 1
                    if n and sum(len(own[p + j][1]) for j in range(n)) >= least:
                        gone[k] |= {own[p + j][0] for j in range(n)}
        for (i, _), (j, _) in zip(own, own[1:], strict=False):  # blank lines go with the lines around them
            gone[k] |= set(range(i, j)) if {i, j} <= gone[k] else set()
    return gone


def dropped(rows):
    return {r["doc_id"]: {i for b in r["blocks"] or [] for i in range(b["at"], b["at"] + b["lines"])} for r in rows}


def test_every_shared_passage_goes(docs):
    """200 corpora of their own letters each, lines of 1 to 30 characters, against all pairs and all runs."""
    rng = np.random.default_rng(11)
    texts, groups = {}, []
    for c in range(200):
        letters = [chr(0x4E00 + 30 * c + k) for k in range(8)]
        lines = [x * int(rng.integers(1, 31 if c % 2 else 12)) for x in letters] + ["", " "]
        ids = range(len(texts), len(texts) + int(rng.integers(2, 7)))
        for k in ids:
            own = [lines[j] for j in rng.integers(0, len(lines), rng.integers(0, 13))]
            if k > ids[0] and rng.random() < 0.4:  # a piece of an earlier document, passages in another order or again
                src = texts[int(rng.integers(ids[0], k))].split("\n")
                a = int(rng.integers(0, len(src)))
                own = src[a:] + own + src[: a + 1]
            texts[k] = "\n".join(own)
        groups.append(ids)
    got = dropped(L.dedup_lines(docs(*texts.items())).collect())
    for ids in groups:
        part = {k: texts[k] for k in ids}
        assert {k: got[k] for k in ids} == passages(part), ids
        # nothing that one alignment of whole documents would delete is left
        for k in ids:
            own = [x.strip() for x in texts[k].split("\n")]
            for e in range(ids[0], k):
                number = {"": 0}
                a, b = ([number.setdefault(x, len(number)) for x in t] for t in ([x.strip() for x in texts[e].split("\n")], own))
                run = []
                for i, j in [*L.patience(a, b), (-9, -9)]:
                    if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
                        full = [y for _, y in run if own[y]]
                        assert sum(len(own[y]) for y in full) < L.LEAST or set(full) <= got[k]
                        run = []
                    run.append((i, j))


def test_passages_of_lines_that_others_held_first(docs):
    """No line of the passage is new in either document, their order is."""
    a, b, c = "first short line", "second short line", "third short one"
    texts = {0: a, 1: b, 2: c, 3: f"{a}\n{b}\n{c}", 4: f"own words\n{a}\n\n{b}\n{c}", 5: f"{c}\n{b}\n{a}", 6: f"{line(1)}\n{line(2)}", 7: f"{line(2)}\n{line(1)}\n{line(2)}"}
    got = dropped(L.dedup_lines(docs(*texts.items())).collect())
    assert got == {0: set(), 1: set(), 2: set(), 3: set(), 4: {1, 2, 3, 4}, 5: set(), 6: set(), 7: {0, 1, 2}} == passages(texts)


def test_many_lines_and_reversed_order(docs):
    n = 3000
    whole = [line(k) for k in range(n)]
    texts = {0: "\n".join(whole), 1: "\n".join(whole[::-1]), 2: "\n".join(["x y"] * n), 3: "\n".join(["x y"] * n), 4: "z" * 1_000_000, 5: "q\n" + "z" * 1_000_000}
    got = dropped(L.dedup_lines(docs(*texts.items())).collect())
    assert [len(got[k]) for k in range(6)] == [0, n, 0, n, 0, 1]


def test_rare_lines_only_pair_with_their_first_holder(docs):
    """Pairs grow with the rows of a line's group, not with their square."""
    df = docs(*[f"{line(1)}\n{line(100 + k)}" for k in range(50)])
    found = L.find_blocks(df)
    assert found.count() == 49 and found.select(F.explode("blocks").alias("b")).select("b.first_doc").distinct().collect()[0][0] == 0


HELPERS = ["_d", "_h", "_t", "_s", "_rows", "_again", "row", "n", "c", "d1", "d2", "bands", "_seeds", "_spots", "w", "_D"]


def test_columns_named_like_helpers_are_carried(docs):
    t = "\n".join(line(k) for k in range(3))
    df = docs((1, t), (1, t), (2, t + "\nnew words at the end of it"), (None, None), (4, ""))
    for k, name in enumerate(HELPERS[:-1]):
        df = df.withColumn(name, F.lit(k))
    own = HELPERS[:-1]
    cleaned = L.dedup_lines(df)
    assert cleaned.columns == [*df.columns, "blocks", "n_lines", "n_removed"]
    assert all([r[n] for n in own] == list(range(len(own))) for r in cleaned.collect()) and cleaned.count() == 5
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert all([r[n] for n in own] == list(range(len(own))) for r in rows) and sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "4", "None"]
