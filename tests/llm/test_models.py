import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.llm import quality, toxicity
from tallyworks.llm.common import held_out, labelled_sample

BAD, FINE = ["grotbag", "numpty", "wazzock"], "the quiet river runs past old stone houses under a pale winter sky".split()


def toxic_rows(n=300):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(n):
        words = list(rng.choice(FINE, 30))
        if k % 3 == 0:
            words[5], words[12] = rng.choice(BAD), rng.choice(BAD) + ","
        elif k % 10 == 1:
            words[5:6] = ["reportedly", "said", f'"{rng.choice(BAD)}"', "yesterday"]
        rows.append((" ".join(words), int(k % 3 == 0)))
    return rows


@pytest.fixture(scope="module")
def model():
    return toxicity.ToxicityModel(toxic_rows())


def test_automaton_against_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    terms = ["abba", "scums", "scummy", "disgustingly", "moron", "extraordinarily"]
    auto = toxicity.LexiconAutomaton(terms)
    rng = np.random.default_rng(1)
    for _ in range(4000):
        word = list(terms[rng.integers(len(terms))])
        for _ in range(rng.integers(0, 4)):
            k = rng.integers(0, len(word) + 1)
            kind = rng.integers(3)
            if kind == 0:
                word.insert(k, rng.choice(list("abcdemnsuy")))
            elif k < len(word):
                if kind == 1:
                    del word[k]
                else:
                    word[k] = rng.choice(list("abcdemnsuy"))
        w = "".join(word)
        best = min(((distance(w, t), n) for n, t in enumerate(terms) if distance(w, t) <= auto.edits(t)), default=None)
        assert auto.match(w) == best, w


def test_lexicon_and_scores(model):
    assert set(model.terms) == set(BAD)
    auto = model.automaton()
    score = lambda t: model.score(t, auto, {})
    assert score(f"you {BAD[0]} , what a {BAD[1]}") > 0.5 and score("you grotbagg , what a nummpty") > 0.5  # misspelled
    assert score(" ".join(FINE)) < 0.5 and score(None) == score("") == score("  ") < 0.5
    assert score(f'he said "{BAD[0]}" once') < score(f"he said {BAD[0]} once")
    hits = model.spans(f'A {BAD[2].upper()}! and "{BAD[1]}"', auto)
    assert [(h[0], h[1], h[2], h[3]) for h in hits] == [(1, BAD[2], 0, False), (3, BAD[1], 0, True)]
    assert toxicity.ToxicityModel([]).score("x", None, {}) == 0.0 and toxicity.ToxicityModel([("a", 1)]).constant


def test_stems_are_subtrees_of_the_automaton():
    auto = toxicity.LexiconAutomaton(["grotbag", "grot*", "abba", "grotesque"])
    assert [auto.match(w) for w in ("grotbag", "grotbug", "grot", "grotxyz", "gro", "grott", "abbx", "xgrot", "grotesque", "grotesqeu")] == [
        (0, 0), (0, 1), (0, 1), (0, 1), None, (0, 1), (1, 2), None, (0, 3), (0, 1)]


def test_misspellings_of_rare_terms():
    """Terms in under 1 % of the toxic rows: forms that no row of the sample holds score, words of clean rows near a term don't."""
    rng = np.random.default_rng(9)
    syllables = "ba de fi go ku la me ni po ru sa te".split()
    fine = ["".join(rng.choice(syllables, 3)) for _ in range(400)]
    common, rare = ["grotbag", "numpty", "wazzock"], ["snollyx", "mumpsik", "quibvent", "gorf"]
    rows = []
    for k in range(6000):
        words = list(rng.choice(fine, 25))
        if k % 3 == 0:
            words[int(rng.integers(25))] = rng.choice(common)
            if k % 333 < 12:
                words[3] = words[9] = rare[k // 3 % 4]
        else:
            words[2] = "grotbat"  # a clean word near a term
        rows.append((" ".join(words), int(k % 3 == 0)))
    m = toxicity.ToxicityModel(rows)
    assert set(rare) <= set(m.terms) and all(sum(t in x.split() for x, y in rows if y) < 0.01 * 2000 for t in rare)
    auto, plain = m.automaton(), " ".join(fine[:20])
    score = lambda w: m.score(f"{plain} {w} {plain}", auto, {})
    for w in ("snolyx", "snollyyx", "mumpsjk", "quibvemt", "quibven", "gorrf"):
        assert score(w) > max(0.5, score("grotbat")), w
    assert score("grotbat") == score("") < 0.5


def test_scripts_without_blanks():
    rng = np.random.default_rng(10)
    letters = [chr(0x4E00 + 7 * k) for k in range(200)]
    rows = []
    for k in range(400):
        t = list(rng.choice(letters, 60))
        if k % 4 == 0:
            t[10:10] = "\u8822\u8d27"
            t[40:40] = "\u8822\u8d27"
        rows.append(("".join(t), int(k % 4 == 0)))
    m = toxicity.ToxicityModel(rows)
    assert m.terms == ["\u8822\u8d27"] and toxicity.words_of("a \u4e00\u4e8c\u4e09b") == ["a", "\u4e00\u4e8c", "\u4e8c\u4e09", "b"]
    plain = "".join(letters[:30])
    assert m.score(plain + "\u8822\u8d27" + plain + "\u8822\u8d27", m.automaton(), {}) > 0.5 > m.score(plain, m.automaton(), {})


def test_samples_are_bounded(spark, docs):
    """One id on very many rows, or very long texts, don't go beyond the bounds."""
    labels = spark.createDataFrame([(k, 1) for k in range(1, 40)], "doc_id long, toxic int")
    n = 5000
    df = docs(*[(1, f"text {k}") for k in range(n)], *[(2, "same")] * n, *[(k, "x" * 1000) for k in range(3, 40)])
    few = labelled_sample(df, labels, "toxic", 20)
    assert few.count() <= 60 and few.groupBy("doc_id", "text").count().where("count > 1").isEmpty()
    assert labelled_sample(df, labels, "toxic", 10**6).count() == labelled_sample(df.distinct(), labels, "toxic", 10**6).count()
    assert labelled_sample(df.where("doc_id > 2"), labels, "toxic", 10**6, 10_000).agg(F.sum(F.length("text"))).first()[0] <= 20_000


def test_toxicity_frames(spark, docs):
    rows = toxic_rows(240)
    df = docs(*[t for t, _ in rows], (None, None), (7, rows[7][0]))
    labels = spark.createDataFrame([(k, y, y) for k, (_, y) in enumerate(rows)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    m = toxicity.fit(df, labels)
    got = toxicity.scores(df, m, ["doc_id"]).withColumn("h", held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) + 2 and all(0 <= r["score"] <= 1 for r in got)
    test = [(r["score"] >= 0.5, rows[r["doc_id"]][1]) for r in got if r["h"] and r["doc_id"] is not None]
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    assert np.mean([p == bool(y) for p, y in test]) > 0.97
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.scores(df, toxicity.fit(df, flipped), ["doc_id"]).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in got) == sorted((str(r["doc_id"]), r["score"]) for r in again)
    full = toxicity.score_documents(df.withColumnRenamed("lang", "score"), m)
    assert full.columns == ["doc_id", "text", "source", "n_chars", "score", "hits"] and full.where("size(hits) > 0").count() >= 80
    assert toxicity.scores(df, toxicity.fit(df, labels.limit(0)), ["doc_id"]).where("score <> 0").isEmpty()
    assert toxicity.scores(df.limit(0), m, ["doc_id"]).count() == 0


def test_statistics():
    s = dict(zip(quality.NAMES, quality.statistics("AB cd, cd!\n12 | é"), strict=True))
    assert s["upper"] == pytest.approx(2 / 18) and s["pipe"] == pytest.approx(1 / 18) and s["unique_words"] == 1.0 and s["unique_lines"] == 1
    assert not quality.statistics(None).any() and not quality.statistics(" \n ").any() and np.isfinite(quality.statistics("x" * 10**5)).all()
    assert dict(zip(quality.NAMES, quality.statistics("a a a"), strict=True))["repeat_next"] == pytest.approx(2 / 3)


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(2)
    x, y = rng.permutation(40).astype(float), rng.integers(0, 2, 40).astype(float)
    knots, values = quality.isotonic(x, y)
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
    o = y[np.argsort(x)]
    # min-max formula of the rising least-squares fit
    brute = [max(min(o[a : b + 1].mean() for b in range(k, len(o))) for a in range(k + 1)) for k in range(len(o))]
    assert sorted(set(np.round(brute, 9))) == sorted(set(np.round(values, 9)))


def test_quality_frames(spark, docs):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(260):
        words = list(rng.choice(FINE, 40))
        rows.append((" | ".join(words) if k % 4 == 0 else " ".join(words) + ".", int(k % 4 != 0)))
    df = docs(*[t for t, _ in rows], (None, None), (9, ""))
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, quality int")
    m = quality.fit(df, labels)
    got = quality.score_documents(df, m, ["doc_id", "n_chars"]).collect()
    assert len(got) == 262 and all(0 <= r["score"] <= 1 and len(r["stats"]) == len(quality.NAMES) for r in got)
    first = {r["doc_id"]: r["score"] for r in got if r["n_chars"]}
    assert np.mean([(first[k] >= 0.3) == bool(y) for k, (_, y) in enumerate(rows) if zlib.crc32(str(k).encode()) % 5 == 0]) > 0.97
    assert quality.fit(df, labels.limit(0)).constant == 0.5 and quality.fit(df, labels.where("quality = 1")).constant == 1.0
    assert quality.score_documents(df.limit(0), m, ["doc_id"]).count() == 0


def test_normal_equations_sum_over_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(2)), False, rng.random(len(quality.NAMES)).tolist()) for _ in range(50)]
    df = spark.createDataFrame(rows, "label int, calibrates boolean, stats array<double>").repartition(7)
    n, total = quality._summed(df, lambda y, x: [np.array([len(y)]), x.sum(0)])
    assert n[0] == 50 and np.allclose(total, np.array([r[2] for r in rows]).sum(0))


def test_queries(spark, small):
    for q in (toxicity.op2_toxicity, quality.op3_quality):
        out = q(spark, small)
        assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 200 and out.where("score is null or score < 0 or score > 1").isEmpty()


def test_stems_and_copies():
    """Endings that never came before count through their stem; words of copied texts are no terms."""
    rng = np.random.default_rng(5)
    endings = [f"{a}{b}" for a in "aeiou" for b in "klmnpr"]
    rows = []
    for k in range(600):
        words = list(rng.choice(FINE, 40))
        if k % 4 == 0:
            words[7], words[21] = "grotb" + rng.choice(endings[:20]), "grotb" + rng.choice(endings[:20])
        rows.append((" ".join(words), int(k % 4 == 0)))
    rows += [(f"copied text zebulon qwixote {rows[0][0]} end of it", 1)] * 8
    m = toxicity.ToxicityModel(rows)
    assert "grotb*" in m.terms and not {"zebulon", "qwixote"} & set(m.terms)
    assert m.score("you grotbur grotbup", m.automaton(), {}) > 0.5 and m.score("you grot", m.automaton(), {}) < 0.5
