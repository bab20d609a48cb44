import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyworks.llm import decontaminate as D
from tallyworks.llm.common import materialize

ITEMS = "item_id long, text string"
A = "a train leaves the station at noon and runs for 3 hours at 80 km per hour through the valley of Ebro, how far does it get"
B = "the baker sells seven kinds of bread each morning and counts every loaf that is left before closing time"
SHORT = "what is the colour of milk"


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, A), (2, B), (3, SHORT), (4, "tiny"), (5, None), (None, B)], ITEMS)


def leaks(docs, bench, *texts):
    return sorted((r["_d"], r["item_id"]) for r in D.find_leaks(docs(*texts), bench).collect())


def test_copies_and_reparameterised(docs, bench):
    other = A.replace("3 hours", "7 hours").replace("80 km", "95 km").replace("Ebro", "Tajo")
    texts = [
        f"Some words before. {A} and after", A.upper(), B.replace(",", ";").replace(" ", "  "), other, f"intro text {SHORT} outro", " ".join(B.split()[:8]) + " and then quite other things happen in this text",
        "a train of thought leaves the station of reason at noon", None, "", "tiny",
    ]
    assert leaks(docs, bench, *texts) == [(0, 1), (1, 1), (2, 2), (3, 1), (4, 3), (9, 4)]


def test_slots_must_agree(spark, docs):
    item = "if x costs 5 coins and y costs 5 coins and z costs 9 coins then the sum of all of them in the basket is what"
    bench = spark.createDataFrame([(1, item)], ITEMS)
    good, bad = item.replace("5", "8").replace("9", "2"), item.replace("costs 5", "costs 6", 1).replace("costs 5", "costs 7").replace("9", "6")
    assert leaks(docs, bench, good) == [(0, 1)]
    r = D.find_leaks(docs(bad), bench, consistent=0.0).first()
    assert r["agreement"] < 1 and leaks(docs, bench, f"{good} . {bad}") == [(0, 1)]
    assert D.find_leaks(docs(bad), bench, consistent=0.95).isEmpty()


def test_other_uses_of_a_template_hide_no_copy(spark, docs):
    item = "if x costs 5 coins and y costs 5 coins and z costs 9 coins then the sum of all of them in the basket is what"
    bench = spark.createDataFrame([(1, item)], ITEMS)
    bad = item.replace("costs 5", "costs 6", 1).replace("costs 5", "costs 7").replace("9", "6")
    assert leaks(docs, bench, f"{item} . {bad} . {bad}", f"{bad} . {bad}") == [(0, 1)]


def test_every_text_of_an_id_is_searched(spark, docs):
    bench = spark.createDataFrame([(1, A), (1, B), (None, A + " " + B), (None, B), (2, B)], ITEMS)
    found = lambda *t: Counter((r["_d"], r["item_id"]) for r in D.find_leaks(docs(*t), bench, coverage=0.9, long=1000).collect())
    assert found(A, B) == Counter([(0, 1), (1, 1), (1, 2)]) and found((7, A + " " + B)) == Counter([(7, 1), (7, 1), (7, 2), (7, None)])


def test_case_layout_and_sentence_starts(spark, docs):
    names = "today Anna gives old Bernd some pears while young Clara gives poor Dieter more plums and then Emil asks dear Frida how many fruits"
    starts = "Alice has 3 red pens in the box. Bob gives 4 pens to her now. Carol takes 2 pens out again. Dave asks how many are left"
    bench = spark.createDataFrame([(1, names), (2, starts)], ITEMS)
    other = starts.replace("Alice", "Nina").replace("Bob", "Otto").replace("Carol", "Paula").replace("Dave", "Quint").replace("3", "8")
    texts = [names, names.lower(), names.upper(), names.title(), names.replace(" ", "\n"), names.replace(" ", "  \t"), starts.lower(), other, other.replace(" ", "\u00a0\n"),
        starts.replace("Bob", "Alice").replace("pens", "of")]
    assert leaks(docs, bench, *texts) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 2), (7, 2), (8, 2)]


def test_slot_heavy_windows_join_by_value(spark, docs):
    item = "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"
    bench = spark.createDataFrame([(1, item)], ITEMS)
    assert leaks(docs, bench, item, " ".join(str(k) for k in range(40, 70)), f"x {item} y") == [(0, 1), (2, 1)]


def test_short_and_number_heavy_items_by_template(spark, docs):
    bench = spark.createDataFrame([(1, "What is 17 times 23?"), (2, "Solve 3 x + 5 = 20"), (3, "Convert 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20")], ITEMS)
    run = " ".join(str(k) for k in range(40, 60))
    texts = ["now what is 18 times 46 then", "what is 17 times 23", "what is 5 times 5", "what is 5 by 6", "please solve 4 x + 6 = 30", "solve 4 x + 6", f"Convert {run}",
        " ".join(f"Convert {run}".split()[:12] + ["and"] + run.split()[12:])]
    assert leaks(docs, bench, *texts) == [(0, 1), (1, 1), (4, 2), (6, 3)]


def test_items_of_any_length(spark, docs):
    """Under four tokens the real values count; one token only where a document is nothing else."""
    bench = spark.createDataFrame([(1, "Name the capital"), (2, "Tiny"), (3, "7 times"), (4, "?!")], ITEMS)
    texts = ["please name  the\ncapital, now", "Name a capital", "tiny.", "a tiny thing", "it is 7 times more", "it is 8 times more", "?!"]
    assert leaks(docs, bench, *texts) == [(0, 1), (2, 2), (4, 3)]


def test_word_problems(spark, docs):
    tom = "Tom has 5 apples. Ann gives him 3 more. How many apples has Tom now?"
    crates = "a farmer packs two crates with pears and seven crates with plums, how many crates does the farmer pack"
    bench = spark.createDataFrame([(1, tom), (2, crates)], ITEMS)
    texts = [tom, "Bob has 7 apples. Eve gives him 4 more. How many apples has Bob now?", "Bob has 7 apples. Bob gives him 7 more. How many apples has Eve now?",
        crates.replace("two", "9").replace("seven", "four"), crates.replace("two", "Twelve"), crates.replace("pears", "x").replace("plums", "y").replace("how", "z")]
    assert leaks(docs, bench, *texts) == [(0, 1), (1, 1), (3, 2), (4, 2)]


def test_agreement_goes_both_ways(spark, docs):
    item = "if x costs 5 coins and y costs 6 coins and z costs 9 coins then the sum of all of them in the basket is what"
    bench = spark.createDataFrame([(1, item)], ITEMS)
    same = item.replace("5", "7").replace("6", "7").replace("9", "7")
    assert leaks(docs, bench, same, item.replace("5", "70").replace("6", "5").replace("9", "6")) == [(1, 1)]


def test_templates_against_brute_force(spark, docs):
    """Items of words and numbers: windows, coverage and agreement, recomputed with plain sets over all pairs of places."""
    rng = random.Random(4)
    words = "amber birch cedar daisy elder fern grape holly iris jade kelp lily maple nettle olive pine".split()
    draw = lambda n: " ".join(str(rng.randint(10, 14)) if k % 3 == 2 and rng.random() < 0.7 else rng.choice(words) for k in range(n))
    items = {k: draw(rng.randint(8, 24)) for k in range(12)}
    texts = {}
    for d in range(90):
        src = items[rng.randrange(12)].split()
        a = rng.randint(0, len(src) // 2)
        swap = {str(v): str(rng.randint(10, 14)) for v in range(10, 15)}
        piece = [swap.get(x, x) if rng.random() < 0.9 else str(rng.randint(10, 14)) if x in swap else x for x in src[a:]]
        texts[d] = " ".join([*words[: rng.randint(0, 3)], *piece, *(src if d % 9 == 0 else []), "end"])

    def windows(text):
        own = text.split()
        return [(i, tuple("#" if x.isdigit() else x for x in own[i : i + 8]), [x for x in own[i : i + 8] if x.isdigit()]) for i in range(len(own) - 7)]

    want = []
    for d, t in texts.items():
        for k, x in items.items():
            keys, lines = {w for _, w, _ in windows(x)}, {}
            for p, w, v in windows(x):
                for q, u, z in windows(t):
                    if w == u:
                        got, pairs = lines.setdefault(q - p, (set(), set()))
                        got.add(w)
                        pairs.update(zip(v, z, strict=True))
            each = [(g, len(ps), min(len({a for a, _ in ps}), len({b for _, b in ps}))) for g, ps in lines.values()]
            for part in (each, [e for e in each if not e[1] or e[2] / e[1] >= 0.8]):
                found, n, ok = set().union(*(g for g, _, _ in part)), sum(e[1] for e in part), sum(e[2] for e in part)
                if (len(found) >= 0.5 * len(keys) or len(found) >= 13) and found and (not n or ok / n >= 0.8):
                    want.append((d, k))
                    break
    assert leaks(docs, spark.createDataFrame(list(items.items()), ITEMS), *texts.items()) == sorted(want) and 30 < len(want) < 150


def test_long_texts_and_odd_ids(spark, docs):
    bench = spark.createDataFrame([(1, A)], ITEMS)
    long = "word " * 60_000 + A + " 7 km" * 60_000
    assert leaks(docs, bench, long, "x" * 1_000_000, "1" * 300_000) == [(0, 1)]
    df = spark.createDataFrame([("a", A), ("5", A), (None, "none")], "doc_id string, text string")
    assert sorted(r["_d"] for r in D.find_leaks(df, bench).collect()) == [5, 9223372036854775807] and [r["text"] for r in D.drop_leaks(df, bench).collect()] == ["none"]


def test_windows_against_brute_force(spark, docs):
    """Texts without slots: coverage is the share of the item's distinct runs of eight words."""
    words = "amber birch cedar daisy elder fern grape holly iris jade kelp lily maple nettle olive pine".split()
    items = {k: " ".join(words[k:] + words[:k] + words[::-1][:k]) for k in range(6)}
    texts = {k: " ".join(words[k % 5 :] * 2) for k in range(12)}
    runs = lambda t: {tuple(t.split()[i : i + 8]) for i in range(len(t.split()) - 7)}
    want = sorted((d, i) for d, t in texts.items() for i, x in items.items() if len(runs(t) & runs(x)) >= min(0.5 * len(runs(x)), 13))
    assert leaks(docs, spark.createDataFrame(list(items.items()), ITEMS), *texts.items()) == want


def test_rows_and_native_plan(spark, docs, bench, monkeypatch):
    df = docs((1, A), (1, A), (1, "clean"), (None, A), (None, "clean too"), (2, None)).withColumnRenamed("lang", "_w").withColumnRenamed("source", "item_id")
    kept = D.drop_leaks(df, bench)
    assert kept.columns == df.columns and Counter(r["text"] for r in kept.collect()) == Counter(["clean", "clean too", None])
    assert D.drop_leaks(df, bench.limit(0)).count() == 6 and D.find_leaks(df.limit(0), bench).isEmpty()
    with monkeypatch.context() as m:  # one plan, without the tables in between
        m.setattr(D, "materialize", lambda x, *_: x)
        whole = D.find_leaks(df, bench)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    monkeypatch.setattr(D, "BROADCAST", 0)
    assert sorted((r["_d"], r["item_id"]) for r in D.find_leaks(df.where("doc_id is not null"), bench).collect()) == [(1, 1)]


def test_a_phrase_of_many_items_makes_no_pairs(spark, docs, monkeypatch):
    """n clean pages and n items share one stock phrase; items that consist of such phrases alone are still found."""
    phrase = "which of the following statements about the topic below is most likely to be correct"
    other = "please choose the single best answer from the list and explain briefly why you chose it"
    letters = lambda k: "abcdefghij"[k // 10] + "abcdefghij"[k % 10]
    own = lambda kind, k: " ".join(f"{kind}{letters(k)}q{letters(j)}" for j in range(16))
    seen = {}

    def counted(df, label="cut", rows_per_file=0):
        out = materialize(df, label, rows_per_file)
        seen[label] = out.count()
        return out

    monkeypatch.setattr(D, "materialize", counted)
    sizes = []
    for n in (20, 60):
        bench = spark.createDataFrame([(k, f"{phrase} {own('item', k)}") for k in range(n)] + [(9_000, f"{phrase} {other}"), (9_001, f"{other} {phrase}")], ITEMS)
        rows = [(k, f"{own('page', k)} {phrase} {own('tail', k)}") for k in range(n)] + [(5_000, f"intro {phrase} {own('item', 3)} outro"), (5_001, f"x {phrase} {other} y"), (5_002, f"{other} {own('z', 1)}")]
        got = {(r["_d"], r["item_id"]) for r in D.find_leaks(docs(*rows), bench).collect()}
        assert {(5_000, 3), (5_001, 9_000)} <= got and {d for d, _ in got} <= {5_000, 5_001, 5_002} and not {i for d, i in got if d == 5_000} - {3}
        sizes.append(seen["met"])
    assert sizes[1] < 20 * 60 and sizes[1] <= 4 * sizes[0]


def test_query_against_plain_search(spark, small):
    rows = D.op1_decontaminate(spark, small).collect()
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    items = [(r["item_id"], " ".join(words(r["text"]))) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    whole = {(d["doc_id"], i) for d in spark.read.parquet(f"{small}/documents.parquet").collect() for i, t in items if t in " ".join(words(d["text"]))}
    assert whole <= {(r["doc_id"], r["item_id"]) for r in rows} and {r["doc_id"] for r in rows} == {d for d, _ in whole}


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "byte_bpe"] and corpus_pipeline.ORACLE_SQL is None
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        assert out.columns[: len(columns)] == columns and (k == 4 or out.columns == columns)
        docs = materialize(out)
        counts.append(docs.count())
    assert counts[2] == counts[1] and counts[5] == counts[4] and 0 < counts[5] < counts[0]
    assert docs.where("not round_trip or n_tokens <> size(ids)").isEmpty()
    whole = corpus_pipeline.run(spark, small)
    assert whole.select("doc_id", "n_tokens").exceptAll(docs.select("doc_id", "n_tokens")).isEmpty() and whole.count() == counts[5]


OWN = ("score", "label", "blocks", "n_lines", "item_id", "bands", "c", "n", "_d", "_h", "_again", "_toxicity", "_own_blocks", "row", "_s", "_scored")


def test_pipeline_with_odd_rows(spark, docs, tmp_path):
    odd = docs((1, None), (2, ""), (None, "some words that stand here alone for once"), (3, A), (3, A), (4, "x" * 50_000)).withColumn("extra", F.lit(1)).withColumn("ids", F.lit("clash"))
    for name in OWN:
        odd = odd.withColumn(name, F.lit(f"own {name}"))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, A)], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["text"] and len(r["text"])) for r in out) == [("1", None), ("2", ""), ("4", 50_000), ("None", 41)] and all(r["round_trip"] for r in out)
    assert all(r[n] == f"own {n}" for r in out for n in OWN)
    empty = tmp_path / "empty"
    odd.limit(0).write.parquet(str(empty / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).write.parquet(str(empty / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
