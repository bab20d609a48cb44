"""Positions, pages and the display of imports against plain Python."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyworks.operators import ingest, ledger as L, ordering
from tallyworks.streaming import progress

NAMES = ["import_id", "seq", "type", "total", "name", "status", "vision_would_help", "imported", "needs_review", "duplicates", "failed"]


def events(seed, n, imports):
    rng, out = random.Random(seed), []
    for seq in range(n):
        kind = rng.choices(["started", "file", "finished"], [1, 8, 1])[0]
        row = dict.fromkeys(NAMES) | {"import_id": rng.choice(imports), "seq": seq, "type": kind}
        if kind == "started":
            row["total"] = rng.randint(1, 9)
        elif kind == "file":
            row |= {"name": f"f{seq}", "status": rng.choice(list(ingest.COUNTED.values())), "vision_would_help": rng.choice([True, False, None])}
        else:
            row |= {c: rng.randint(0, 5) for c in ingest.COUNTED}
        out.append(row)
    return out


def folded(rows):
    """What reduce_ingest says of each import, as the rows of PROGRESS."""
    out = {}
    for k in {r["import_id"] for r in rows}:
        own = [r for r in rows if r["import_id"] == k]
        state = {**ingest.IDLE, "tally": dict(ingest.IDLE["tally"])}
        for r in own:
            state = ingest.reduce_ingest(state, r)
        out[k] = (own[-1]["seq"], state["phase"], state["total"], state["done"], state["current_name"], *[state["tally"][s] for s in ingest.COUNTED.values()], state["vision_candidates"], len(state["problems"]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_progress_of_all_events(spark, seed):
    rows = events(seed, 400, [1, 1, 1, 2, 3, 4, 5])
    got = ingest.progress(spark.createDataFrame(rows, ingest.EVENT)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == folded(rows)
    assert ingest.progress(spark.createDataFrame([], ingest.EVENT)).collect() == []


def test_any_split_ends_in_the_same_state():
    rng = random.Random(3)
    for seed in range(40):
        rows = events(seed, 60, [1])
        state, at = dict(progress.BLANK), 0
        while at < len(rows):
            step = rng.randint(1, 15)
            part = pd.DataFrame(rows[max(0, at - rng.randint(0, 9)) : at + step]).sample(frac=1, random_state=seed)  # some come again, none in order
            state, at = progress.fold(state, part), at + step
        assert tuple(state[f] for f in progress.FIELDS) == folded(rows)[1]


def test_stream(spark, tmp_path):
    rows = events(7, 200, [1, 2, 3])
    store = progress.progress_table(spark, str(tmp_path / "store"))
    for k, part in enumerate((rows[:80], rows[80:150], rows[60:200])):
        spark.createDataFrame(part, ingest.EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        progress.follow(progress.watch_events(spark, str(tmp_path / "events")), store, str(tmp_path / "checkpoint")).awaitTermination()
        assert store.manifest().version == k + 1
    assert {r[0]: tuple(r)[1:] for r in store.tables["progress"].read().collect()} == folded(rows)


def test_positions(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, "a", "b", "b", "b"]), rng.choice([None, 1, 2])) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v int")
    got = ordering.positions(df, [F.col("v").desc_nulls_last(), F.col("id").asc()], ["g"])
    for g in (None, "a", "b"):
        want = [r[0] for r in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))]
        own = got.where(F.col("g").eqNullSafe(F.lit(g))).orderBy("position").collect()
        assert [r["id"] for r in own] == want and [r["position"] for r in own] == list(range(len(want)))
    assert ordering.positions(df.limit(0), [F.col("id")]).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize(("key", "desc"), [("date", True), ("seller", False), ("amount", True), ("seller", True)])
def test_pages_follow_each_other(spark, key, desc):
    rng = random.Random(2)
    rows = [(k, f"2024-01-{rng.randint(1, 9):02d}", rng.choice(["王", "李", "O'Neil", "back\\slash", "安"]), rng.randint(0, 5)) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, issued_on_s string, seller_s string, total_cents long")
    whole = [r["id"] for r in L.sort_rows(df, key, desc).collect()]
    seen, last = [], None
    column = {"date": "issued_on_s", "seller": "seller_s", "amount": "total_cents"}[key]
    while page := ordering.page_after(df, key, desc, last, 15).collect():
        seen += [r["id"] for r in page]
        last = (page[-1][column], page[-1]["id"])
    assert seen == whole


def test_chunks_of_a_hot_key(spark):
    rows = [(k, "hot" if k % 3 else f"k{k // 6}") for k in range(900)] + [(5_000, ""), (5_001, ""), (5_002, "alone")]
    df = spark.createDataFrame(rows, "id long, dedup_key string")
    got = {(r["dedup_key"], r["chunk"]): r["ids"] for r in L.duplicate_chunks(df, df, 100).collect()}
    hot = [k for k, key in rows if key == "hot"]
    assert [x for c in range(6) for x in got["hot", c]] == hot and max(map(len, got.values())) == 100
    assert {k for k, _ in got} == {"hot", *(f"k{n}" for n in range(150))}
    page = {r["id"]: r["ids"] for r in L.duplicate_page(df.where("id IN (1, 3, 5002)"), L.duplicate_chunks(df, df, 100), 1).collect()}
    assert page == {1: hot[100:200]}


def test_stream_aggregates_its_batches(spark, tmp_path):
    """No import's events pass through one task; replays, repeated events and files without a name count as in order."""
    rows = events(8, 240, [1, 1, 1, 2, 3])
    for r in rows[::7]:
        r["name"] = None
    store = progress.progress_table(spark, str(tmp_path / "store"))
    for part in (rows[:90], rows[:90], rows[70:150] * 2, rows[150:152], rows[120:]):
        spark.createDataFrame(part, ingest.EVENT).repartition(3).write.mode("append").parquet(str(tmp_path / "events"))
        query = progress.follow(progress.watch_events(spark, str(tmp_path / "events"), 100), store, str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert not query.lastProgress["stateOperators"]
    assert {r[0]: tuple(r)[1:] for r in store.tables["progress"].read().collect()} == folded(rows)
