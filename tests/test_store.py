"""Change sets: only touched buckets are written, tables move together, the last change wins."""

import os
import random

import pytest

from tallyworks.operators.store import Store, deletes, upserts
from tallyworks.schema import REPORT_INVOICE, SETTING


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.table("settings", SETTING, ["key"], buckets=8, children={"report_invoices": "invoice_id"})
    s.table("report_invoices", REPORT_INVOICE, ["report_id", "invoice_id"], "invoice_id", buckets=8)
    return s


def held(table):
    return {f: sorted(os.listdir(f)) for f in table.files().values()}


def test_untouched_buckets_keep_their_files(spark, store):
    t = store.tables["settings"]
    assert t.read().isEmpty() and t.last_id == 0
    t.apply(upserts(spark.createDataFrame([(str(k), "a") for k in range(200)], SETTING)), 200)
    before = held(t)
    change = spark.createDataFrame([("7", "b")], SETTING)
    (touched,) = t.buckets_of(change)
    t.apply(upserts(change))
    after = held(t)
    assert len(before) == len(after) == 8 and len(set(before) & set(after)) == 7
    assert all(before[f] == after[f] for f in set(before) & set(after)) and t.files()[touched] not in before
    assert dict(map(tuple, t.read().collect()))["7"] == "b" and t.read().count() == 200 and t.last_id == 200
    assert t.read_keys(change).collect() == change.collect()


def test_last_change_wins(spark, store):
    t, rng, want = store.tables["settings"], random.Random(1), {}
    for _ in range(3):
        rows = [(str(rng.randint(0, 30)), str(k), k, rng.random() < 0.4) for k in range(60)]
        for key, value, _, gone in rows:
            want.pop(key, None)
            if not gone:
                want[key] = value
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "key string, value string, seq long, gone boolean")
        t.apply(upserts(df.where("NOT gone"), df["seq"]).unionByName(deletes(df.where("gone"), df["seq"])).drop("seq", "gone"))
        assert dict(map(tuple, t.read().collect())) == want
    t.apply(deletes(t.read().select("key")))
    assert t.read().isEmpty()


def test_lines_go_with_their_row(spark, store):
    settings, lines = store.tables["settings"], store.tables["report_invoices"]
    line = lambda *rows: spark.createDataFrame(rows, REPORT_INVOICE)
    store.apply({"settings": upserts(spark.createDataFrame([("1", "a"), ("2", "b")], SETTING)), "report_invoices": upserts(line((9, 1, 0), (9, 2, 1), (8, 1, 0)))})
    version = store.manifest().version
    # the same commit adds a line to the row that goes
    store.apply({"settings": deletes(spark.createDataFrame([("1",)], "key string")), "report_invoices": upserts(line((7, 1, 0), (7, 2, 0)))})
    assert store.manifest().version == version + 1
    assert sorted(map(tuple, lines.read().collect())) == [(7, 2, 0), (9, 2, 1)] and settings.read().count() == 1


def test_nothing_counts_before_the_manifest(spark, store, monkeypatch):
    t = store.tables["settings"]
    t.apply(upserts(spark.createDataFrame([("1", "a")], SETTING)))

    def fails(made):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", fails)
        with pytest.raises(RuntimeError):
            t.apply(upserts(spark.createDataFrame([("1", "b"), ("2", "c")], SETTING)))
    assert t.read().collect() == [("1", "a")]
    t.apply(upserts(spark.createDataFrame([("2", "c")], SETTING)))
    assert t.read().count() == 2


def test_batches_come_once(spark, store):
    t = store.tables["settings"]
    rows = upserts(spark.createDataFrame([("1", "a")], SETTING))
    assert store.apply({"settings": rows}, batch=("s", 3)) and not store.apply({"settings": rows}, batch=("s", 3)) and not store.apply({"settings": rows}, batch=("s", 2))
    assert store.apply({"settings": rows}, batch=("other", 0)) and store.manifest().version == 2


def test_old_files_go(spark, store):
    t = store.tables["settings"]
    for k in range(4):
        t.apply(upserts(spark.createDataFrame([("1", str(k))], SETTING)))
    kept = sorted(os.listdir(f"{store.path}/_manifest"))
    left = [d for d in os.listdir(f"{store.path}/settings") if any(x.startswith("bucket=") for x in os.listdir(f"{store.path}/settings/{d}"))]
    assert [k for k in kept if k.endswith(".json")] == ["v00000003.json", "v00000004.json"] and len(left) == 2


def test_a_change_set_is_written_once(spark, store):
    """Changes of a bucket are dealt over files as its rows are many, and a row that nothing changes is not moved by a shuffle of its own."""
    t = store.tables["report_invoices"]
    first = spark.range(1_500_000).selectExpr("id AS report_id", "7L AS invoice_id", "0 AS position")  # one hot value of the bucket column
    t.apply(upserts(first))
    (folder,) = t.files().values()
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) > 1 and t.read().count() == 1_500_000
    t.apply(deletes(first.where("report_id % 2 = 0").select("report_id", "invoice_id")).unionByName(upserts(first.where("report_id = 1").selectExpr("report_id", "invoice_id", "5 AS position")), allowMissingColumns=True))
    assert t.read().count() == 750_000 and t.read().where("position = 5").count() == 1
