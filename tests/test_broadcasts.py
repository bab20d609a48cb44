"""A side goes to every task, through the driver, only behind a count: Spark's guess from the size of files is never asked."""

import re

import pytest
import test_counts_search_versions as counted
from helpers import invoice

from tallyworks import schema
from tallyworks.api import Workspace
from tallyworks.operators import store


@pytest.fixture
def sent(spark, monkeypatch):
    """sent(): left and right key of the joins by broadcast since the test began, whose sides all count as too large."""
    monkeypatch.setattr(store, "BROADCAST", 0)

    def plans():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        runs = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {runs.apply(k).executionId(): runs.apply(k).physicalPlanDescription() for k in range(runs.size())}

    last = max(plans(), default=-1)
    pair = re.compile(r"BroadcastHashJoin[^\n]*\nLeft keys \[\d+\]: \[(\w+).*\nRight keys \[\d+\]: \[(?:cast\()?(\w+)")
    return lambda: {keys for k, plan in plans().items() if k > last for keys in pair.findall(plan)}


def test_saves_send_no_keys_through_the_driver(spark, tmp_path, sent):
    ws = Workspace(spark, str(tmp_path / "ws"))
    df = spark.createDataFrame([invoice(None, file_hash=f"h{k % 6}", source_path=f"p{k}", total=k) for k in range(9)], schema.INVOICE)
    saved = lambda rows: {r["file_hash"]: (r["id"], r["inserted"]) for r in ws.ledger.save(rows).collect()}
    assert saved(df.where("file_hash < 'h3'")) == {"h0": (1, True), "h1": (2, True), "h2": (3, True)}
    assert saved(df) == {"h0": (1, False), "h1": (2, False), "h2": (3, False), "h3": (4, True), "h4": (5, True), "h5": (6, True)}
    ws.ledger.update(ws.ledger.get(2), True)
    ws.ledger.delete(3)
    own = {r["id"]: (r["file_hash"], r["source_path"], r["reviewed"]) for r in ws.ledger.rows().collect()}
    assert own == {1: ("h0", "p0", False), 2: ("h1", "p1", True), 4: ("h3", "p3", False), 5: ("h4", "p4", False), 6: ("h5", "p5", False)}
    assert saved(df.where("file_hash = 'h2'")) == {"h2": (7, True)}
    assert sent() == {("_p", "_p")}  # the first ids of partitions, a row for each of these


def test_counts_send_no_keys_through_the_driver(spark, tmp_path, sent):
    counted.test_counts_follow_random_changes(spark, tmp_path)
    assert sent() == {("invoice_id", "id")}  # the list that the test compares with
