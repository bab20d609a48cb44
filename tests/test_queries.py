"""Every query runs; where there is SQL, it gives the same rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from tallyworks.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def rows(table):
    names = sorted(table.column_names)
    show = lambda x: repr(round(x, 9)) if isinstance(x, float) else str(x)
    return names, sorted(tuple(map(show, r)) for r in zip(*[table.column(n).to_pylist() for n in names], strict=True))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = rows(plans.QUERIES[name](spark, SF).toArrow())
    assert got[0] and len(got[0]) == len(set(got[0]))
    if name in plans.ORACLES:
        assert got == rows(duck.sql(plans.ORACLES[name]).to_arrow_table())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_filters_reach_the_scan(spark):
    plan = plans.QUERIES["list_filtered"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "Cartesian" not in plan
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "o_totalprice" in plan and len(read) < 400


def test_order_of_lists(spark):
    listed = [(r["issued_on_s"], r["id"]) for r in plans.QUERIES["needs_review"](spark, SF).collect()]
    assert listed == sorted(listed, reverse=True)
    totals = [r["total_cents"] for r in plans.QUERIES["totals_by_category"](spark, SF).collect()]
    assert totals == sorted(totals, reverse=True)
