import os

import duckdb
import pytest

from tallyworks.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    got, want = registry.queries()[name](spark, SF).toArrow(), c.sql(registry.oracle_sql()[name]).to_arrow_table()
    names = sorted(want.column_names)
    assert sorted(got.column_names) == names
    show = lambda t: sorted(zip(*[t.column(n).to_pylist() for n in names], strict=True))
    assert show(got) == show(want)


def test_names():
    found = [n for n in registry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14)) and "pipeline" in registry.queries()
