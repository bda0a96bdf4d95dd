"""Every query with SQL against DuckDB on the same tables, as the driver compares them."""

import os

import duckdb
import pytest

from granary.plans import catalogue

SF = os.environ.get("TEST_DATA", "/root/testdata") + "/sf0.01"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(map(repr, ([r[c] for c in columns] for r in got.collect())))
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert sorted(map(repr, map(list, want.project(", ".join(f'"{c}"' for c in columns)).fetchall()))) == rows
    assert rows
