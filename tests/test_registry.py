import os

import duckdb
import pytest

from netquarry.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = ["customer", "events", "lineitem", "orders", "part", "region"]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("the supplied tables are absent")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return value if isinstance(value, (bool, str)) or value is None else str(value) if not hasattr(value, "__int__") else float(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    order = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    assert got or name in ("constants",)
    if name in registry.oracle_sql():
        rel = duck.sql(registry.oracle_sql()[name])
        assert sorted(rel.columns) == order
        at = [rel.columns.index(c) for c in order]
        assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    if os.path.isdir(FOLDER):
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
