import os

import duckdb
import pytest

from netquarry.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("the supplied tables are absent")
    df = queries.queries()[name](spark, FOLDER)
    con = duckdb.connect()
    for table in ("documents", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
