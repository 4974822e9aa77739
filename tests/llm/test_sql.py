"""The queries that have SQL against DuckDB, on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from pairloom.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    order = sorted(names)
    want = sorted(tuple(str(r[names.index(n)]).lower() for n in order) for r in cur.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == order
    assert sorted(tuple(str(r[n]).lower() for n in order) for r in df.collect()) == want
