"""Queries with SQL twins against DuckDB."""

import duckdb
import pytest

from check import TABLES, norm
from tallyvane.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def against_sql(spark, name, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.execute(ORACLES[name])
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    rows = got.collect()
    a = sorted(tuple(norm(r[c]) for c in cols) for r in rows)
    b = sorted(tuple(map(norm, r)) for r in want)
    assert rows and a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]
    return rows


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op2_divergence"}))
def test_query_equals_sql(spark, name):
    against_sql(spark, name)
