"""Every query with SQL against DuckDB on the smallest tables; every query without runs."""

import math

import duckdb
import pytest

from riskgraph.plans import catalogue

TABLES = "customer orders events part conversations documents labels".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, small, name):
    df = catalogue.queries()[name](spark, small)
    got = rows(df.columns, df.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, cur.fetchall())
