"""The text queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from riskgraph.llm import queries
from tests.test_oracle import rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    df = queries.queries()[name](spark, small)
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())
