"""The corpus queries that have an SQL form, against it on the smallest tables."""

import duckdb
import pytest

from loam.llm import queries

from ..conftest import SF
from ..test_oracles import as_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, str(SF)), con.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert as_rows(df.columns, df.collect()) == as_rows(want.columns, want.fetchall())
