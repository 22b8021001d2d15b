"""Every registered query of the engine against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from loam.plans import registry

from .conftest import SF

registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else repr(v)) if isinstance(v, float) else str(v)


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, str(SF))
    rows = df.collect()
    if name in registry.ORACLE_SQL:
        want = db.sql(registry.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert as_rows(df.columns, rows) == as_rows(want.columns, want.fetchall())
    else:
        assert rows
