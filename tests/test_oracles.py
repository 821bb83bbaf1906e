"""Every query of the library that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from inkvane.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    columns = sorted(frame.columns)
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, data, duck, name):
    want_columns, want = rows(duck.execute(ORACLE_SQL[name]).df())
    got_columns, got = rows(QUERIES[name](spark, data).toPandas())
    assert got_columns == want_columns
    assert got == want


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
