"""Every query of the catalogue against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from parley.plans.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{DATA}/{f}'")
    return c


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]
    plain = lambda v: repr(list(v)) if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not hasattr(v, "isoformat") and getattr(v, "ndim", 0) else "null" if pd.isna(v) else str(v)
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
