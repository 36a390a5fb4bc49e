"""Every registered graph and search query against DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from inkweave.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (not isinstance(v, (list, str)) and pd.isna(v)):
        return None
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return round(float(v), 6)
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(map(plain, r))) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, DIR).toPandas()) == rows(duck.execute(catalogue.SQL[name]).df())
