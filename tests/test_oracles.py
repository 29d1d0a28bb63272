"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quillspark.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NA or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value.item() if hasattr(value, "item") else value


def rows(frame):
    return sorted(repr(tuple(map(plain, r))) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert rows(got[columns]) == rows(want[columns])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
