"""Operators 11 to 13 against their SQL on the smallest tables, and on awkward rows."""

import duckdb
import pandas as pd
import pytest

from quillspark import llm
from tests.llm import cases

QUERIES, ORACLE_SQL = llm.queries(), llm.oracle_sql()
NAMES = ["op11_lexical", "op12_lines", "op13_resample"]


def plain(frame):
    columns = sorted(frame.columns)
    return sorted(repr([None if pd.isna(x) else int(x) if isinstance(x, float) else x for x in r]) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """Tables of awkward rows without null doc_ids, for which SQL has no order of its own."""
    at = str(tmp_path_factory.mktemp("awkward"))
    cases.documents(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).write.parquet(f"{at}/documents.parquet")
    items = [(1, "one"), (2, cases.texts()[8]), (3, None), (4, "nowhere-at-all"), (5, "the the onea straße 中文"), (6, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("tables", ["smallest", "awkward"])
def test_equals_sql(spark, sf_dir, awkward, name, tables):
    at, glob = (sf_dir, "") if tables == "smallest" else (awkward, "/*.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet{glob}'")
    assert plain(QUERIES[name](spark, at).toPandas()) == plain(con.execute(ORACLE_SQL[name]).df())


def test_registered():
    assert set(NAMES) <= set(QUERIES) & set(ORACLE_SQL)
