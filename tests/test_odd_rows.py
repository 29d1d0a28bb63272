"""Registered queries equal their SQL on rows that the given tables hardly have."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillspark.plans import ORACLE_SQL, QUERIES


def compare(spark, folder, name, table, rows):
    path = f"{folder}/{table}.parquet"
    pq.write_table(rows, path)
    got = [tuple(r) for r in QUERIES[name](spark, str(folder)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    want = con.execute(ORACLE_SQL[name]).fetchall()
    key = lambda r: [(x is None, x) for x in r]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_age_hours(spark, tmp_path, zone):
    ts = [datetime.datetime(*t) for t in ((2024, 7, 1, 12), (2024, 3, 10, 2, 30), (2024, 1, 10), (2024, 1, 9, 23, 59, 59, 999999), (1969, 12, 31, 23, 0, 0, 1), (1969, 12, 31, 22, 59, 59, 999500))]
    rows = pa.table({"event_id": pa.array([1, 2, 3, 4, 6, 7, 5, 8, None], pa.int64()), "ts": pa.array([*ts, ts[0], None, ts[0]], pa.timestamp("us"))})
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        compare(spark, tmp_path, "d_age_hours", "events", rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("stored", [None, "UTC"])
def test_age_hours_rounds_and_knows_zones(spark, tmp_path, stored):
    """A time within half a millisecond of a full hour, on both sides of 1970, the infinite times, and times that are instants."""
    now, hour = 1704844800 * 10**6, 3600 * 10**6
    near = [at + off for at in (now - 5 * hour, now + 7 * hour, 0, -3 * hour) for off in (-1500, -501, -500, -499, -1, 0, 1, 499, 500, 501, 999, 1500)]
    ends = [2**63 - 1, 1 - 2**63, 2**62]
    rows = pa.table({"event_id": pa.array([5 * i + 1 for i in range(len(near + ends))], pa.int64()), "ts": pa.array(near + ends, pa.int64()).cast(pa.timestamp("us", tz=stored))})
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        compare(spark, tmp_path, "d_age_hours", "events", rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_prune_links_of_empty_titles(spark, tmp_path):
    text = ["Alpha beta. More.", "", "!!! ???", "Gamma delta", "  --  ", "Zeta", "Eta theta", "Iota", "Kappa"]
    n = len(text)
    rows = pa.table({"doc_id": list(range(n)), "text": text, "lang": ["en"] * n, "source": ["s"] * n, "n_chars": list(map(len, text))})
    compare(spark, tmp_path, "x_prune_links", "documents", rows)


def test_jaccard_pairs_of_equal_texts(spark, tmp_path):
    text = ["Alpha beta gamma delta. More."] * 3 + ["Alpha beta gamma delta epsilon.", "Other words here", ""]
    ids = [1, 2, 3, 104, 5, 6]  # numbers below 100 are no tokens
    n = len(text)
    rows = pa.table({"doc_id": ids, "text": text, "lang": ["en"] * n, "source": ["s"] * n, "n_chars": list(map(len, text))})
    compare(spark, tmp_path, "g_jaccard_pairs", "documents", rows)
