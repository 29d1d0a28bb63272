"""Key-value source: pushed filters, ranges of keys, equal rows."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillspark.sources import keyvalue as V


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    rng = random.Random(4)
    rows = [(f"bubbleId:{rng.randrange(30)}:{i}", f'{{"n": {i}}}') for i in range(2500)] + [("composerData:é", b"\xffbytes"), ("Zz", None), (None, "null key"), ("bubble%", "x"), ("bubbleIdX", 7)]
    path = str(tmp_path_factory.mktemp("kv") / "state.vscdb")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE cursorDiskKV (key TEXT UNIQUE, value BLOB)")
    con.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", rows)
    con.commit()
    con.close()
    return path, [(k, v.decode("utf-8", "replace") if isinstance(v, bytes) else None if v is None else str(v)) for k, v in rows]


FILTERS = [
    (F.lit, lambda k: True), (lambda _: F.col("key").startswith("bubbleId:"), lambda k: k is not None and k.startswith("bubbleId:")), (lambda _: F.col("key") == "Zz", lambda k: k == "Zz"),
    (lambda _: F.col("key").isin("Zz", "bubble%", "none"), lambda k: k in ("Zz", "bubble%")), (lambda _: (F.col("key") > "bubbleId:2") & (F.col("key") <= "bubbleIdX"), lambda k: k is not None and "bubbleId:2" < k <= "bubbleIdX"),
    (lambda _: F.col("key").startswith("bubbleId:1") & F.col("value").contains("7"), None), (lambda _: F.col("key").isNull(), lambda k: k is None), (lambda _: F.col("key").startswith("bubble%"), lambda k: k == "bubble%"),
]


@pytest.mark.parametrize("slices, push", [(1, True), (3, True), (3, False)])
@pytest.mark.parametrize("which", range(len(FILTERS)))
def test_equal_rows(spark, base, which, slices, push):
    path, rows = base
    condition, keep = FILTERS[which]
    keep = keep or (lambda k: k is not None and k.startswith("bubbleId:1") and "7" in dict(rows)[k])
    got = V.read_key_values(spark, path, slices=slices, push=push).filter(condition(True)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(r) for r in rows if keep(r[0]))


def test_filter_is_pushed_and_one_file_is_split(spark, base):
    path, rows = base
    df = V.read_key_values(spark, path, slices=2, push=True).filter(F.col("key").startswith("bubbleId:"))
    assert "Filter" not in df._jdf.queryExecution().executedPlan().toString().replace("PushedFilters", "") or "StartsWith(key" not in df._jdf.queryExecution().executedPlan().toString().replace("PushedFilters", "").split("BatchScan")[0]
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 2 and max(sizes) - min(sizes) <= 2 and sum(sizes) == 2500
    reader = V.KeyValueReader({"path": path, "push": "true"})
    assert list(reader.pushFilters([V.D.StringStartsWith(("key",), "bubbleId:1:"), V.D.StringContains(("value",), "7")])) == [V.D.StringContains(("value",), "7")]
    read = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert 0 < read == sum(k is not None and k.startswith("bubbleId:1:") for k, _ in rows) < 200  # other rows never leave the file


def test_one_frame_under_several_filters(spark, base):
    path, rows = base
    kv = V.read_key_values(spark, path)
    both = kv.filter(F.col("key").startswith("bubbleId:1:")).unionByName(kv.filter(F.col("key") == "Zz"))
    want = [r for r in rows if r[0] is not None and (r[0].startswith("bubbleId:1:") or r[0] == "Zz")]
    assert sorted(map(repr, map(tuple, both.collect()))) == sorted(map(repr, want))
    assert kv.count() == len(rows)
