"""Leases and commits: one owner, takeover, stalled writers, lost leases, older layouts, resumed runs."""

import time

import pytest
from pyspark.sql import functions as F

from quillspark.commits import Conflict, Fenced, Files, Lease, Table
from quillspark.config import Limits
from quillspark.store import Store

NOTE = "source string, id string, title string, date string, cwd string, text string"


def values(df):
    return sorted(r[0] for r in df.collect())


def test_stalled_writer_loses_its_lease_and_no_version(spark, tmp_path):
    table, files, folder = Table(spark, str(tmp_path / "t"), "v long"), Files(spark), str(tmp_path / "lock")
    table.commit(spark.range(1).select(F.col("id").alias("v")), 0)
    slow = Lease.acquire(files, folder, 0.4)  # it stalls: nobody renews its lease
    base = table.head()
    assert slow.token == 1 and Lease.acquire(files, folder, 0.4) is None
    time.sleep(0.5)
    quick = Lease.acquire(files, folder, 60)
    assert quick.token == 2 and Lease.acquire(files, folder, 60) is None
    with pytest.raises(Fenced):
        table.commit(spark.range(100, 101).select(F.col("id").alias("v")), base, slow)
    table.commit(table.read().unionAll(spark.range(5, 6)), base, quick)
    with pytest.raises(Conflict):  # even one that looked at its lease before the takeover
        table.commit(spark.range(100, 101).select(F.col("id").alias("v")), base)
    assert values(table.read()) == [0, 5] and table.head() == 2
    assert len([n for n in files.names(table.path) if n.startswith("data-")]) == 2  # failed attempts leave nothing


def test_work_longer_than_the_lease_keeps_it(spark, tmp_path):
    files, folder = Files(spark), str(tmp_path / "lock")
    with Lease.acquire(files, folder, 0.6).working() as lease:
        time.sleep(1.5)
        assert Lease.acquire(files, folder, 0.6) is None and lease.held()
    with Lease.acquire(files, folder, 60).working() as after:
        assert after.token == 2
    assert Lease.acquire(files, folder, 60).token == 3


def test_contenders_for_a_lease_that_ran_out(spark, tmp_path):
    files, folder = Files(spark), str(tmp_path / "lock")
    Lease.acquire(files, folder, -1)
    real, won = files.names, []
    names = real(folder)
    files.names = lambda path: names  # both looked at the same time
    won = [Lease.acquire(files, folder, 60) for _ in range(2)]
    assert [x is not None for x in won] == [True, False]


def test_readers_keep_their_version(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), "v long")
    assert table.read().count() == 0
    for i in range(4):
        before = table.read()
        table.commit(spark.range(i, i + 1).select(F.col("id").alias("v")), i)
        assert values(before) == ([i - 1] if i else [])
    assert sorted(table.versions()) == [3, 4]


def test_store_takes_over_an_older_layout(spark, tmp_path):
    old = spark.createDataFrame([("n1", "h1")], "name string, hash string")
    old.limit(0).write.parquet(str(tmp_path / "synthed/v1"))
    old.write.parquet(str(tmp_path / "synthed/v2"))
    store = Store(spark, str(tmp_path))
    assert "synthed" not in store.init() and store.init() == []
    assert values(store.read("synthed")) == ["n1"] and store.version("synthed") == 1


def note(i, cwd="/home/me/atlas"):
    return ("claude", f"id{i}", f"title {i}", "2024-05-01", cwd, f"## user\n\nThe gateway number {i} times out after {i} seconds and needs a retry policy.")


def test_reflect_outcomes_failing_step_and_resumption(spark, tmp_path):
    calls = {"embed": 0}

    def broken(texts):
        calls["embed"] += 1
        raise RuntimeError("no embedder")

    store = Store(spark, str(tmp_path), Limits(tidy_min_pages=100), embedder=broken)
    store.ingest(spark.createDataFrame([note(i) for i in range(3)], NOTE))
    got = store.reflect()
    assert got["synth"] == "3 notes" and got["workspace"] == "1 workspaces" and got["tidy"] == "not due" and got["embed"].startswith("failed: ")
    assert store.read("pages").count() == 3 and values(store.read("workspace").select("workspace")) != []
    assert store.state("reflect")["ended"]
    with store.lock("reflect") as free:  # the claim is free again
        assert free
        assert store.reflect() == {}
    # a run that was cut off after two steps goes on with the others
    store = Store(spark, str(tmp_path), Limits(tidy_min_pages=100))
    store.set_state("reflect", {"steps": {"synth": "7 notes", "workspace": "7 workspaces"}, "ended": False})
    got = store.reflect()
    assert got["synth"] == "7 notes" and got["workspace"] == "7 workspaces" and got["embed"] == "3 vectors"
    # nothing new: no workspace is distilled again
    again = store.reflect()
    assert again["synth"] == "0 notes" and again["workspace"] == "0 workspaces"


def test_tidying_is_claimed_and_released(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), Limits(tidy_min_pages=1))
    store.ingest(spark.createDataFrame([note(1)], NOTE))
    store.synth()
    monkeypatch.setattr(store, "tidy", lambda: (_ for _ in ()).throw(RuntimeError("model down")))
    with pytest.raises(RuntimeError):
        store._auto_tidy()
    assert store.state("last-tidy") == {}
    monkeypatch.undo()
    assert store._auto_tidy().endswith("clusters") and store._auto_tidy() == "not due"


def test_changed_parts_only(spark, tmp_path):
    table, files = Table(spark, str(tmp_path / "t"), "v long, s string"), Files(spark)
    rows = {i: ["a", "b", None][i % 3] for i in range(9)}
    whole = lambda: spark.createDataFrame(list(rows.items()), "v long, s string")
    names = lambda s: spark.createDataFrame([(x,) for x in s], "s string")
    state = lambda: sorted((r["v"], r["s"]) for r in table.read().collect()) if True else None
    key = lambda x: (x[0], x[1] or "")
    table.commit_parts(whole(), F.col("s"), names(["a", "b", None]), 0)
    first = table._parts(1)
    assert len(first) == 3
    rows[3] = "b"  # from a to b; the part of null stays
    table.commit_parts(whole(), F.col("s"), names(["a", "b"]), 1)
    second = table._parts(2)
    assert sum(first[k] == second[k] for k in first) == 1 and sorted(((r["v"], r["s"]) for r in table.read().collect()), key=key) == sorted(rows.items(), key=key)
    for i in [i for i, s in rows.items() if s == "b"]:
        del rows[i]
    for step in (2, 3, 4):  # a part that is empty goes; the untouched part outlives the sweep of old versions
        table.commit_parts(whole(), F.col("s"), names(["b"]), step)
    assert sorted(((r["v"], r["s"]) for r in table.read().collect()), key=key) == sorted(rows.items(), key=key) and len(table._parts(5)) == 2
    with pytest.raises(Conflict):
        table.commit_parts(whole(), F.col("s"), names(["a"]), 3)
    assert sorted(((r["v"], r["s"]) for r in table.read().collect()), key=key) == sorted(rows.items(), key=key)


def test_embedding_rewrites_changed_sections(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    page = lambda i, section, body="body": (i, f"s{i}", f"t{i}", section, "note", "current", [], [], None, "", body)
    put = lambda rows: store.replace("pages", spark.createDataFrame(rows, "ord long, slug string, title string, section string, kind string, status string, tags array<string>, sources array<string>, project string, summary string, body string"))
    put([page(i, "topics" if i % 2 else "entities") for i in range(6)])
    assert store.embed().count() == 6
    before = store.table("vectors")._parts(1)
    assert store.embed().count() == 6 and store.version("vectors") == 1  # nothing changed, no version
    put([page(i, "topics" if i % 2 else "entities", "new" if i == 1 else "body") for i in range(6) if i != 3])
    assert store.embed().count() == 5
    after = store.table("vectors")._parts(2)
    assert len(after) == 2 and sum(before[k] == after[k] for k in before) == 1
