"""Streaming recall: equal to its batch form, restarts, workspace pages that change, sessions without a name."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.config import Limits
from quillspark.operators import inverted as V
from quillspark.streaming import recall as R

PROMPT = "session string, event_id long, cwd string, text string, kind string"
WORDS = [f"{a}{b}rve" for a in "bcdfgklmnp" for b in "aeiu"]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Pages, their index, and prompts of five sessions in three files."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, rng.sample(WORDS, rng.randint(3, 9))) for i in range(120)], "doc long, tokens array<string>").cache()
    index = V.Index(spark, str(tmp_path_factory.mktemp("index")), buckets=2)
    index.update(docs)
    rows = [(None if i % 11 == 10 else f"s{rng.randrange(5)}", i, "/home/me/atlas", " ".join(rng.sample(WORDS, rng.randint(3, 7))), "prompt") for i in range(30)]
    rows[3] = ("s1", 3, None, "barve birve", None)
    rows[14] = ("s2", 14, None, None, "compact")  # forgets what s2 was shown
    return docs, R.weighed_postings(index.live_postings(), index.frequencies(), index.size()).cache(), rows


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, PROMPT).coalesce(1).write.mode("append").json(folder)


def shown(df, kind="page"):
    return sorted((r["session"] or "", r["event_id"], r["rank"], r["doc"], r["score"]) for r in df.filter(F.col("kind") == kind).collect())


def spaces(spark, updated):
    return spark.createDataFrame([("atlas", updated, "where it stands")] if updated else [], "workspace string, updated timestamp, body string")


def test_stream_equals_batch_and_restarts(spark, tmp_path, parts):
    docs, postings, rows = parts
    at = {k: str(tmp_path / k) for k in ("in", "out", "checkpoint")}
    now = datetime.now().replace(microsecond=0)
    times = [now - timedelta(days=3), now - timedelta(days=2), now - timedelta(days=2)]
    for step, updated in enumerate(times):  # a run for each file: the second and third start from the checkpoint
        arrive(spark, at["in"], rows[step * 10 : step * 10 + 10])
        prompts = spark.readStream.schema(PROMPT).json(at["in"])
        R.recall_stream(prompts, postings, R.fresh_workspaces(spaces(spark, updated), Limits()), at["out"], at["checkpoint"])
    out = spark.read.parquet(at["out"])
    batch = R.recall_sessions(spark.createDataFrame(rows, PROMPT), docs)
    want = sorted((r["session"] or "", r["event_id"], r["rank"], r["doc"], r["score"]) for r in batch.collect())
    assert shown(out) == want and len(want) > 30
    named = [(s, s == "s2" and e > 14, d) for s, e, _, d, _ in want if s]
    assert len(named) == len(set(named))  # no page twice in a session, but after its compaction
    # a workspace page goes out once a session for each of its two times, and to every prompt without a session
    space = out.filter("kind = 'workspace'").select("session", "event_id", "updated").collect()
    by = {}
    for r in space:
        by.setdefault(r["session"], []).append((r["event_id"], r["updated"]))
    for session, got in by.items():
        events = [i for i, row in enumerate(rows) if row[0] == session and row[2]]
        if session is None:
            assert sorted(e for e, _ in got) == events
        else:
            firsts = [next((i for i in events if lo <= i < hi), None) for lo, hi in ((0, 10), (10, 30))]
            assert sorted(e for e, _ in got) == [i for i in firsts if i is not None]
    # a further run without new prompts adds nothing
    R.recall_stream(spark.readStream.schema(PROMPT).json(at["in"]), postings, R.fresh_workspaces(spaces(spark, now), Limits()), at["out"], at["checkpoint"])
    assert spark.read.parquet(at["out"]).count() == out.count()


def test_batch_equals_plain_fold(spark, parts):
    """Without a limit of places a session sees each page at its first hit; with one, greedily by rank."""
    docs, _, rows = parts
    sets = {r["doc"]: set(r["tokens"]) for r in docs.collect()}
    df = {t: sum(t in s for s in sets.values()) for t in WORDS}
    import math

    for most in (2, 10_000):
        seen, want = {}, []
        for session, event, _, text, kind in rows:
            if kind == "compact":
                seen[session] = set()
                continue
            tokens = set(text.split()) if len(text) >= 15 else set()
            hits = []
            for d, s in sets.items():
                n = len(tokens & s)
                if n >= 2 and n / len(tokens | s) >= 0.05:
                    hits.append((-round(sum(math.log(1 + (len(sets) - df[t] + 0.5) / (df[t] + 0.5)) for t in sorted(tokens & s)), 4), d))
            own = seen.setdefault(session, set()) if session else set()
            new = [d for _, d in sorted(hits) if d not in own][:most]
            own.update(new)
            want += [(session or "", event, d) for d in new]
        got = R.recall_sessions(spark.createDataFrame(rows, PROMPT), docs, Limits(retrieve_max_results=most))
        assert sorted((r["session"] or "", r["event_id"], r["doc"]) for r in got.collect()) == sorted(want)


def test_old_and_empty_workspaces_stay_away(spark):
    rows = [("a", datetime.now(), "body"), ("b", datetime.now() - timedelta(days=30), "body"), ("c", datetime.now(), "  "), ("d", None, "body")]
    got = R.fresh_workspaces(spark.createDataFrame(rows, "workspace string, updated timestamp, body string"), Limits())
    assert [r["project"] for r in got.collect()] == ["a"]


def test_rendered_line(spark):
    pages = spark.createDataFrame([(1, "slug-one", "Title", "a\n summary   " + "x" * 300)], "ord long, slug string, title string, summary string")
    line = R.render(spark.createDataFrame([(1,), (2,)], "doc long"), pages).orderBy("doc").collect()
    assert line[0]["line"] == "- [slug-one] Title: " + ("a summary " + "x" * 300)[:220] and line[1]["line"] is None
