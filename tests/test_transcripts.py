"""Transcript events: partial then full capture, bad lines, missing files, replays."""

import json

from pyspark.sql import functions as F

from quillspark.streaming import transcripts as X


def say(path, *turns, extra=()):
    lines = [json.dumps({"type": role, "timestamp": "2024-05-01T10:00:00Z", "cwd": "/home/me/atlas", "message": {"content": text}}) for role, text in turns]
    path.write_text("\n".join([*lines, *extra]) + "\n")


def test_partial_then_full_capture_and_replay(spark, tmp_path):
    events, store, one, two = tmp_path / "events", str(tmp_path / "store"), tmp_path / "abc-1.jsonl", tmp_path / "abc-2.jsonl"
    run = lambda: X.transcript_stream(spark.readStream.schema(X.EVENT).option("maxFilesPerTrigger", 1).json(str(events)), store, str(tmp_path / "checkpoint"))
    arrive = lambda rows: spark.createDataFrame(rows, X.EVENT).coalesce(1).write.mode("append").json(str(events))
    state = lambda: {r["sid"]: (r["partial"], r["text"].count("## ")) for r in X.captures(spark, store).collect()}
    say(one, ("user", "first question"), ("assistant", "first answer"), extra=["{cut off", "", "[1, 2]"])
    arrive([("abc-1", str(one), True, 1), ("gone", str(tmp_path / "gone.jsonl"), True, 2), ("none", None, True, 3)])
    run()
    assert state() == {"abc-1": (True, 2)}
    assert sorted(r["value"] for r in X.bad_lines(spark, store).collect()) == ["[1, 2]", "{cut off"]
    assert [r["path"] for r in X.missing(spark, store).collect()] == [str(tmp_path / "gone.jsonl")]
    # it goes on and is captured partly again, then whole; a second session comes whole at once
    say(one, ("user", "first question"), ("assistant", "first answer"), ("user", "second question"))
    arrive([("abc-1", str(one), True, 4)])
    run()
    assert state() == {"abc-1": (True, 3)}
    say(one, ("user", "first question"), ("assistant", "first answer"), ("user", "second question"), ("assistant", "second answer"))
    say(two, ("user", "another, mail me at joe@example.org"))
    arrive([("abc-1", str(one), False, 5), ("abc-1", str(one), True, 5), ("abc-2", "file://" + str(two), None, 6)])
    run()
    assert state() == {"abc-1": (False, 4), "abc-2": (False, 1)}
    text = X.captures(spark, store).filter("sid = 'abc-2'").first()["text"]
    assert "joe@example.org" not in text
    # the same events again, as a replay of their epoch and as new ones
    before = X._epochs(spark, f"{store}/captures", X.CAPTURE).count()
    batch = spark.createDataFrame([("abc-1", str(one), False, 5), ("abc-2", str(two), False, 6)], X.EVENT)
    assert X.transcript_batch(store, batch, 2) == 2 and X.transcript_batch(store, batch, 9) == 0
    assert X._epochs(spark, f"{store}/captures", X.CAPTURE).count() == before and state() == {"abc-1": (False, 4), "abc-2": (False, 1)}
    run()  # nothing new
    assert state() == {"abc-1": (False, 4), "abc-2": (False, 1)}


def test_compactions_are_the_partial_events(spark):
    rows = [("a", "/x", True, 1), ("b", "/y", False, 2), ("c", "/z", None, 3)]
    got = X.compactions(spark.createDataFrame(rows, X.EVENT)).collect()
    assert [(r["session"], r["event_id"], r["kind"]) for r in got] == [("a", 1, "compact")]


def test_nothing_there(spark, tmp_path):
    store = str(tmp_path / "store")
    assert X.captures(spark, store).count() == 0 and X.bad_lines(spark, store).count() == 0 and X.missing(spark, store).count() == 0
    assert X.transcript_batch(store, spark.createDataFrame([("a", "nosuch://host/x", True, 1)], X.EVENT), 0) == 0
    assert X.missing(spark, store).select(F.first("path")).first()[0] == "nosuch://host/x"
