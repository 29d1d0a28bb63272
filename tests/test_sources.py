"""Readers of the three session dialects on written files, and the streaming sinks."""

import json
import sqlite3

from pyspark.sql import functions as F

from quillspark.sources import sessions as R
from quillspark.streaming import sessions as ST


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")


def test_log_sessions(spark, tmp_path):
    lines(
        tmp_path / "s1.jsonl",
        {"type": "user", "cwd": "/w/a", "timestamp": "2024-01-02T00:00:00Z", "message": {"content": "olá\nmundo"}},
        "{bad",
        "",
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "hi"}, {"type": "thinking", "text": "no"}, {"type": "tool_use", "name": "Bash", "input": {"command": "ls -la\nrm"}}]}},
        {"type": "ai-title", "aiTitle": "Named"},
    )
    lines(tmp_path / "empty.jsonl", {"type": "system", "message": {"content": "x"}})
    got = R.read_log_sessions(spark, str(tmp_path)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["id"], r["title"], r["cwd"], r["date"]) == ("s1", "Named", "/w/a", "2024-01-02T00:00:00Z")
    assert r["text"] == "## user\n\nolá\nmundo\n\n## assistant\n\nhi\n\n_ran: ls -la_"


def test_rollout_sessions(spark, tmp_path):
    lines(
        tmp_path / "r1.jsonl",
        {"type": "session_meta", "payload": {"id": "x1", "cwd": "/w/b", "timestamp": "1704067200"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"text": "fallback"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"text": "<env>skip"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": json.dumps({"command": ["bash", "-lc", "pwd"]})}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"text": "done"}]}},
    )
    titles = spark.createDataFrame([("x1", "Titled", "2024")], "id string, title string, updated string")
    r = R.read_rollout_sessions(spark, str(tmp_path), titles).first()
    assert (r["id"], r["title"], r["date"]) == ("x1", "Titled", "2024-01-01T00:00:00Z")
    assert r["text"] == "## user\n\nfallback\n\n## assistant\n\n_ran: pwd_\n\n## assistant\n\ndone"


def test_thread_sessions(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "kv.db")
    con.execute("CREATE TABLE cursorDiskKV (key TEXT, value TEXT)")
    rows = {
        "composerData:c1": {"name": "Thread", "createdAt": 1704067200000},
        "bubbleId:c1:b": {"type": 2, "text": "", "createdAt": 1704067300000, "assistantSuggestedDiffs": [{"uri": "/a/f.py"}, {"uri": "/a/f.py"}]},
        "bubbleId:c1:a": {"type": 1, "text": "question", "createdAt": "2024-01-01T00:00:00Z"},
        "other:x": {"type": 1},
    }
    con.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [(k, json.dumps(v)) for k, v in rows.items()] + [("bubbleId:c1:z", "{bad")])
    con.commit()
    con.close()
    r = R.read_thread_sessions(spark, str(tmp_path / "kv.db")).collect()
    assert len(r) == 1 and r[0]["title"] == "Thread" and r[0]["date"] == "2024-01-01T00:00:00Z"
    assert r[0]["text"] == "## user\n\nquestion\n\n## assistant\n\n_edited: f.py_"


def test_union_ignores_unknown_backends(spark, tmp_path):
    lines(tmp_path / "s.jsonl", {"type": "user", "cwd": "/w/a/x", "timestamp": "2024-01-02", "message": {"content": "q"}})
    stores = {"claude": str(tmp_path), "nope": "/none"}
    assert R.union_sessions(spark, stores).count() == 1
    assert R.union_sessions(spark, stores, workspace="/w/a", since="2024-01-01").count() == 1
    assert R.union_sessions(spark, stores, since="2024-02-01").count() == 0
    assert R.union_sessions(spark, {}).count() == 0


def test_unknown_dates_are_kept(spark):
    s = spark.createDataFrame([("soon",), (None,), ("2023-01-01",)], "date string")
    assert R.filter_sessions(s, since="2024-01-01").count() == 2


def test_capture_stream_supersedes(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")
    rows = [("s1", "2024-01-01", "part", True), ("s1", "2024-01-02", "full a@b.co", False), ("s2", "2024-01-01", "only", True)]
    spark.createDataFrame(rows, "sid string, date string, text string, partial boolean").write.parquet(str(src))
    stream = lambda: spark.readStream.schema("sid string, date string, text string, partial boolean").parquet(str(src))
    ST.capture_stream(stream(), store, str(tmp_path / "cp1"))
    ST.capture_stream(stream(), store, str(tmp_path / "cp2"))  # a replay adds nothing
    assert spark.read.parquet(store).count() == 3
    got = {r["sid"]: r["text"] for r in ST.captures(spark, store).collect()}
    assert got == {"s1": "full <email>", "s2": "only"}


def test_inject_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("u1", "p1", 3), ("u1", "p1", 1), ("u1", "p2", 2), ("u2", "p1", 4)]
    spark.createDataFrame(rows, "session string, page string, event_id long").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("session string, page string, event_id long").parquet(str(tmp_path / "e"))
    ST.inject_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("u1", "p1", 1), ("u1", "p2", 2), ("u2", "p1", 4)}


def test_condense_tool(spark):
    df = spark.createDataFrame([("Edit", {"file_path": "/a/b.py"}), ("TodoWrite", {}), ("mcp__x__find", {"query": "q  r"}), ("Bash", {})], "n string, a map<string,string>")
    got = [r["x"] for r in df.select(R.condense_tool(F.col("n"), F.col("a")).alias("x")).collect()]
    assert got == ["_edited: b.py_", "_updated todo list_", "_tool: find — q r_", "_ran a command_"]
