"""Transcripts as a stream of hook events: each names a file, which is folded and captured.

An event (session, path, partial) says that a transcript was written: ``partial`` while its session goes on (its
conversation is about to be compacted), else at its end.  A micro-batch reads the files that its events name, folds
them into sessions and adds those whose content is new; a session's full capture takes the place of its partial ones.
Lines that are no JSON object and files that are not there go to side tables and never stop the stream.

What a micro-batch writes lies in a folder of its epoch that a replay overwrites, so a replay changes nothing.

``compactions`` turns the partial events into rows for ``recall``: one stateful operator takes prompts and compactions, and
a compaction clears what its session was shown, since the conversation no longer holds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.durable import materialize
from quillspark.functions.scrub import scrub
from quillspark.operators.incremental import latest
from quillspark.sources.sessions import jsonl_lines, read_log_sessions, tolerant

EVENT = "session string, path string, partial boolean, event_id long"
CAPTURE = "key string, sid string, title string, date string, cwd string, text string, partial boolean"
BAD = "file string, line long, value string"
MISSING = "path string, partial boolean"


def present(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Full name of each path that is there; a path that cannot be looked at counts as missing."""
    found = {}
    for path in paths:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
            if fs.exists(p):
                found[path] = fs.getFileStatus(p).getPath().toString()
        except Exception:  # noqa: BLE001  a probe never raises
            continue
    return found


def _epochs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], f"{schema}, epoch long")
    return spark.read.schema(f"{schema}, epoch long").parquet(path)


def _put(df: DataFrame, path: str, epoch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def transcript_batch(store: str, batch: DataFrame, epoch: int) -> int:
    """Capture the files that events(session, path, partial) name; returns the number of new captures."""
    spark = batch.sparkSession
    # a file named more than once: its full capture counts; a micro-batch has a bounded number of events
    named = batch.filter(F.col("path").isNotNull()).groupBy("path").agg(F.min(F.coalesce("partial", F.lit(False))).alias("partial")).collect()
    there = present(spark, [r["path"] for r in named])
    _put(spark.createDataFrame([(r["path"], r["partial"]) for r in named if r["path"] not in there], MISSING), f"{store}/missing", epoch)
    if not there:
        return 0
    files = sorted(set(there.values()))
    lines = jsonl_lines(spark, files)
    bad = lines.filter(F.trim("value") != "").join(tolerant(lines, "value").select("file", "line"), ["file", "line"], "left_anti")
    _put(bad.select("file", "line", "value"), f"{store}/bad_lines", epoch)
    states = spark.createDataFrame([(there[r["path"]].rsplit("/", 1)[-1].rsplit(".", 1)[0], r["partial"]) for r in named if r["path"] in there], "sid string, partial boolean").groupBy("sid").agg(F.min("partial").alias("partial"))
    folded = read_log_sessions(spark, files).withColumnRenamed("id", "sid").join(F.broadcast(states), "sid")
    key = F.concat_ws(":", "sid", F.col("partial").cast("string"), F.substring(F.sha2("text", 256), 1, 12))
    fresh = folded.select(key.alias("key"), "sid", "title", "date", "cwd", scrub(F.col("text")).alias("text"), "partial").dropDuplicates(["key"])
    before = _epochs(spark, f"{store}/captures", CAPTURE).filter(F.col("epoch") != epoch).select("key")
    fresh = materialize(fresh.join(before, "key", "left_anti"), "captures")
    _put(fresh, f"{store}/captures", epoch)
    return fresh.count()


def captures(spark: SparkSession, store: str) -> DataFrame:
    """One row per session: its last full capture, else its last partial one."""
    return latest(_epochs(spark, f"{store}/captures", CAPTURE), ["sid"], [F.col("partial").asc(), F.desc("epoch"), F.desc("key")])


def bad_lines(spark: SparkSession, store: str) -> DataFrame:
    return _epochs(spark, f"{store}/bad_lines", BAD)


def missing(spark: SparkSession, store: str) -> DataFrame:
    return _epochs(spark, f"{store}/missing", MISSING)


def transcript_stream(events: DataFrame, store: str, checkpoint: str):
    """Run a stream of events into the store until its input is used up."""
    query = events.writeStream.foreachBatch(lambda batch, epoch: transcript_batch(store, batch, epoch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while not query.awaitTermination(10):
        pass
    return query


def compactions(events: DataFrame) -> DataFrame:
    """Events as rows of ``recall``'s input: the partial ones clear their session's memory of pages shown."""
    return events.filter("partial").select("session", "event_id", F.lit(None).cast("string").alias("cwd"), F.lit(None).cast("string").alias("text"), F.lit("compact").alias("kind"))
