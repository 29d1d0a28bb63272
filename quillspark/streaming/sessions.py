"""Structured Streaming: injection once a session, captures into a ledgered store, cadence by state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.functions.scrub import scrub

#: Days after which a session's memory of what it was shown expires.
TTL_DAYS = 7

INJECTED = T.StructType([T.StructField("session", T.StringType()), T.StructField("page", T.StringType()), T.StructField("event_id", T.LongType())])


class InjectOnce(StatefulProcessor):
    """Emits a session's first event for each page; state per session expires after the TTL."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        page = T.StructType([T.StructField("page", T.StringType())])
        seen = T.StructType([T.StructField("event_id", T.LongType())])
        self.seen = handle.getMapState("seen", page, seen, TTL_DAYS * 86_400_000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, int] = {}
        for pdf in rows:
            for page, event in zip(pdf["page"], pdf["event_id"]):
                if not self.seen.containsKey((page,)):
                    new[page] = min(int(event), new.get(page, int(event)))
        for page, event in new.items():
            self.seen.updateValue((page,), (event,))
        yield pd.DataFrame({"session": [key[0]] * len(new), "page": list(new), "event_id": list(new.values())})

    def close(self) -> None:
        pass


def inject_once(events: DataFrame) -> DataFrame:
    """Stream of events(session, page, event_id) → the first of each page in each session."""
    return events.groupBy("session").transformWithStateInPandas(statefulProcessor=InjectOnce(), outputStructType=INJECTED, outputMode="Append", timeMode="ProcessingTime")


def inject_stream(events: DataFrame, store: str, checkpoint: str):
    """Run a stream of events through ``inject_once`` into the store until its input is used up.

    State with processing time asks for one more batch after every batch, so a query that ends with its input must not
    run batches without data; expired state goes with the next batch that has some.  A query keeps the setting that
    it started with, so the session gets its own back.
    """
    conf, name = events.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        query = inject_once(events).writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)
    while not query.awaitTermination(10):
        pass
    return query


def capture_batch(store: str, batch: DataFrame) -> None:
    """Append the captures(sid, date, text, partial) of a micro-batch whose content the store lacks.

    The store is an append-only log; ``captures`` reads its current state.  Content keys make a replayed batch
    a no-op, so the sink is idempotent.
    """
    spark = batch.sparkSession
    keyed = batch.select("sid", "date", "partial", scrub(F.col("text")).alias("text"), F.concat_ws(":", "sid", F.col("partial").cast("string"), F.substring(F.sha2("text", 256), 1, 12)).alias("key")).dropDuplicates(["key"])
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        keyed = keyed.join(spark.read.schema(keyed.schema).parquet(store).select("key"), "key", "left_anti")
    keyed.write.mode("append").parquet(store)


def captures(spark: SparkSession, store: str) -> DataFrame:
    """One row per session: its full capture if there is one, else the latest partial one."""
    from quillspark.operators.incremental import latest

    return latest(spark.read.parquet(store), ["sid"], [F.col("partial").asc(), F.desc("date"), F.desc("key")])


def capture_stream(events: DataFrame, store: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None):
    """Run a stream of captures into the store until its input is used up; ``after`` sees every batch."""

    def step(batch: DataFrame, epoch: int) -> None:
        capture_batch(store, batch)
        if after:
            after(batch, epoch)

    query = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while not query.awaitTermination(10):
        pass
    return query
