"""Recall as a stream: prompts come in, ranked pages that their session has not seen go out.

A prompt's tokens are joined with the index (stream-static) and ranked inside the stateful operator, which keeps two
states for each session: the pages it was shown (a map with TTL) and the time of the workspace page it was shown (a
value).  A workspace page goes out again when its time has changed since.  All rows of a prompt come from one row of
the stream, so they are in one micro-batch.  A query reads the index and the workspaces as they are when it starts;
its state is in its checkpoint, so runs that end with their input follow each other.

``recall_sessions`` gives the same rows for a finished table of prompts: ranked natively, with as many places as a
session can have used up before, and then folded by the same function.

Rows of kind ``compact`` come in the same stream (see ``transcripts.compactions``): the session's conversation was cut down,
so what it was shown before is forgotten and can be shown again.

A null session has no state: each of its prompts is on its own.  Rows of the same session and event are one prompt.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.config import Limits
from quillspark.durable import materialize
from quillspark.functions import text as X
from quillspark.operators import rank as K
from quillspark.operators.inverted import idf
from quillspark.streaming.sessions import TTL_DAYS

OUT = "session string, event_id long, kind string, doc long, score double, rank int, updated timestamp"
_DAY_MS = 86_400_000
#: Settings of a query with two states that ends with its input.
STARTED_WITH = {
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def asked_tokens(text: Column, limits: Limits) -> Column:
    """Tokens of a prompt that is long enough to be answered; none for others."""
    tokens = X.recall_tokens(text)
    enough = (F.length(F.trim(text)) >= limits.retrieve_min_prompt_chars) & (F.size(tokens) >= 2)
    return F.when(F.coalesce(enough, F.lit(False)), tokens).otherwise(F.array().cast("array<string>"))


def weighed_postings(postings: DataFrame, frequencies: DataFrame, n: int) -> DataFrame:
    """(t, doc, size, idf) of postings(t, size, doc) and frequencies(t, df)."""
    return postings.join(frequencies.select("t", idf(F.lit(float(n)), F.col("df")).alias("idf")), "t").select("t", "doc", "size", "idf")


def fresh_workspaces(workspaces: DataFrame, limits: Limits) -> DataFrame:
    """(project, updated) of workspace pages young enough to be shown."""
    oldest = F.current_timestamp() - F.make_interval(days=F.lit(limits.boot_workspace_max_age_days))
    return workspaces.filter((F.length(F.trim("body")) > 0) & (F.col("updated") >= oldest)).select(F.col("workspace").alias("project"), "updated")


def kinds(prompts: DataFrame) -> DataFrame:
    """Prompts with ``compact``: whether a row is a compaction (of a table without kinds none is)."""
    return prompts.withColumn("compact", F.coalesce(F.col("kind") == "compact", F.lit(False)) if "kind" in prompts.columns else F.lit(False))


def lookups(prompts: DataFrame, postings: DataFrame, workspaces: DataFrame, limits: Limits) -> DataFrame:
    """A row for each posting that a prompt's tokens meet, and at least one for each prompt and compaction."""
    asked = kinds(prompts).select("session", "event_id", "compact", asked_tokens(F.col("text"), limits).alias("tokens"), X.normalize_key(F.col("cwd")).alias("project"))
    known = asked.join(workspaces, "project", "left")
    each = known.select("session", "event_id", "compact", "updated", F.size("tokens").alias("asked"), F.explode_outer("tokens").alias("t"))
    return each.join(postings, "t", "left").select("session", "event_id", "compact", "updated", "asked", "t", "doc", "size", "idf")


def rank_hits(hits: pd.DataFrame, limits: Limits) -> pd.DataFrame:
    """(event_id, doc, score) of all prompts' hits that pass the gates, best first."""
    hits = hits.dropna(subset=["doc"]).drop_duplicates(["event_id", "t", "doc"])
    if hits.empty:
        return pd.DataFrame({"event_id": [], "doc": [], "score": []})
    g = hits.groupby(["event_id", "doc"], as_index=False).agg(overlap=("t", "size"), size=("size", "first"), asked=("asked", "first"), score=("idf", "sum"))
    passed = g[(g["overlap"] >= limits.retrieve_min_overlap) & (g["overlap"] / (g["size"] + g["asked"] - g["overlap"]) >= limits.retrieve_min_score)].copy()
    passed["score"] = passed["score"].round(6)
    return passed.sort_values(["event_id", "score", "doc"], ascending=[True, False, True])


def unseen(ranked: pd.DataFrame, seen: set[int] | None, most: int, compacted: Iterable[int] = ()) -> Iterator[tuple[int, int, float, int]]:
    """(event_id, doc, score, rank) of the first ``most`` pages of each prompt that its session lacks; adds them to
    ``seen``, which a compaction empties."""
    clear = sorted(compacted, reverse=True)
    for event, part in ranked.groupby("event_id", sort=True):
        while clear and clear[-1] < event:
            clear.pop()
            if seen is not None:
                seen.clear()
        rank = 0
        for doc, score in zip(part["doc"], part["score"]):
            if seen is None or int(doc) not in seen:
                rank += 1
                yield int(event), int(doc), float(score), rank
                if seen is not None:
                    seen.add(int(doc))
                if rank == most:
                    break
    if clear and seen is not None:
        seen.clear()


def _frame(session: str | None, pages: Iterable[tuple], spaces: Iterable[tuple]) -> pd.DataFrame:
    rows = [(session, e, "page", d, s, r, None) for e, d, s, r in pages] + [(session, e, "workspace", None, None, None, u) for e, u in spaces]
    out = pd.DataFrame(rows, columns=["session", "event_id", "kind", "doc", "score", "rank", "updated"])
    return out.astype({"event_id": "int64", "doc": "Int64", "score": "Float64", "rank": "Int32", "updated": "datetime64[us]"})


class Recall(StatefulProcessor):
    """Ranks the prompts of a session and keeps what it was shown."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        page = T.StructType([T.StructField("doc", T.LongType())])
        event = T.StructType([T.StructField("event_id", T.LongType())])
        time = T.StructType([T.StructField("updated", T.TimestampType())])
        self.seen = handle.getMapState("seen", page, event, TTL_DAYS * _DAY_MS)
        self.shown = handle.getValueState("workspace", time, TTL_DAYS * _DAY_MS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hits, session = pd.concat(list(rows)), key[0]
        # at most a few pages a prompt were shown to a session
        seen = None if session is None else {int(k[0]) for k in self.seen.keys()}
        compacted = set(hits.loc[hits["compact"], "event_id"])
        pages = list(unseen(rank_hits(hits, self.limits), seen, self.limits.retrieve_max_results, compacted))
        shown = self.shown.get()[0] if session is not None and self.shown.exists() else None
        shown, spaces = pd.Timestamp(shown) if shown is not None else None, []
        for event, updated in sorted(set(zip(hits["event_id"], hits["updated"]))):
            if not pd.isna(updated) and (session is None or shown is None or updated.to_pydatetime() != shown.to_pydatetime()):
                shown = updated
                spaces.append((event, updated))
        if session is not None:
            if compacted:
                self.seen.clear()
                for doc in seen:  # a page that went out since the last compaction
                    self.seen.updateValue((doc,), (max(e for e, d, *_ in pages if d == doc),))
            else:
                for event, doc, *_ in pages:
                    self.seen.updateValue((doc,), (event,))
            if spaces:
                self.shown.update((shown.to_pydatetime(),))
        yield _frame(session, pages, spaces)

    def close(self) -> None:
        pass


def recall(prompts: DataFrame, postings: DataFrame, workspaces: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Stream of prompts(session, event_id, cwd, text) -> rows of OUT: pages and changed workspace pages."""
    limits = limits or Limits()
    found = lookups(prompts, postings, workspaces, limits)
    return found.groupBy("session").transformWithStateInPandas(statefulProcessor=Recall(limits), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")


def render(shown: DataFrame, pages: DataFrame) -> DataFrame:
    """``shown`` with the line that a prompt gets for each page of pages(ord, slug, title, summary)."""
    line = F.concat(F.lit("- ["), "slug", F.lit("] "), F.coalesce("title", F.lit("")), F.lit(": "), F.substring(X.oneline(F.coalesce("summary", F.lit("")), 1 << 20), 1, 220))
    return shown.join(pages.select(F.col("ord").alias("doc"), "slug", line.alias("line")), "doc", "left")


def recall_stream(prompts: DataFrame, postings: DataFrame, workspaces: DataFrame, store: str, checkpoint: str, limits: Limits | None = None):
    """Run a stream of prompts into Parquet until its input is used up.

    Without batches that have no data, as in ``sessions.inject_stream``; a query keeps the settings it started with, so
    the session gets its own back.
    """
    conf = prompts.sparkSession.conf
    before = {name: conf.get(name, None) for name in STARTED_WITH}
    for name, value in STARTED_WITH.items():
        conf.set(name, value)
    try:
        query = recall(prompts, postings, workspaces, limits).writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    while not query.awaitTermination(10):
        pass
    return query


def recall_sessions(prompts: DataFrame, docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(session, event_id, doc, score, rank) of a table of prompts(session, event_id, text[, kind]) and docs(doc, tokens)."""
    limits = limits or Limits()
    most = limits.retrieve_max_results
    named = prompts.select(F.struct("session", "event_id").alias("prompt"), asked_tokens(F.col("text"), limits).alias("tokens")).filter(F.size("tokens") > 0).dropDuplicates(["prompt"])
    # a prompt can find only what earlier prompts of its session have used up above its own places
    earlier = Window.partitionBy("prompt.session").orderBy("prompt.event_id")
    wanted = F.when(F.col("prompt.session").isNull(), F.lit(1)).otherwise(F.row_number().over(earlier)) * most
    named = materialize(named.select("prompt", "tokens", wanted.cast("int").alias("k")), "recall-prompts")
    named = materialize(named.select(F.monotonically_increasing_id().alias("number"), "prompt", "tokens", "k"), "recall-prompts")
    found = K.lexical_blocks(docs, named.select(F.col("number").alias("prompt"), "k", "tokens"), limits.retrieve_min_overlap, limits.retrieve_min_score)
    if found is None:
        longest = (named.agg(F.max("k")).first()[0] or 0) or most
        found = K.lexical(docs, named.select(F.col("number").alias("prompt"), "tokens"), limits.retrieve_min_overlap, limits.retrieve_min_score, 2, top=longest)
    flat = found.select(F.col("prompt").alias("number"), "doc", "score").join(named.select("number", "prompt"), "number").select("prompt.session", "prompt.event_id", "doc", "score")
    cuts = kinds(prompts).filter("compact").select("session", "event_id", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("double").alias("score"))
    flat = flat.unionByName(cuts)

    def fold(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        cut = part["doc"].isna()
        best = part[~cut].sort_values(["event_id", "score", "doc"], ascending=[True, False, True])
        rows = unseen(best, None if pd.isna(key[0]) else set(), most, set(part.loc[cut, "event_id"]))
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["session", "event_id", "doc", "score", "rank"])

    return flat.groupBy("session").applyInPandas(fold, "session string, event_id long, doc long, score double, rank int")
