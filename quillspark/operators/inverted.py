"""Inverted index of token sets: exact top-k by upper bounds, and a persistent form that follows changed documents.

The score of a document for a prompt is the sum of the inverse document frequencies of the tokens they share.  Taken
from frequent to rare, the weights of a prompt's first tokens bound the score of every document that has none of the
others, so the postings of those frequent tokens need not be read to find the best documents:

1.  Leave out the frequent tokens that hold a small part of the prompt's weight, score the documents that the other
    tokens lead to (from their own token sets, so exactly), and keep the k best.
2.  The k-th score is now a lower bound of the final one.  Prompts whose left-out weight reaches it read the postings
    of just those tokens that the bound asks for; all others are done.

Two gates prune as well: a document must share ``min_overlap`` tokens, so the ``min_overlap - 1`` most frequent never
lead to one, and with a Jaccard gate of j its set has at most |prompt| / j tokens (postings are stored by size).
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.durable import materialize, small

#: Part of a prompt's weight whose tokens the first round leaves out.
FIRST_SHARE = 0.35
#: Scores are rounded to six places; a bound has to be lower by more than that.
STEP = 2e-6
#: Folders of postings (by token) and of token sets (by document) in a segment.
BUCKETS = 32


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("prompt").orderBy(F.desc("score"), "doc"))).filter(F.col("rank") <= top)


def ask(prompts: DataFrame, min_tokens: int) -> DataFrame:
    """(prompt, asked, t) of prompts(prompt, tokens) with enough tokens."""
    return prompts.filter(F.size("tokens") >= min_tokens).select("prompt", F.size("tokens").alias("asked"), F.explode("tokens").alias("t"))


def weigh(asked: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """(prompt, asked, t, df, idf, place, rest, total) of the asked tokens that documents have; ``place`` counts from the
    most frequent, ``rest`` is the weight of the tokens up to there."""
    known = asked.join(df.select("t", "df"), "t").select("prompt", "asked", "t", "df", idf(F.lit(float(n)), F.col("df")).alias("idf"))
    order = Window.partitionBy("prompt").orderBy("idf", "t")
    return known.select("*", F.row_number().over(order).alias("place"), F.sum("idf").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("rest"), F.sum("idf").over(Window.partitionBy("prompt")).alias("total"))


def _score(leads: DataFrame, postings: DataFrame, forward: DataFrame, asked: DataFrame, min_overlap: int, min_jaccard: float, top: int) -> DataFrame:
    """The ``top`` of the documents that the tokens of ``leads`` (prompt, asked, t) lead to."""
    met = postings.join(leads, "t")
    if min_jaccard > 0:
        met = met.filter(F.col("size") <= F.col("asked") / min_jaccard)
    pairs = met.select("prompt", "doc").distinct()
    both = pairs.join(forward.select("doc", "tokens"), "doc").join(asked, "prompt")
    shared = F.array_intersect("own", "tokens")
    counted = both.select("prompt", "doc", F.size("tokens").alias("size"), "asked", "weights", shared.alias("shared"))
    overlap = F.size("shared")
    passed = counted.filter((overlap >= min_overlap) & (overlap / (F.col("size") + F.col("asked") - overlap) >= min_jaccard))
    total = F.aggregate("shared", F.lit(0.0), lambda a, t: a + F.element_at("weights", t))
    return _ranked(passed.select("prompt", "doc", F.round(total, 6).alias("score")), top)


def top_k(postings: DataFrame, forward: DataFrame, weighed: DataFrame, top: int, min_overlap: int = 1, min_jaccard: float = 0.0, first_share: float = FIRST_SHARE) -> DataFrame:
    """(prompt, doc, score, rank): the ``top`` documents of each prompt, ties to the smaller doc.

    postings(t, doc, size) may hold tokens that a document has no longer: documents are judged by forward(doc, tokens).
    ``weighed`` is a durable table of ``weigh``.
    """
    min_overlap = max(1, min_overlap)
    asked = weighed.groupBy("prompt").agg(F.first("asked").alias("asked"), F.collect_list("t").alias("own"), F.map_from_entries(F.collect_list(F.struct("t", "idf"))).alias("weights"))
    asked = materialize(asked, "asked")
    if small(asked, F.size("own") * 64 + 64):
        asked = F.broadcast(asked)
    gated = F.col("place") < min_overlap
    left_out = gated | (F.col("rest") <= F.col("total") * first_share)
    found = materialize(_score(weighed.filter(~left_out).select("prompt", "asked", "t"), postings, forward, asked, min_overlap, min_jaccard, top), "best")
    worst = found.filter(F.col("rank") == top).select("prompt", F.col("score").alias("worst"))
    # a left-out token is needed if the tokens up to it can make a score that the k-th does not exceed
    needed = left_out & ~gated & (F.col("rest") >= F.coalesce("worst", F.lit(0.0)) - STEP)
    more = materialize(weighed.join(worst, "prompt", "left").filter(needed).select("prompt", "asked", "t"), "leads")
    if more.isEmpty():
        return found
    again = _score(more, postings, forward, asked, min_overlap, min_jaccard, top)
    cols = ["prompt", "doc", "score"]
    return _ranked(found.select(*cols).unionAll(again.select(*cols)).distinct(), top)


def explode_sets(sets: DataFrame) -> DataFrame:
    """Postings (t, size, doc) of sets(doc, tokens)."""
    return sets.select(F.explode("tokens").alias("t"), F.size("tokens").alias("size"), "doc")


class Conflict(RuntimeError):
    """Another writer committed the same segment first."""


class Index:
    """A persistent inverted index: segments of Parquet tables, each the outcome of one update.

    A segment has the token sets of the documents that it wrote, their postings, the change of each token's document
    frequency, and tombstones (document, segment) of the sets that it replaces or deletes.  It exists once its marker
    file is created, which only one writer can do for a number; a failed update leaves files that nothing reads.
    Updates read and write changed documents only.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, doc_type: str = "long"):
        self.spark, self.path, self.buckets, self.doc_type = spark, path.rstrip("/"), buckets, doc_type

    # segments
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def segments(self) -> list[dict]:
        """Markers of the segments that count, in order."""
        fs, p = self._fs(f"{self.path}/segments")
        if not fs.exists(p):
            return []
        found = []
        for s in fs.listStatus(p):
            stream = fs.open(s.getPath())
            try:
                found.append(json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
            finally:
                stream.close()
        gone = {n for m in found for n in m["replaces"]}
        return sorted((m for m in found if m["number"] not in gone), key=lambda m: m["number"])

    def _next(self) -> int:
        fs, p = self._fs(f"{self.path}/segments")
        return 1 + max((int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(p)), default=0) if fs.exists(p) else 1

    def _commit(self, number: int, name: str, docs: int, replaces: list[int]) -> None:
        fs, p = self._fs(f"{self.path}/segments/{number:010d}.json")
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as e:
            raise Conflict(f"segment {number} is there already") from e
        try:
            stream.write(bytearray(json.dumps({"number": number, "name": name, "docs": docs, "replaces": replaces}).encode()))
        finally:
            stream.close()

    def _read(self, kind: str, columns: str, segments: list[dict]) -> DataFrame:
        schema = f"{columns}, bucket int"
        out = None
        for m in segments:
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/{m['name']}").withColumn("seg", F.lit(m["number"]))
            out = part if out is None else out.unionAll(part)
        return self.spark.createDataFrame([], f"{schema}, seg int") if out is None else out

    def _write(self, kind: str, df: DataFrame, key: str, order: list[str], name: str) -> None:
        bucket = F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")
        dealt = df.withColumn("bucket", bucket).repartition("bucket", *order[:1]).sortWithinPartitions("bucket", *order)
        dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/{kind}/{name}")

    # tables
    def _sets(self, segments: list[dict] | None = None) -> DataFrame:
        live = self.segments() if segments is None else segments
        sets = self._read("sets", f"doc {self.doc_type}, tokens array<string>", live)
        dead = materialize(self._read("dead", f"doc {self.doc_type}, old int", live).select("doc", F.col("old").alias("seg")), "tombstones")
        return sets.join(F.broadcast(dead) if small(dead, 64) else dead, ["doc", "seg"], "left_anti")

    def documents(self) -> DataFrame:
        """(doc, tokens) of the documents as they are now."""
        return self._sets().select("doc", "tokens")

    def postings(self) -> DataFrame:
        """(t, size, doc, seg), those of replaced sets included: ``top_k`` sees through them."""
        return self._read("postings", f"t string, size int, doc {self.doc_type}", self.segments()).select("t", "size", "doc", "seg", "bucket")

    def live_postings(self) -> DataFrame:
        """(t, size, doc) of the documents as they are now."""
        live = self.segments()
        dead = self._read("dead", f"doc {self.doc_type}, old int", live).select("doc", F.col("old").alias("seg"))
        return self.postings().join(dead, ["doc", "seg"], "left_anti").select("t", "size", "doc")

    def frequencies(self) -> DataFrame:
        """(t, df, bucket) of all tokens: the sum of each segment's changes."""
        changes = self._read("frequencies", "t string, n long", self.segments())
        return changes.groupBy("t", "bucket").agg(F.sum("n").alias("df")).filter(F.col("df") > 0)

    def size(self) -> int:
        return sum(m["docs"] for m in self.segments())

    # changes
    def update(self, changed: DataFrame) -> int:
        """Bring changed(doc, tokens: distinct strings) into the index; documents without tokens (null or none) go.

        One row a document.  Sets that are as they were change nothing; returns the number of changed documents.
        """
        live, number, name = self.segments(), self._next(), uuid.uuid4().hex
        tokens = F.array_sort(F.coalesce("tokens", F.array().cast("array<string>")))
        bucket = F.pmod(F.xxhash64("doc"), F.lit(self.buckets)).cast("int")
        given = materialize(changed.select(F.col("doc").cast(self.doc_type).alias("doc"), tokens.alias("tokens")).withColumn("bucket", bucket), "changed")
        touched = [r["bucket"] for r in given.select("bucket").distinct().collect()]  # at most as many as buckets
        old = self._sets(live).filter(F.col("bucket").isin(touched)).select("doc", F.col("tokens").alias("before"), F.col("seg").alias("old"))
        joined = given.select("doc", "tokens").join(old, "doc", "left").withColumn("before", F.coalesce("before", F.array().cast("array<string>")))
        new = materialize(joined.filter(~F.col("tokens").eqNullSafe(F.col("before"))), "changes")
        counts = new.agg(F.count(F.lit(1)).alias("n"), F.sum((F.size("tokens") > 0).cast("int") - (F.size("before") > 0).cast("int")).alias("docs")).first()
        if not counts["n"]:
            return 0
        there = new.filter(F.size("tokens") > 0).select("doc", "tokens")
        self._write("sets", there, "doc", ["doc"], name)
        self._write("postings", explode_sets(there), "t", ["t", "size", "doc"], name)
        steps = new.select(F.explode(F.array_except("tokens", "before")).alias("t"), F.lit(1).alias("n")).unionAll(new.select(F.explode(F.array_except("before", "tokens")).alias("t"), F.lit(-1).alias("n")))
        self._write("frequencies", steps.groupBy("t").agg(F.sum("n").alias("n")).filter(F.col("n") != 0), "t", ["t"], name)
        self._write("dead", new.filter(F.col("old").isNotNull()).select("doc", "old"), "doc", ["doc"], name)
        self._commit(number, name, counts["docs"], [])
        return counts["n"]

    def compact(self) -> None:
        """One segment in place of all, without replaced sets and tombstones."""
        live, number, name = self.segments(), self._next(), uuid.uuid4().hex
        if len(live) < 2:
            return
        sets = materialize(self._sets(live).select("doc", "tokens"), "sets")
        postings = explode_sets(sets)
        self._write("sets", sets, "doc", ["doc"], name)
        self._write("postings", postings, "t", ["t", "size", "doc"], name)
        self._write("frequencies", postings.groupBy("t").agg(F.count(F.lit(1)).alias("n")), "t", ["t"], name)
        self._write("dead", sets.select("doc", F.lit(0).alias("old")).limit(0), "doc", ["doc"], name)
        self._commit(number, name, sum(m["docs"] for m in live), [m["number"] for m in live])

    # search
    def search(self, prompts: DataFrame, top: int, min_overlap: int = 2, min_jaccard: float = 0.05, min_tokens: int = 2) -> DataFrame:
        """(prompt, doc, score, rank) of prompts(prompt, tokens); only the folders of asked tokens are read."""
        asked = materialize(prompts.select("prompt", F.array_distinct("tokens").alias("tokens")), "prompts")
        bucket = F.pmod(F.xxhash64("t"), F.lit(self.buckets)).cast("int")
        touched = [r["b"] for r in asked.select(F.explode("tokens").alias("t")).select(bucket.alias("b")).distinct().collect()]
        wanted = asked.select(F.explode("tokens").alias("t")).distinct()
        df = self.frequencies().filter(F.col("bucket").isin(touched)).join(wanted, "t", "left_semi").select("t", "df")
        weighed = materialize(weigh(ask(asked, min_tokens), df, self.size()), "weighed")
        return top_k(self.postings().filter(F.col("bucket").isin(touched)), self.documents(), weighed, top, min_overlap, min_jaccard)
