"""Substring dedup: words covered by long windows that recur anywhere in the corpus are removed.

Two tools.  ``SuffixAutomaton`` gives matching statistics of a stream against a bounded reference shard, and
``remove_known`` broadcasts one automaton per shard to remove maximal spans of known text.  For repeats of the
corpus in itself (op5) every document is reference and stream at once: the shards would be the whole corpus, an
automaton of it has no size bound, and every document would meet every shard.  There, equal windows are found
by shuffles instead, in exact steps:

1.  Equal texts are one row with a count.  The row table is bucketed by the text's digest, so later joins by
    digest shuffle only the narrow side.
2.  Each window's minimizer (smallest hash of its runs of GRAM words) is a function of the window, so equal
    windows share it; minimizers that occur once in the corpus rule their windows out (nearly all of them).
3.  The remaining windows are taken in segments: neighbours in a text that share their minimizer.  Segments are
    counted by a 128-bit hash of their words; all windows of a segment that occurs twice recur.  If all segments
    of a minimizer are equal, nothing else can hold their windows, and they are settled.
4.  Only where segments of a minimizer differ are single windows counted, by a 128-bit hash: all of a segment that
    occurs once, those of any other from one of its places.
5.  What recurs, segments and windows, goes back to its text, which drops every word it covers.

Edge cases: null and empty texts have no words; repeated rows are repeats of each other; texts shorter than the
window lose nothing; an empty table gives no rows; null doc_ids are carried; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import chunks, materialize, rows, table, words_of

WINDOW, GRAM = 35, 8
#: Bound of one reference shard, in words, for the broadcast automata of ``remove_known``.
SHARD_WORDS = 200_000

_P1, _P2, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


class SuffixAutomaton:
    """Suffix automaton of a word sequence (None separates documents): all its factors, in linear size."""

    def __init__(self, words: Iterable):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w: object) -> int:
        cur = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            if self.length[p] + 1 == self.length[q]:
                self.link[cur] = q
            else:
                clone = len(self.next)
                self.next.append(dict(self.next[q]))
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                while p >= 0 and self.next[p].get(w) == q:
                    self.next[p][w] = clone
                    p = self.link[p]
                self.link[q] = self.link[cur] = clone
        return cur

    def statistics(self, words: Iterable) -> Iterator[int]:
        """For each word, the length of the longest factor of the reference that ends there."""
        state, length = 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w is not None and w in self.next[state]:
                state, length = self.next[state][w], length + 1
            else:
                state, length = 0, 0
            yield length


def remove_known(docs: DataFrame, reference: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept of every row, without the maximal spans of at least ``window`` words that
    also stand in a text of ``reference``.

    The reference is cut into shards of at most SHARD_WORDS words (neighbouring shards overlap by a window less
    one word, so no span of the window's length is lost between two), each an automaton that is broadcast in its
    turn; spans of all shards add up.  The documents are read once per shard: meant for reference sets, not for
    a corpus against itself.
    """
    spark = docs.sparkSession
    stream: list = []
    shards: list = []
    for r in reference.select(F.col("text").cast("string").alias("text")).toLocalIterator():
        stream += [*words_of(r["text"]), None]
        while len(stream) > SHARD_WORDS:
            shards.append(stream[:SHARD_WORDS])
            stream = stream[SHARD_WORDS - window + 1 :]
    shards.append(stream)
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.array().cast("array<int>").alias("ends"))
    for shard in shards:
        words = spark.sparkContext.broadcast(shard)

        def mark(batches: Iterable[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:
            automaton = SuffixAutomaton(words.value)
            for b in rows(batches):
                ends = [e + [i for i, n in enumerate(automaton.statistics(words_of(t))) if n >= window] for t, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(ends, pa.list_(pa.int32()))], names=["doc_id", "text", "ends"])

        out = out.mapInArrow(mark, "doc_id long, text string, ends array<int>")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            ends = [np.asarray(e, dtype=np.int64) + 1 for e in b.column(2).to_pylist()]
            done = [_without(words_of(t), e - window, e) for t, e in zip(b.column(1).to_pylist(), ends)]
            yield pa.record_batch([b.column(0), pa.array([n for n, _, _ in done], pa.int64()), pa.array([r for _, r, _ in done], pa.int64()), pa.array([k.decode("utf-8", "replace") for _, _, k in done], pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return out.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def _without(words: list[bytes], starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    """(words, removed words, kept text) when the words from each of ``starts`` to before its end go."""
    n = len(words)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    gone = np.cumsum(edge[:n]) > 0
    removed = int(gone.sum())
    return n, removed, b" ".join(words if not removed else [w for w, g in zip(words, gone.tolist()) if not g])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _rolled(x: np.ndarray, size: int, factor: np.uint64) -> np.ndarray:
    """Hash of each run of ``size`` values, by doubling: a run is two runs of half its size (and one more)."""
    h, n = x, 1
    for bit in bin(size)[3:]:
        step = np.uint64(pow(int(factor), n, 1 << 64))
        h, n = h[: len(h) - n] * step + h[n:], 2 * n
        if bit == "1":
            h, n = h[: len(h) - 1] * factor + x[n : n + len(h) - 1], n + 1
    return _mix(h)


def _slide(x: np.ndarray, size: int, of) -> np.ndarray:
    """Minimum or maximum of each run of ``size`` values."""
    n = 1
    while 2 * n <= size:
        x, n = of(x[: len(x) - n], x[n:]), 2 * n
    return of(x[: len(x) - (size - n)], x[size - n :]) if size > n else x


class Windows:
    """Word hashes of a chunk of texts, as one sequence; with ``gram`` also minimizers and window validity."""

    def __init__(self, texts: list[str], window: int, gram: int | None = None):
        words = [words_of(t) for t in texts]
        n = np.array([len(w) for w in words], dtype=np.int64)
        self.first = np.cumsum(n) - n
        self.hash = _mix(np.frombuffer(b"".join([xxhash.xxh3_64_digest(w) for ws in words for w in ws]), dtype="<u8").astype(np.uint64)) if n.sum() else np.zeros(0, np.uint64)
        self.owner = np.repeat(np.arange(len(texts)), n)
        self.enough = len(self.hash) >= window
        if self.enough and gram:
            self.valid = self.owner[: len(self.hash) - window + 1] == self.owner[window - 1 :]
            self.grams = _rolled(self.hash, gram, _P1)
            self.least = _slide(self.grams, window - gram + 1, np.minimum)


def _minimizers(window: int, gram: int):
    span = window - gram + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, 2048):
            texts = b.column(1).to_pylist()
            for a, z in chunks(texts):
                w = Windows(texts[a:z], window, gram)
                if not w.enough or not w.valid.any():
                    continue
                # a gram is selected where some valid window that holds it has it as its minimum
                least = np.concatenate([np.zeros(span - 1, np.uint64), np.where(w.valid, w.least, 0), np.zeros(span - 1, np.uint64)])
                at = np.flatnonzero(_slide(least, span, np.maximum) == w.grams)
                pairs = np.stack([w.owner[at].astype(np.uint64), w.grams[at]], axis=1)
                order = np.lexsort((pairs[:, 1], pairs[:, 0]))
                pairs = pairs[order]
                new = np.ones(len(pairs), dtype=bool)
                new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
                start = np.flatnonzero(new)
                times = np.diff(np.append(start, len(pairs)))
                owner = pairs[start, 0].astype(np.int64)
                yield pa.record_batch([b.column(0).take(pa.array(owner + a)), pa.array(pairs[start, 1].view(np.int64)), pa.array(times.astype(np.int32)), b.column(2).take(pa.array(owner + a))], names=["digest", "h", "times", "copies"])

    return run


def _segments(window: int, gram: int):
    span = window - gram + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, 256):
            texts, again = b.column(1).to_pylist(), b.column(3)
            for a, z in chunks(texts):
                w = Windows(texts[a:z], window, gram)
                if not w.enough:
                    continue
                keep = np.zeros(len(w.valid), dtype=bool)
                for i in range(a, z):
                    lo = w.first[i - a]
                    hi = w.first[i - a + 1] if i - a + 1 < len(w.first) else len(w.hash)
                    keep[lo:hi] = np.isin(w.least[lo:hi], again[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                at = np.flatnonzero(keep & w.valid)
                least, owner = w.least[at], w.owner[at]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (np.diff(at) != 1) | (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
                # at most ``span`` windows, so that the first and the last cover all words of a segment
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                head = np.flatnonzero(place % span == 0)
                many = np.diff(np.append(head, len(at)))
                start, owner = at[head], owner[head]
                one, two = (_mix((h[start] * _P1 + h[start + many - 1]) * _P2 + many.astype(np.uint64)) for h in (_rolled(w.hash, window, _P1), _rolled(w.hash, window, _P2)))
                yield pa.record_batch([b.column(0).take(pa.array(owner + a)), pa.array(least[head].view(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array((start - w.first[owner]).astype(np.int32)), pa.array(many.astype(np.int32)), b.column(2).take(pa.array(owner + a))], names=["digest", "h", "one", "two", "start", "many", "copies"])

    return run


def _windows(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, 256):
            texts, segments = b.column(1).to_pylist(), b.column(2)
            for a, z in chunks(texts):
                w = Windows(texts[a:z], window)
                found = [segments[i].values for i in range(a, z)]
                start, many, single = (np.concatenate([f.field(name).to_numpy(zero_copy_only=False) for f in found]) for name in ("start", "many", "single"))
                owner = np.repeat(np.arange(z - a), [len(f) for f in found])
                # every start of every segment
                of = np.repeat(np.arange(len(start)), many)
                begin = start[of] + np.arange(len(of)) - (np.cumsum(many) - many)[of]
                at, owner = w.first[owner[of]] + begin, owner[of]
                one, two = _rolled(w.hash, window, _P1)[at], _rolled(w.hash, window, _P2)[at]
                yield pa.record_batch([b.column(0).take(pa.array(owner + a)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(begin.astype(np.int32)), pa.array(single[of].astype(bool))], names=["digest", "one", "two", "start", "single"])

    return run


def _finish(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            out = []
            for text, copies, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                words = words_of(text)
                if copies > 1 and len(words) >= window:
                    out.append((len(words), len(words), b""))
                else:
                    start, many = (found.values.field(name).to_numpy(zero_copy_only=False).astype(np.int64) if found.is_valid else np.zeros(0, np.int64) for name in ("start", "many"))
                    out.append(_without(words, start, start + many + window - 1))
            yield pa.record_batch([b.column(0), pa.array([n for n, _, _ in out], pa.int64()), pa.array([r for _, r, _ in out], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for _, _, k in out], pa.string())], names=["digest", "n_words", "n_removed", "kept_sha256"])

    return run


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go when their query ends, not when the driver happens to collect its garbage: every
    step is read from its table, so none is used again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row (see the module's text)."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("digest"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with _tidy(docs.sparkSession):
        result = _judged(each, window, gram)
    return each.select("doc_id", "digest").join(result, "digest").select("doc_id", "n_words", "n_removed", "kept_sha256")


def _judged(each: DataFrame, window: int, gram: int) -> DataFrame:
    """digest, n_words, n_removed, kept_sha256 of every distinct text."""
    spark = each.sparkSession
    name = f"quillspark_texts_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = each.groupBy("digest").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    unique.write.bucketBy(parts, "digest").format("parquet").option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name).select("digest", "text", "copies")
    grams = materialize(texts.mapInArrow(_minimizers(window, gram), "digest binary, h long, times int, copies long"), "minimizers")
    # written first: a join of two plain tables is one whose hot keys Spark can split
    again = materialize(grams.groupBy("h").agg(F.sum(F.col("times") * F.col("copies")).alias("n")).filter(F.col("n") > 1).select("h"), "again")
    mine = grams.select("digest", "h").join(again, "h", "left_semi").groupBy("digest").agg(F.collect_list("h").alias("again"))
    found = texts.join(mine, "digest").select("digest", "text", "copies", "again")
    segments = materialize(found.mapInArrow(_segments(window, gram), "digest binary, h long, one long, two long, start int, many int, copies long"), "segments")
    place = F.xxhash64("digest", "start")
    contents = materialize(segments.groupBy("h", "one", "two").agg(F.sum("copies").alias("n"), F.min(place).alias("chosen")), "contents")
    # one content at two places: no other segment can hold its windows; else single windows must be compared
    mixed = materialize(contents.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n")).filter("kinds > 1 or n = 1").select("h", F.lit(True).alias("mixed")), "mixed")
    contents = materialize(contents.join(mixed, "h", "left").select("one", "two", "n", "chosen", F.coalesce("mixed", F.lit(False)).alias("mixed")), "judged")
    judged = segments.join(contents, ["one", "two"]).select("digest", "start", "many", "copies", (F.col("n") == 1).alias("single"), (F.col("mixed") & ((F.col("n") == 1) | (F.col("chosen") == place))).alias("compare"))
    judged = materialize(judged.filter(F.col("compare") | (~F.col("single") & (F.col("copies") == 1))), "places")
    compare = judged.filter("compare").groupBy("digest").agg(F.collect_list(F.struct("start", "many", "single")).alias("segments"))
    compare = texts.join(compare, "digest").select("digest", "text", "segments")
    windows = materialize(compare.mapInArrow(_windows(window), "digest binary, one long, two long, start int, single boolean"), "windows")
    # a window of a segment that recurs has two places at least
    n = F.sum(F.when(F.col("single"), 1).otherwise(2))
    repeated = materialize(windows.groupBy("one", "two").agg(n.alias("n"), F.max("single").alias("single")).filter((F.col("n") > 1) & F.col("single")).select("one", "two"), "repeated")
    found = windows.filter("single").join(repeated, ["one", "two"], "left_semi").select("digest", "start", F.lit(1).alias("many"))
    found = found.unionAll(judged.filter(~F.col("single") & (F.col("copies") == 1)).select("digest", "start", "many"))
    found = found.groupBy("digest").agg(F.collect_list(F.struct("start", "many")).alias("found"))
    result = texts.join(found, "digest", "left").select("digest", "text", "copies", "found").mapInArrow(_finish(window), "digest binary, n_words long, n_removed long, kept_sha256 string")
    result = materialize(result, "kept")
    spark.sql(f"DROP TABLE {name}")
    return result


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op5_substring": op5_substring}
ORACLE_SQL: dict[str, str] = {}
