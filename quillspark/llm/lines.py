"""Line dedup: lines that many documents share stay in one of them, the one with the largest doc_id.

1.  Every line that can count gives one narrow row: a 96-bit hash of its key, its document and its position.
2.  These rows are range-partitioned by (hash, document) and sorted by hash, falling document and position, so that
    each task streams through runs of one key and meets the document that keeps it first.  A run within a task is
    decided on the spot.  A very common line spans many tasks, since its documents are part of the range key; the
    first and last run of a task stay open, and two summary rows a task (a proven bound, so they are broadcast)
    decide them.
3.  The dropped positions of a document become a compressed bitmap.  Texts are not moved for it: bitmaps, which only
    documents that lose lines have, are joined back to them, by broadcast if their measured size allows it.

A key is the line without ASCII white space at its ends, A-Z lower-cased.  Rows that share a doc_id count as one
document.

Edge cases: a null or empty text is one empty line; a null doc_id is a document of its own, smaller than all others;
repeated rows are one document and lose the same lines; a very long text is one list of lines in one task; a line
that a document repeats loses or keeps all its places; an empty table gives no rows; other columns are ignored by
``keep_bitmaps`` and carried by ``drop_lines``, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, rows, small, table

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Stands for a null doc_id inside this module: smaller than any other.
NO_ID = -(1 << 63)
DROP, OPEN, EDGE = 0, 1, 2

_POSTING = "h1 long, h2 int, did long, tk long, pos int"
_FOUND = "kind int, h1 long, h2 int, did long, tk long, pos int, n long"


def line_keys(text: bytes | None, least_chars: int = LEAST_CHARS) -> list[tuple[int, bytes]]:
    """(position, key) of the lines whose key is long enough to count.  ``bytes`` strip and lower ASCII only."""
    found = []
    for i, line in enumerate((text or b"").split(b"\n")):
        key = line.strip(b" \t\n\x0b\x0c\r").lower()
        if len(key) >= least_chars and (len(key) >= 4 * least_chars or len(key.decode("utf-8", "surrogatepass")) >= least_chars):
            found.append((i, key))
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    """did and tk name a row: its id, and a hash of its text for rows that share one."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(F.col("text").cast("string")).alias("tk"), F.col("text").cast("string").cast("binary").alias("text"))


def _postings(docs: DataFrame, least_chars: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            h1, h2, of, pos = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for p, key in line_keys(text, least_chars):
                    high, low = struct.unpack("<qi4x", xxhash.xxh3_128_digest(key))
                    h1.append(high)
                    h2.append(low)
                    of.append(i)
                    pos.append(p)
            take = pa.array(of, pa.int64())
            yield pa.record_batch([pa.array(h1, pa.int64()), pa.array(h2, pa.int32()), b.column("did").take(take), b.column("tk").take(take), pa.array(pos, pa.int32())], names=["h1", "h2", "did", "tk", "pos"])

    return _keyed(docs).mapInArrow(run, _POSTING)


class _Runs:
    """Decides the runs of one task's sorted rows; holds at most the rows of two documents of the run at hand."""

    def __init__(self, least_docs: int):
        self.least_docs = least_docs
        self.out: list[np.ndarray] = []
        self.key: tuple[int, int] | None = None  # of the run at hand
        self.first = True  # it is the task's first run
        self.n, self.top, self.last = 0, 0, 0  # its documents, its largest and its last one
        self.held: list[np.ndarray] = []  # rows that wait for more documents

    def _emit(self, kind: int, part: np.ndarray) -> None:
        if len(part):
            self.out.append(np.column_stack([np.full(len(part), kind), part, np.zeros(len(part), dtype=np.int64)]))

    def _edge(self) -> None:
        self.out.append(np.array([[EDGE, *self.key, self.top, 0, 0, self.n]], dtype=np.int64))

    def _more(self, part: np.ndarray) -> None:
        """Rows (h1, h2, did, tk, pos) of the run at hand."""
        did = part[:, 2]
        if not self.n:
            self.top, self.last, self.n = int(did[0]), int(did[0]), 1
        self.n += int(np.count_nonzero(np.diff(did, prepend=self.last)))
        self.last = int(did[-1])
        if self.first:
            self._emit(OPEN, part)
        elif self.n < self.least_docs:
            self.held.append(part)
        else:
            for p in [*self.held, part]:
                self._emit(DROP, p[p[:, 2] != self.top])
            self.held = []

    def _close(self, last: bool) -> None:
        if self.key is not None and (self.first or last):
            for p in self.held:
                self._emit(OPEN, p)
            self._edge()
        self.held, self.n, self.first = [], 0, False

    def feed(self, part: np.ndarray) -> None:
        """The next rows.  Runs that lie within them are decided together."""
        if not len(part):
            return
        new = np.flatnonzero(np.any(part[1:, :2] != part[:-1, :2], axis=1)) + 1
        bounds = [0, *new.tolist(), len(part)]
        key = tuple(part[0, :2].tolist())
        if key != self.key and self.key is not None:
            self._close(False)
        self.key = key
        self._more(part[: bounds[1]])
        if len(bounds) == 2:
            return
        self._close(False)
        inner = part[bounds[1] : bounds[-2]]
        if len(inner):
            start = np.zeros(len(inner), dtype=bool)
            start[np.array(bounds[1:-2]) - bounds[1]] = True
            run = np.cumsum(start) - 1
            step = start | (np.diff(inner[:, 2], prepend=inner[0, 2]) != 0)
            docs = np.bincount(run, weights=step).astype(np.int64)
            place = np.cumsum(step) - (np.cumsum(docs) - docs)[run]  # of a row's document in its run, from 1
            self._emit(DROP, inner[(docs[run] >= self.least_docs) & (place > 1)])
        self.key = tuple(part[bounds[-2], :2].tolist())
        self._more(part[bounds[-2] :])

    def end(self) -> None:
        if self.key is not None:
            self._close(True)

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            a = np.concatenate(self.out)
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(a[:, i], pa.int64()).cast(k) for i, k in enumerate(kinds)], names=["kind", "h1", "h2", "did", "tk", "pos", "n"])
        self.out = []


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(did, tk, pos) of the lines that go."""
    postings = materialize(_postings(docs, least_chars), "lines")
    order = [F.col("h1"), F.col("h2"), F.desc("did")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(least_docs)
        for b in batches:
            runs.feed(np.column_stack([b.column(i).cast(pa.int64()).to_numpy() for i in range(5)]))
            yield from runs.taken()
        runs.end()
        yield from runs.taken()

    found = materialize(postings.repartitionByRange(*order).sortWithinPartitions(*order, "tk", "pos").mapInArrow(run, _FOUND), "line-runs")
    # two summaries a task at most: broadcast
    edges = found.filter(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("did").alias("top"))
    left = found.filter(F.col("kind") == OPEN).join(F.broadcast(edges), ["h1", "h2"]).filter((F.col("docs") >= least_docs) & (F.col("did") < F.col("top")))
    return found.filter(F.col("kind") == DROP).select("did", "tk", "pos").unionAll(left.select("did", "tk", "pos"))


def pack_bits(dropped: Iterable[int]) -> bytes:
    """Compressed bitmap of a document's lines, 0 for a dropped one; lines beyond its end stay."""
    at = np.fromiter(dropped, dtype=np.int64)
    bits = np.ones(int(at.max()) + 1 if len(at) else 0, dtype=np.uint8)
    bits[at] = 0
    return zlib.compress(struct.pack("<q", len(bits)) + np.packbits(bits).tobytes())


def unpack_bits(keep: bytes | None, n_lines: int) -> np.ndarray:
    """Whether each of a document's lines stays."""
    kept = np.ones(n_lines, dtype=bool)
    if keep:
        raw = zlib.decompress(keep)
        n = struct.unpack_from("<q", raw)[0]
        kept[:n] = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, offset=8), count=n).astype(bool)
    return kept


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(did, tk, keep) of the documents that lose lines: their bitmaps, as a durable table.

    A bitmap is gathered from one document's positions, so it is bounded by that document.
    """
    gathered = dropped_lines(docs, least_chars, least_docs).groupBy("did", "tk").agg(F.collect_set("pos").alias("pos"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            keep = pa.array([pack_bits(p) for p in b.column("pos").to_pylist()], pa.binary())
            yield pa.record_batch([b.column("did"), b.column("tk"), keep], names=["did", "tk", "keep"])

    return materialize(gathered.mapInArrow(run, "did long, tk long, keep binary"), "line-bitmaps")


def _joined(left: DataFrame, bitmaps: DataFrame) -> DataFrame:
    return left.join(F.broadcast(bitmaps) if small(bitmaps, F.length("keep") + 48) else bitmaps, ["did", "tk"], "left")


def kept_lines(text: bytes | None, keep: bytes | None) -> tuple[int, int, bytes]:
    """(lines, dropped lines, text without them)."""
    text = text or b""
    if not keep:
        return text.count(b"\n") + 1, 0, text
    lines = text.split(b"\n")
    stays = unpack_bits(keep, len(lines))
    kept = [line for line, s in zip(lines, stays) if s]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """All rows and columns of docs, ``text`` without its dropped lines (a null text stays null)."""
    bitmaps = keep_bitmaps(docs, least_chars, least_docs)
    text = F.col("row.text").cast("string")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = whole.withColumn("did", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID))).withColumn("tk", F.xxhash64(text))

    @F.pandas_udf("string")
    def without(text, keep):
        return text.combine(keep, lambda t, k: t if t is None or not k else kept_lines(t.encode("utf-8", "surrogatepass"), bytes(k))[2].decode("utf-8", "surrogatepass"))

    cleaned = F.when(F.col("keep").isNull(), text).otherwise(without(text, F.col("keep")))
    return _joined(whole, bitmaps).withColumn("cleaned", cleaned).select(*[F.col("cleaned").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def digests(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of docs(doc_id, text)."""
    bitmaps = keep_bitmaps(docs, least_chars, least_docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            found = [kept_lines(t, k) for t, k in zip(b.column("text").to_pylist(), b.column("keep").to_pylist())]
            yield pa.record_batch([b.column("did"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in found], pa.string())], names=["did", "n_lines", "n_dropped", "kept_sha256"])

    done = _joined(_keyed(docs), bitmaps).select("did", "text", "keep").mapInArrow(run, "did long, n_lines long, n_dropped long, kept_sha256 string")
    return done.select(F.nullif("did", F.lit(NO_ID)).alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


_ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
j AS (SELECT k.*, often.key IS NOT NULL AND doc_id < top AS gone FROM k LEFT JOIN often USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY r"""

QUERIES = {"op12_lines": op12_lines}
ORACLE_SQL = {"op12_lines": _ORACLE}
