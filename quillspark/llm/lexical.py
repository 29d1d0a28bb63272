"""Ranked lexical search: dual-sorted wavelet trees per shard, exact best-first top-k.

A shard holds the postings of consecutive rows of one task (at most SHARD_DOCS documents and about SHARD_POSTINGS
postings, so a shard is bounded and no text is shuffled).  ``build_index`` writes one row a shard: its vocabulary
and, per term, the documents and counts.

A search adds what only the whole corpus knows: number of documents, mean length, frequencies of the asked terms.
With them each shard puts the postings of a term in order of falling impact and builds a wavelet matrix over the
documents' ordinals (which rise with doc_id).  A node is a range of doc_ids; a term's list is a range of positions
in it, found by rank; as partitions are stable, the first position of the range holds the largest impact below the
node, and the sum of these over the item's terms bounds the score of every document there.  Nodes are taken from a
heap in order of their bounds until no bound reaches the k-th score (equal bounds are still opened, for a smaller
doc_id may tie).  Nodes of LEAF documents are summed up from their postings.

The k-th score of an item is kept from shard to shard of a task, and a task gives at most k rows an item.  Items are
broadcast in blocks of bounded size; each block reads the index once.

Edge cases: null texts and texts without terms are in no ranking and not in the statistics; an item without terms,
or whose terms are in no document, has no rows; a term in all documents weighs little but counts; a very long text
is a shard of its own at most; equal scores are ordered by doc_id, a null doc_id last; rows that share a doc_id are
ranked as documents of their own, as are items that share an item_id; empty tables give no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_BYTES, materialize, rows, table

TOP = 10
SHARD_DOCS, SHARD_POSTINGS, LEAF_BITS = 4096, 1 << 20, 5
#: Stands for a null doc_id in a shard: after all others.
NO_ID = (1 << 63) - 1
#: Of an impact, exclusive: 1000000000 * tf div (1000 * tf + 8 * m) with m >= 25.
IMPACTS = 1 << 20

#: Bytes of terms, A-Z lower-cased; all others become white space.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

_SHARD = "n_docs long, n_terms long, words binary, starts binary, ords binary, counts binary, ids binary, lengths binary"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TERMS).split() if text else []


def term_weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype=kind)


def _shard(docs: list[tuple[int, Counter]]) -> dict:
    """The row of a shard: ordinals follow doc_ids, postings are in order of term and ordinal."""
    docs = sorted(docs, key=lambda d: d[0])
    number: dict[bytes, int] = {}
    term = np.fromiter((number.setdefault(t, len(number)) for _, c in docs for t in c), dtype=np.int32)
    count = np.fromiter((n for _, c in docs for n in c.values()), dtype=np.int32, count=len(term))
    ord_ = np.repeat(np.arange(len(docs), dtype=np.int32), [len(c) for _, c in docs])
    words = list(number)
    by_word = sorted(range(len(words)), key=words.__getitem__)
    place = np.empty(len(words), dtype=np.int32)
    place[by_word] = np.arange(len(words), dtype=np.int32)
    term = place[term]
    order = np.argsort(term, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(words)))]).astype(np.int32)
    lengths = np.array([c.total() for _, c in docs], dtype=np.int64)
    return {
        "n_docs": len(docs), "n_terms": int(lengths.sum()), "words": zlib.compress(b" ".join(words[i] for i in by_word), 1), "starts": _pack(starts),
        "ords": _pack(ord_[order]), "counts": _pack(count[order]), "ids": _pack(np.array([d for d, _ in docs], dtype=np.int64)), "lengths": _pack(lengths),
    }


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """One row a shard of docs(doc_id, text), as a durable table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in _SHARD.split(", ")])
        for b in rows(batches):
            for id_, text in zip(b.column("did").to_pylist(), b.column("text").to_pylist()):
                found = Counter(terms_of(text))
                if not found:
                    continue
                if held and (len(held) >= shard_docs or size + len(found) > shard_postings):
                    yield pa.RecordBatch.from_pylist([_shard(held)], schema=schema)
                    held, size = [], 0
                held.append((id_, found))
                size += len(found)
        if held:
            yield pa.RecordBatch.from_pylist([_shard(held)], schema=schema)

    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.col("text").cast("string").cast("binary").alias("text"))
    return materialize(narrow.mapInArrow(run, _SHARD), "lexical-index")


class Tree:
    """Dual-sorted wavelet tree of a shard: postings by term and falling impact, over the documents' ordinals."""

    def __init__(self, starts: np.ndarray, ords: np.ndarray, impacts: np.ndarray, n_docs: int, leaf_bits: int = LEAF_BITS):
        self.starts = starts.astype(np.int64)
        bits = max(0, (n_docs - 1).bit_length())
        term = np.repeat(np.arange(len(starts) - 1, dtype=np.int64), np.diff(starts))
        # one sort of whole numbers: term, falling impact, ordinal
        key = np.sort((term << 42) | ((IMPACTS - 1 - impacts.astype(np.int64)) << 21) | ords.astype(np.int64)) if bits <= 21 else None
        if key is None:
            at = np.lexsort((ords, -impacts, term))
            ord_, impact = ords[at].astype(np.int32), impacts[at].astype(np.int32)
        else:
            ord_, impact = (key & ((1 << 21) - 1)).astype(np.int32), (IMPACTS - 1 - ((key >> 21) & (IMPACTS - 1))).astype(np.int32)
        self.depth = max(0, bits - leaf_bits)
        self.impacts, self.zeros, self.split = [impact], [], []
        for level in range(self.depth):
            one = ((ord_ >> (bits - 1 - level)) & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            self.split.append(int(self.zeros[-1][-1]))
            ord_, impact = np.concatenate([ord_[~one], ord_[one]]), np.concatenate([impact[~one], impact[one]])
            self.impacts.append(impact)
        self.leaf_ords = ord_

    def children(self, level: int, s: np.ndarray, e: np.ndarray) -> tuple[tuple, tuple]:
        """The ranges [s, e) of a node's terms in its two children, smaller doc_ids first."""
        zeros, split = self.zeros[level], self.split[level]
        zs, ze = zeros[s], zeros[e]
        return (zs, ze), (split + s - zs, split + e - ze)

    def bound(self, level: int, s: np.ndarray, e: np.ndarray, weights: np.ndarray) -> tuple:
        """(bound, s, e, weights) of the terms that the node has."""
        there = s < e
        s, e, weights = s[there], e[there], weights[there]
        return int(weights @ self.impacts[level][s]), s, e, weights

    def search(self, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, top: int, best: list[tuple[int, int]]) -> int:
        """Adds documents of this shard to ``best``, a heap of (score, -doc_id) of at most ``top``; returns opened nodes."""
        s, e = self.starts[terms], self.starts[terms + 1]
        bound, s, e, weights = self.bound(0, s, e, weights.astype(np.int64))
        heap, order, opened = [(-bound, 0, 0, s, e, weights)], 1, 0
        while heap:
            bound, _, level, s, e, weights = heapq.heappop(heap)
            if not len(s) or not bound or len(best) == top and -bound < best[0][0]:
                break
            opened += 1
            if level < self.depth:
                for s2, e2 in self.children(level, s, e):
                    b, s2, e2, w2 = self.bound(level + 1, s2, e2, weights)
                    if b and (len(best) < top or b >= best[0][0]):
                        heapq.heappush(heap, (-b, order, level + 1, s2, e2, w2))
                        order += 1
                continue
            n = e - s
            at = np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            docs, of = np.unique(self.leaf_ords[at], return_inverse=True)
            # whole numbers below 2^53: sums of doubles are exact
            score = np.bincount(of, weights=(np.repeat(weights, n) * self.impacts[level][at]).astype(np.float64)).astype(np.int64)
            for d, x in zip(ids[docs].tolist(), score.tolist()):
                if x > 0:
                    if len(best) < top:
                        heapq.heappush(best, (x, -d))
                    elif (x, -d) > best[0]:
                        heapq.heapreplace(best, (x, -d))
        return opened


def impacts_of(counts: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """Impact of postings with these counts in documents of these lengths."""
    m = 25 + (75 * lengths * n) // total
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def _frequencies(index: DataFrame, asked: frozenset[bytes]) -> dict[bytes, int]:
    """Documents of each asked term: at most a row for each of a block's terms comes back."""
    shared = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in rows(batches, 16):
            for words, starts in zip(b.column("words").to_pylist(), b.column("starts").to_pylist()):
                n = np.diff(_unpack(starts, np.int32))
                for i, w in enumerate(zlib.decompress(words).split(b" ")):
                    if w in shared.value:
                        found[w] += int(n[i])
        yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])

    counted = index.select("words", "starts").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {bytes(r["term"]): r["df"] for r in counted.collect()}


def _search_block(index: DataFrame, items: list[tuple], n: int, total: int, top: int) -> DataFrame:
    """(item_no, item_id, doc_id, score): candidates of each task for a block of (item_id, terms)."""
    df = _frequencies(index, frozenset(t for _, terms in items for t in terms))
    weighed = [(no, id_, [(t, c * term_weight(n, df[t])) for t, c in terms.items() if t in df]) for no, (id_, terms) in enumerate(items)]
    asked = index.sparkSession.sparkContext.broadcast([(no, id_, *zip(*ws)) for no, id_, ws in weighed if ws])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {no: [] for no, *_ in asked.value}
        for b in rows(batches, 1):
            row = {c: b.column(c)[0].as_py() for c in b.schema.names}
            number = {w: i for i, w in enumerate(zlib.decompress(row["words"]).split(b" "))}
            starts, ords, ids, lengths = _unpack(row["starts"], np.int32), _unpack(row["ords"], np.int32), _unpack(row["ids"], np.int64), _unpack(row["lengths"], np.int64)
            tree = Tree(starts, ords, impacts_of(_unpack(row["counts"], np.int32).astype(np.int64), lengths[ords], n, total), len(ids))
            for no, _, terms, weights in asked.value:
                here = [(number[t], w) for t, w in zip(terms, weights) if t in number and w]
                if here:
                    tree.search(np.array([x[0] for x in here]), np.array([x[1] for x in here]), ids, top, best[no])
        out = [(no, id_, -d, s) for no, id_, *_ in asked.value for s, d in best[no]]
        yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["item_no", "item_id", "did", "score"])

    return index.mapInArrow(run, "item_no long, item_id long, did long, score long")


def search(index: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of an index for each of items(item_id, text)."""
    spark = index.sparkSession
    stats = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text"))
    blocks = max(1, -(-(asked.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 64)).first()[0] or 0) // block_bytes))
    found = None
    for k in range(blocks) if stats["n"] else ():
        block = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about block_bytes
        part = _search_block(index, [(r["item_id"], Counter(terms_of(r["text"] and bytes(r["text"])))) for r in block], stats["n"], stats["l"], top)
        part = part.withColumn("block", F.lit(k))
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("block", "item_no").orderBy(F.desc("score"), "did"))
    return found.withColumn("rank", place).filter(F.col("rank") <= top).select("item_id", "rank", F.nullif("did", F.lit(NO_ID)).alias("doc_id"), "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def _terms_sql(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


_ORACLE = f"""WITH d AS (SELECT doc_id, {_terms_sql('text')} AS ts FROM documents),
all_ AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
p AS (SELECT doc_id, t, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, len(ts) AS size, unnest(ts) AS t FROM d) GROUP BY doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, all_ GROUP BY t, n),
i AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({_terms_sql('text')}) AS t FROM benchmark) GROUP BY item_id, t),
s AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * n) // l))))::BIGINT AS score FROM i JOIN w USING (t) JOIN p USING (t), all_ GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}"""

QUERIES = {"op11_lexical": op11_lexical}
ORACLE_SQL = {"op11_lexical": _ORACLE}
