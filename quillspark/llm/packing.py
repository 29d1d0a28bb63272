"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Two stages.  ``tokenize`` turns every text into pieces of at most ``capacity`` ids (full pieces first, the
remainder last) and keeps only lengths and digests, so no ids are shuffled.  ``pack`` deals the pieces into
random groups of bounded size and packs each group on its own: pieces in decreasing length, each into the
first open bin with room, which the tournament tree of remaining capacities finds in O(log bins).

Edge cases: a null or empty text is the one end id; a very long text is many pieces, dealt into all groups; repeated rows are packed as often as they occur; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, modest, rows, table

CAPACITY = 1024
END_ID = 0
#: Pieces in a packing group, on average; bounds what one task holds.
GROUP_PIECES = 2048
#: Entries of a worker's segment cache; a full cache stays as it is, further segments are encoded each time.
CACHE_ENTRIES = 400_000
SPECIAL = "<|endoftext|>"

PIECES = "row_uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SegmentEncoder(dict):
    """Text → little-endian uint32 ids of the byte-level BPE, as bytes.

    The pre-tokeniser never joins a space to what stands before it, unless white space stands on both its
    sides (or it ends the text after white space).  Any other text may thus be cut before every space, and the
    segments, which recur, are encoded once each.  Texts that have such a space are encoded whole; those with
    the special token go to the reference tokenizer.
    """

    unsafe = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None):
        import public_tokenizers
        import tiktoken

        ranks_path = ranks_path or re.sub(r"\.json$", ".tiktoken", tokenizer_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("segments", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.tokenizer_path, self.whole = tokenizer_path, None

    def __missing__(self, segment: str) -> bytes:
        ids = np.asarray(self.encode(segment), dtype="<u4").tobytes()
        if len(self) < CACHE_ENTRIES and len(segment) < 48:
            self[segment] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if SPECIAL in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.tokenizer_path)
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.unsafe.search(text):
            return np.asarray(self.encode(text), dtype="<u4").tobytes()
        first, *more = text.split(" ")
        return b"".join([self[first] if first else b"", *[self[s] for s in map(" ".__add__, more)]])


_encoders: dict[str, SegmentEncoder] = {}


def _encoder(path: str) -> SegmentEncoder:
    if path not in _encoders:
        _encoders[path] = SegmentEncoder(path)
    return _encoders[path]


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document (doc_id, text): see PIECES.  Pieces start at multiples of ``capacity``."""
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, uid = _encoder(tokenizer_path), (TaskContext.get().partitionId() << 40) - 1
        for b in rows(batches, 2048):
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                uid += 1
                ids = encoder.ids(text or "") + end
                n = len(ids) // 4
                out += [(uid, doc_id, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity)]
            columns = list(zip(*out))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["row_uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item; ``lengths`` must be in decreasing order and within 1..capacity.

    The tournament tree holds, at each inner node, the largest remaining capacity below it; going left
    whenever the left child has room leads to the first bin that fits.
    """
    n = len(lengths)
    size = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * size)
    bins, offsets = [0] * n, [0] * n
    for i, length in enumerate(lengths.tolist()):
        node = 1
        while node < size:
            node *= 2
            if tree[node] < length:
                node += 1
        bins[i], offsets[i] = node - size, capacity - tree[node]
        tree[node] -= length
        node //= 2
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            best = a if a > b else b
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Assign every piece of a durable PIECES table a sequence and an offset: see PACKED.

    A full piece is a sequence of its own, as first-fit decreasing would have it.  The others are dealt into groups by
    a hash of their row number and start, so neither a hot key nor a very long document fills a group.  Sequence ids
    are group * 2^24 + the bin's number, those of full pieces follow: unique, not gapless.
    """
    rest = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row_uid", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns=["row_uid", "grp"]).assign(sequence_id=(int(key[0]) << 24) + np.asarray(bins, dtype="int64"), offset=np.asarray(offsets, dtype="int64"))

    grouped = rest.withColumn("grp", F.pmod(F.xxhash64("row_uid", "start"), F.lit(groups)))
    packed = grouped.groupBy("grp").applyInPandas(one, PACKED)
    full = pieces.filter(F.col("length") >= capacity).drop("row_uid").withColumns({"sequence_id": F.monotonically_increasing_id() + F.lit(groups << 24), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack all documents; the tokenizer's file is a parameter."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    modest(docs.sparkSession)
    return pack(materialize(tokenize(docs, tokenizer_path, capacity), "pieces"), capacity)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_pack": op10_pack}
ORACLE_SQL: dict[str, str] = {}
