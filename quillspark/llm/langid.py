"""Language identification with a bit-sliced Bloom filter of character n-grams.

One table of language bitmasks serves all languages: an n-gram sets the bit of every language it is typical of
in each of its slots, and the AND over its slots is the set of languages that (probably) contain it.  A text's
hits per language are the popcounts of those masks, bit by bit, corrected for the false positives expected
from that language's fill; the language with the highest corrected share of n-grams wins.

Training reads at most about ``max_docs`` labelled rows, chosen by a hash of the key (a documented bound of the
classifier); prediction reads every whole text.

Edge cases: a null text or one without letters is ``und`` with score 0; a text with letters gets a learned
language even if no n-gram is known (ties go to the first in alphabetical order); without labelled rows all
is ``und``; a language of few labelled rows keeps all its n-grams; very long texts are read in pieces of CHUNK
characters or the text, whichever is longer; a null doc_id is never trained on; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import chunks, materialize, modest, table
from quillspark.llm.common import rows as cut

#: Bound of the training sample (rows) and of the filter (slots of 8 bytes; 16 MB for each 64 languages).
MAX_DOCS = 20_000
SLOTS = 1 << 21
#: Languages of one bit plane; more take more planes.
PLANE = 64
#: Times an n-gram must be seen in a language to be kept, once the language has so many labelled rows.
MIN_COUNT, ENOUGH = 3, 100
#: Most n-grams of all languages and characters hashed at a time, which bound the driver and a task.  Beyond MOST_GRAMS
#: the languages share it evenly: one with fewer than its share keeps all of its n-grams, others their oftenest.
MOST_GRAMS, CHUNK = 1 << 20, 1 << 18
#: An n-gram belongs to a language if its relative frequency there is at least this share of its highest one.
TYPICAL = 0.2
UND = "und"

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_space = np.uint64(32)
_lower: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point → its lower-case letter, or a space for what is no letter."""
    if not _lower:
        t = np.full(0x110000, 32, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _lower.append(t)
    return _lower[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _A
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(31))


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 3- and 4-grams inside words (one space of margin allowed), and the text each is from."""
    padded = [f" {t} \0" for t in texts]
    raw = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in padded])
    c = _letters()[raw]
    c[np.cumsum([len(p) for p in padded]) - 1] = 0
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c, owner = c[keep].astype(np.uint64), owner[keep]
    if len(c) < 4:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    inner, end = (c != _space) & (c != 0), c != 0
    tri = c[:-2] | (c[1:-1] << np.uint64(21)) | (c[2:] << np.uint64(42))
    ok3 = inner[1:-1] & end[:-2] & end[2:]
    ok4 = ok3[:-1] & inner[2:-1] & end[3:]
    quad = tri[:-1][ok4] * _B + c[3:][ok4] + np.uint64(1)
    return _mix(np.concatenate([tri[ok3], quad])), np.concatenate([owner[:-2][ok3], owner[:-3][ok4]])


def _slots(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(n - 1)
    return (h & low).astype(np.int64), ((h >> np.uint64(40)) & low).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    #: Slots of language bits; with more than PLANE languages one row of slots for each PLANE of them.
    masks: np.ndarray

    def planes(self) -> np.ndarray:
        return self.masks if self.masks.ndim == 2 else self.masks[None]

    def fill(self) -> np.ndarray:
        """Expected false positive rate of each language: both slots set by chance."""
        p = self.planes()
        kind = p.dtype.type
        return np.array([np.mean((p[i // PLANE] >> kind(i % PLANE)) & kind(1)) ** 2 for i in range(len(self.languages))])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        n, k = len(texts), len(self.languages)
        pred, score, total = [UND] * n, np.zeros(n), np.zeros(n, dtype=np.int64)
        rate = self.fill() if k else np.zeros(0)
        for a, b in chunks(texts, CHUNK):
            part = [t or "" for t in texts[a:b]]
            h, owner = ngrams(part)
            count = np.bincount(owner, minlength=b - a)
            total[a:b] = count
            if not k:
                continue
            s1, s2 = _slots(h, self.masks.shape[-1])
            counts = []
            for j, plane in enumerate(self.planes()):
                hit = plane[s1] & plane[s2]
                counts += [np.bincount(owner, weights=((hit >> hit.dtype.type(i)) & hit.dtype.type(1)), minlength=b - a) for i in range(min(PLANE, k - PLANE * j))]
            popcount = np.stack(counts, axis=1)
            share = np.clip((popcount / np.maximum(count, 1)[:, None] - rate) / (1 - np.minimum(rate, 0.999)), 0, 1)
            best = share.argmax(axis=1)
            score[a:b] = share[np.arange(b - a), best]
            for i, t in enumerate(part):
                if count[i] or any(map(str.isalpha, t)):
                    pred[a + i] = self.languages[best[i]]
                else:
                    score[a + i] = 0.0
        return pred, score, total


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def even_share(sizes: list[int], most: int) -> int:
    """The largest share such that sizes cut to it sum to ``most`` at most (the largest size if they all fit)."""
    left = most
    for i, size in enumerate(ordered := sorted(sizes)):
        if size * (len(ordered) - i) > left:
            return left // (len(ordered) - i)
        left -= size
    return max(sizes, default=0)


def oftenest(grams: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of grams(lang, gram, n): the oftenest of each language up to an even share."""
    sizes = {r["lang"]: r["c"] for r in grams.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).collect()}  # a row a language
    share = even_share(list(sizes.values()), most)
    if all(c <= share for c in sizes.values()):
        return grams
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return grams.withColumn("place", place).filter(F.col("place") <= share).drop("place")


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> LanguageModel:
    """Fit on labelled rows that are not held out; a hash threshold on the key keeps about ``max_docs`` of them."""
    modest(docs.sparkSession)
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    share = min(1.0, max_docs / max(1, rows.count()))
    rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts, CHUNK):
                for lang in sorted(set(langs[a:b])):
                    h, n = np.unique(ngrams([t or "" for t, x in zip(texts[a:b], langs[a:b]) if x == lang])[0], return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("c"), F.max(F.coalesce("text", F.lit("")).rlike(r"\p{L}")).alias("any")).toPandas()
    seldom = [r.lang for r in counted.itertuples() if r.c < ENOUGH]
    grams = rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = materialize(grams.filter((F.col("n") >= MIN_COUNT) | F.col("lang").isin(seldom)), "language-grams")
    found = oftenest(grams, MOST_GRAMS).toArrow().to_pandas()
    languages = sorted(r.lang for r in counted.itertuples() if r.any)
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    planes = np.zeros((max(1, -(-len(languages) // PLANE)), SLOTS), dtype=kind)
    if languages:
        wide = found[found["lang"].isin(languages)]
        rel = wide["n"] / wide.groupby("lang")["n"].transform("sum")
        wide = wide[rel >= TYPICAL * rel.groupby(wide["gram"]).transform("max")]
        for i, lang in enumerate(languages):
            h = wide.loc[wide["lang"] == lang, "gram"].to_numpy().astype(np.int64).view(np.uint64)
            for s in _slots(h, SLOTS):
                planes[i // PLANE][s] |= kind(1 << i % PLANE)
    return LanguageModel([str(x) for x in languages], planes if len(planes) > 1 else planes[0])


def predictor(spark: SparkSession, model: LanguageModel):
    """Column function text → struct(lang_pred, score, n_grams); the model's size is bounded by SLOTS."""
    modest(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, n_grams long")
    def predict(texts: pd.Series) -> pd.DataFrame:
        pred, score, total = shared.value.predict(texts.where(texts.notna(), None).tolist())
        return pd.DataFrame({"lang_pred": pred, "score": score, "n_grams": total})

    return predict


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_grams of every row."""
    predict = predictor(docs.sparkSession, model or train(docs))
    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text").cast("string")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score", "p.n_grams")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op1_langid": op1_langid}
ORACLE_SQL: dict[str, str] = {}
