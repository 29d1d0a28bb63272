"""Importance resampling towards a target distribution, by hashed n-gram features.

A document's features (runs of words) are hashed into buckets.  How much likelier a bucket is in the target than
in the corpus is its gain; a document's weight is the mean gain of its features, and adding Gumbel noise that the
document's id decides to the weights and taking the largest sums draws documents without replacement.

Scoring explodes nothing: higher-order functions turn a text into its array of buckets, and the weight folds over
``element_at`` of the gains, a literal array of one entry a bucket.  The bucket arrays are written once and read
for the totals and for the scores.  Only sums of a bucket, counts of a score and the drawn ids are shuffled.

The draw needs the place of each drawn row in the order of all.  Scores are whole numbers of a bounded range, so a
table of the rows of each score (at most SCORES entries) gives the rows before a score, and only rows of one score,
a small share of all since the noise spreads them, are put in order among themselves.

Edge cases: null, empty and wordless texts have no features, weight 0, and are never drawn for having too few words;
a null doc_id has no noise, hence a null score, and is never drawn; a very long text is one array of its words;
repeated rows are scored alike and drawn as rows of their own; ties go to the smaller doc_id, then to fewer
features; an empty corpus gives no rows, an empty target leaves the corpus alone to decide; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, table

BUCKETS, MAX_RUN, LEAST_WORDS, SEED = 10_000, 1, 20, 2024
#: Drawn documents are SHARE / OF of those with enough words.
SHARE, OF = 10, 100
#: Bound of distinct scores: a gain is within 1000 * ln(2^64) of 0, the noise between -3,200 and 22,900.
SCORES = 2 * 44_362 + 26_100

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII that is no letter or digit separates words.
_GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def feature_words(text: Column) -> Column:
    """Array of the words of a text, A-Z lower-cased; empty for null."""
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER + _GAPS, _LOWER + " " * len(_GAPS))
    return F.array_remove(F.split(spaced, " "), "")


def _starts(words: Column, n: int) -> Column:
    """Array of the places, from 1, at which runs of ``n`` words start."""
    last = F.size(words) - n + 1
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def buckets_of(words: Column, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> Column:
    """Array of the buckets, numbered from 1, of all runs of 1 to ``max_run`` consecutive words, repeats included."""
    hashed = lambda run: (F.crc32(run.cast("binary")) % buckets + 1).cast("int")
    longer = lambda n: F.transform(_starts(words, n), lambda i: hashed(F.array_join(F.slice(words, i, F.lit(n)), " ")))
    runs = [F.transform(words, hashed), *map(longer, range(2, max_run + 1))]
    return F.concat(*runs) if max_run > 1 else runs[0]


def _featured(df: DataFrame, key: str | None, max_run: int, buckets: int) -> DataFrame:
    key_column = F.lit(None).cast("long") if key is None else F.col(key).cast("long")
    worded = df.select(key_column.alias("doc_id"), feature_words(F.col("text")).alias("words"))
    return worded.select("doc_id", F.size("words").alias("n_words"), buckets_of(F.col("words"), max_run, buckets).alias("buckets"))


def totals(featured: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket over all rows: one entry a bucket, summed in the map tasks before the shuffle."""
    found = np.zeros(buckets, dtype=np.int64)
    for r in featured.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():
        found[r["b"] - 1] = r["n"]
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket in the target and in the corpus."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = ((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)) for s, t in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, decided by seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scores(featured: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of featured rows."""
    literal = F.lit(gain)
    n = F.size("buckets")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.element_at(literal, b))
    summed = featured.select("doc_id", "n_words", n.cast("long").alias("n_features"), total.alias("total"))
    mean = F.when(F.col("n_features") > 0, F.floor((F.col("total") - F.pmod("total", "n_features")) / F.col("n_features"))).otherwise(0).cast("long")
    return summed.withColumn("weight", mean).select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, share: int = SHARE, of: int = OF) -> DataFrame:
    """``scored`` (a durable table) with ``rank``: 1, 2, 3 ... of the drawn rows by falling score, null for the others."""
    able = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    wanted = share * scored.filter(able).count() // of
    each = scored.filter(able).groupBy(F.col("score").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    # one task over at most SCORES rows, whatever the size of the corpus
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = materialize(each.select("s", before.alias("before")).filter(F.col("before") < wanted), "score-places")
    known = scored.withColumn("able", able).join(F.broadcast(places), F.col("able") & (F.col("score") == F.col("s")), "left")
    inside = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features"))
    reached = known.filter(F.col("before").isNotNull()).withColumn("place", F.col("before") + inside)
    columns = ["doc_id", "n_features", "weight", "score"]
    first = reached.select(*columns, F.when(F.col("place") <= wanted, F.col("place")).cast("long").alias("rank"))
    return first.unionAll(known.filter(F.col("before").isNull()).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, share: int = SHARE, of: int = OF, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs(doc_id, text), drawn towards target(text)."""
    featured = materialize(_featured(docs, "doc_id", max_run, buckets), "features")
    gain = gains(totals(featured, buckets), totals(_featured(target, None, max_run, buckets), buckets))
    return draw(materialize(scores(featured, gain, seed), "scores"), least_words, share, of)


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# crc32 by its bytewise table, which the polynomial gives; words repeat, so each is hashed once
_CRC = """crc(c) AS (SELECT list(v ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END) AS v FROM (SELECT unnest(range(256)) AS i)))"""


def _words_sql(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _oracle() -> str:
    octets = "list_transform(range(len(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda a, x: xor(c[(xor(a, x) % 256) + 1], a // 256)))"
    return f"""WITH {_CRC},
d AS (SELECT row_number() OVER () AS r, doc_id, {_words_sql('text')} AS ws FROM documents),
dw AS (SELECT r, unnest(ws) AS w FROM d), bw AS (SELECT unnest({_words_sql('text')}) AS w FROM benchmark),
vocabulary AS (SELECT w, ({crc}) % {BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
s AS (SELECT b, count(*) AS n FROM dw JOIN vocabulary USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM bw JOIN vocabulary USING (w) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln(((coalesce(t.n, 0) + 1) * ((SELECT sum(n) FROM s) + {BUCKETS}))::DOUBLE / ((coalesce(s.n, 0) + 1) * (coalesce((SELECT sum(n) FROM t), 0) + {BUCKETS}))::DOUBLE))::BIGINT AS g
  FROM (SELECT unnest(range({BUCKETS})) AS b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
sums AS (SELECT r, sum(g) AS total FROM dw JOIN vocabulary USING (w) JOIN gain USING (b) GROUP BY r),
weighed AS (SELECT d.r, doc_id, len(ws)::BIGINT AS n_features, CASE WHEN len(ws) > 0 THEN floor(total::DOUBLE / len(ws))::BIGINT ELSE 0 END AS weight, ('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN sums USING (r)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296.0::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= {LEAST_WORDS} AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {SHARE} * (SELECT count(*) FROM placed) // {OF} THEN place END AS rank FROM scored LEFT JOIN placed USING (r)"""


QUERIES = {"op13_resample": op13_resample}
ORACLE_SQL = {"op13_resample": _oracle()}
