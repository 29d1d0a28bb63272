"""Sharding: rendezvous (highest random weight) hashing of record keys over weighted shards.

Every shard draws a score ``-weight / ln(u)`` for a key, u being a uniform hash of (key, shard); the highest
score wins.  Key and shard set alone decide, so a further shard takes rows only into itself.  ``slot`` numbers
the rows of a shard without gaps; shards are cut into buckets of bounded size, whose offsets come from counts,
so no task ever holds a shard.

Edge cases: a null key is a key like any other; a null text has size 16 and the digest of the empty text;
repeated rows get a slot each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, table

SHARDS = 40
#: Rows of a bucket in which slots are counted by a window, on average.
BUCKET_ROWS = 20_000


def score(key: Column, shard: Column, weight: Column) -> Column:
    """Draw of one shard for one key; u is in (0, 1) with 52 bits."""
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -weight / F.log(u)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """struct(score, shard) of the winning shard; ties, which need equal 52-bit draws, go to the higher number."""
    table_ = F.array(*[F.struct(F.lit(j).alias("shard"), F.lit(float(w)).alias("weight")) for j, w in enumerate(weights)])
    return F.array_max(F.transform(table_, lambda s: F.struct(score(key, s["shard"], s["weight"]).alias("score"), s["shard"].alias("shard"))))


def assign_shards(docs: DataFrame, weights: list[float], grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard) for every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = len(weights)
    narrow = (
        docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), rendezvous(F.col("doc_id"), weights).alias("won"))
        .withColumn("shard", F.col("won.shard"))
        .withColumn("grown_shard", F.when(score(F.col("doc_id"), F.lit(n), F.lit(float(grown_weight))) > F.col("won.score"), F.lit(n)).otherwise(F.col("won.shard")))
        .drop("won")
        .withColumn("rid", F.monotonically_increasing_id())
    )
    fixed = materialize(narrow, "shards")
    buckets = max(1, -(-fixed.count() // (n * BUCKET_ROWS)))
    dealt = fixed.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets)))
    counts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("rid")) - 1
    return (
        dealt.withColumn("inside", inside)
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), (F.col("first") + F.col("inside")).cast("long").alias("slot"), F.col("grown_shard").cast("int"))
    )


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


QUERIES = {"op7_shard": op7_shard}
ORACLE_SQL: dict[str, str] = {}
