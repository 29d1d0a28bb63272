"""Incremental processing: ledgers, pending sets, two-level gates, upserts and supersession, as anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_keys(rows: DataFrame, ledger: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key the ledger lacks, one for each key."""
    return rows.join(ledger.select(key), key, "left_anti").dropDuplicates([key])


def pending(raw: DataFrame, synthed: DataFrame, only: str | None = None, since: str | None = None) -> DataFrame:
    """Raw notes(name, hash) without an equal (name, hash) in ``synthed``; names are filtered first."""
    if only is not None:
        raw = raw.filter(F.col("name") == only)
    if since is not None:
        raw = raw.filter(F.col("name") >= since)
    return raw.join(synthed, ["name", "hash"], "left_anti")


def two_level_gate(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files(stat_key, content_key, ...) that are new by their cheap key and then by their content."""
    return new_keys(new_keys(files, ledger.withColumnRenamed("key", "stat_key"), "stat_key"), ledger.withColumnRenamed("key", "content_key"), "content_key")


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key by ``order`` (columns, latest first)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``changes`` in the place of those with equal keys."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def cache_plan(pages: DataFrame, cache: DataFrame, model: str, force: bool = False) -> DataFrame:
    """pages(slug, hash) with ``action``: reuse if the cache(slug, hash, model) has the same hash and model, else embed."""
    c = cache.select("slug", F.col("hash").alias("_hash"), F.col("model").alias("_model"))
    same = (F.col("hash") == F.col("_hash")) & (F.col("_model") == model) & F.lit(not force)
    return pages.join(c, "slug", "left").withColumn("action", F.when(same, "reuse").otherwise("embed")).drop("_hash", "_model")
