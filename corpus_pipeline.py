"""Training-data pipeline: language ID, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's ``docs``; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, langid, neardup, packing, secrets
from quillspark.llm.common import free, materialize, table

#: A document whose best language explains less of its n-grams is in none of the learned languages.
LEAST_SCORE = 0.2


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts without letters and unknown languages go."""
    predict = langid.predictor(spark, langid.train(docs))
    lang = free(docs, "_lang")
    judged = docs.withColumn(lang, predict(F.col("text").cast("string")))
    return judged.filter((F.col(lang)["lang_pred"] != langid.UND) & (F.col(lang)["score"] >= LEAST_SCORE)).drop(lang)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: five-word shingles, Jaccard similarity 0.8 or more."""
    return neardup.keep_one(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts."""
    return secrets.redact(docs)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", stage_language),
    ("near_duplicates", stage_near_duplicates),
    ("decontamination", stage_decontaminate),
    ("secrets", stage_secrets),
    ("packing", stage_pack),
]

#: SQL has no tokenizer, forest or fingerprint for these stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
