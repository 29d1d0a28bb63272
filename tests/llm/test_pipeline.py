"""The corpus pipeline, stage by stage, against plain statements of what each stage does."""

from collections import Counter

import corpus_pipeline
from quillspark.llm import decontaminate, langid, secrets
from quillspark.llm.common import table
from tests.llm import cases
from tests.llm.test_neardup import kept


def test_stages_on_the_smallest_table(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf_dir).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert after.columns == columns
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        old = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert ids <= old
        if name == "language_id":
            judged = {r["doc_id"]: r for r in langid.identify(before).collect()}
            assert ids == {i for i, r in judged.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE}
        elif name == "near_duplicates":
            assert sorted(ids) == kept(sorted((r["doc_id"], r["text"]) for r in before.collect())) and after.count() == len(ids)
        elif name == "decontamination":
            leaks = {r["doc_id"] for r in decontaminate.find(before, table(spark, sf_dir, "benchmark")).collect()}
            assert ids == old - leaks and leaks
        elif name == "secrets":
            assert ids == old
            values = {(r["doc_id"], r["value"]) for r in secrets.scan(before).collect() if r["is_secret"]}
            texts = {r["doc_id"]: r for r in after.collect()}
            assert all(v not in texts[i]["text"] for i, v in values) and all(r["n_chars"] == len(r["text"]) for r in texts.values())
        else:
            assert ids == old and Counter(after.columns)["sequence_id"] == 1
        before = after
    assert corpus_pipeline.run(spark, sf_dir).count() == before.count()


def test_awkward_rows(spark, sf_dir):
    docs = cases.documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        ids = [r["doc_id"] for r in stage(spark, docs, sf_dir).select("doc_id").collect()]
        assert ids and set(ids) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        empty = stage(spark, cases.empty(spark), sf_dir)
        assert empty.count() == 0
