"""The inverted index: bounds against plain ranking, changes against a rebuilt index, fewer postings read."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import inverted as V
from quillspark.operators import rank as K


def sets(spark, rows):
    return spark.createDataFrame(rows, "doc long, tokens array<string>")


def asks(spark, rows):
    return spark.createDataFrame(rows, "prompt long, tokens array<string>")


def result(df):
    return sorted((r["prompt"], r["rank"], r["doc"], r["score"]) for r in df.collect())


def words(rng, n):
    return sorted({f"w{min(199, int(rng.paretovariate(0.6)))}" for _ in range(n)})


@pytest.mark.parametrize("gates", [(2, 0.05, 2), (1, 0.0, 1)])
def test_bounded_equals_plain(spark, monkeypatch, gates):
    rng = random.Random(3)
    docs = sets(spark, [(i, words(rng, rng.randint(0, 30))) for i in range(600)] + [(900 + i, ["w1", "w2", "rare"]) for i in range(9)])
    prompts = asks(spark, [(i, words(rng, rng.randint(1, 20))) for i in range(30)] + [(50, ["w1"]), (51, ["rare", "w1", "w2"]), (52, ["nowhere", "none"]), (53, [])])
    plain = result(K.lexical(docs, prompts, *gates).filter(F.col("rank") <= 5))
    monkeypatch.setattr(K, "PLAIN_POSTINGS", 0)
    assert result(K.lexical(docs, prompts, *gates, top=5)) == plain
    monkeypatch.setattr(V, "FIRST_SHARE", 0.95)  # a first round that finds too little
    assert result(K.lexical(docs, prompts, *gates, top=5)) == plain


def test_bounded_reads_fewer_postings(spark, monkeypatch):
    """Every document has the frequent words; they are read for no prompt that has a rare word often enough."""
    docs = sets(spark, [(i, ["the", "of", "and", f"topic{i % 50}", f"own{i}"]) for i in range(1000)])
    prompts = asks(spark, [(i, ["the", "of", "and", f"topic{i}"]) for i in range(20)])
    met, real = [], V._score

    def spy(leads, postings, *rest):
        met.append(postings.join(leads, "t").count())
        return real(leads, postings, *rest)

    plain = result(K.lexical(docs, prompts).filter(F.col("rank") <= 5))
    monkeypatch.setattr(K, "PLAIN_POSTINGS", 0)
    monkeypatch.setattr(V, "_score", spy)
    assert result(K.lexical(docs, prompts, top=5)) == plain
    assert sum(met) == 20 * 20  # of 20 * 3020 that the prompts' tokens have


def test_index_follows_changes(spark, tmp_path):
    rng = random.Random(11)
    index, now = V.Index(spark, str(tmp_path / "index"), buckets=4), {}
    prompts = asks(spark, [(i, words(rng, rng.randint(2, 15))) for i in range(15)])
    assert index.search(prompts, 5).count() == 0
    for step in range(4):
        changed = {rng.randrange(150): words(rng, rng.randint(1, 25)) for _ in range(80 if step == 0 else 25)}
        if step:
            changed |= {d: None for d in rng.sample(sorted(now), 10)} | {d: now[d] for d in rng.sample(sorted(set(now) - set(changed)), 5)} | {999: None}
        different = sum((t or None) != now.get(d) for d, t in changed.items())
        assert index.update(sets(spark, list(changed.items()))) == different
        now = {d: t for d, t in (now | changed).items() if t}
        if step == 2:
            index.compact()
            assert len(index.segments()) == 1
        assert index.size() == len(now)
        assert {r["t"]: r["df"] for r in index.frequencies().collect()} == {t: sum(t in x for x in now.values()) for x in now.values() for t in x}
        assert result(index.search(prompts, 5)) == result(K.lexical(sets(spark, list(now.items())), prompts, top=5))
    assert {(r["t"], r["doc"]) for r in index.live_postings().collect()} == {(t, d) for d, x in now.items() for t in x}
    assert index.update(sets(spark, list(now.items()))) == 0  # nothing changed, nothing written
    assert len(index.segments()) == 2


def test_one_of_two_writers_commits(spark, tmp_path):
    index = V.Index(spark, str(tmp_path / "index"), buckets=2)
    index.update(sets(spark, [(1, ["a", "b"])]))
    other = V.Index(spark, index.path, buckets=2)
    other._next = lambda n=index._next(): n  # it looked before the first one committed
    index.update(sets(spark, [(2, ["b", "c"])]))
    with pytest.raises(V.Conflict):
        other.update(sets(spark, [(3, ["c", "d"])]))
    assert {r["doc"] for r in index.documents().collect()} == {1, 2} and index.size() == 2


def test_search_reads_asked_folders(spark, tmp_path):
    index = V.Index(spark, str(tmp_path / "index"), buckets=16)
    index.update(sets(spark, [(i, [f"t{i}", f"u{i}"]) for i in range(200)]))
    files = lambda df: len(df.inputFiles())
    every = files(index.postings())
    bucket = spark.sql("SELECT cast(pmod(xxhash64('t7'), 16) AS int)").first()[0]
    assert every >= 14 and files(index.postings().filter(F.col("bucket") == bucket)) <= every
    plan = index.postings().filter(F.col("bucket") == bucket)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert result(index.search(asks(spark, [(1, ["t7", "u7"])]), 5)) == [(1, 1, 7, result(index.search(asks(spark, [(1, ["t7", "u7"])]), 5))[0][3])]
