"""The pipeline's near-duplicate stage against brute force over five-word shingles."""

import random

import corpus_pipeline
import pytest
from quillspark.llm import neardup
from quillspark.llm.common import table
from tests.llm import cases


def shingles(text):
    w = cases.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(min(r[0] for k, r in enumerate(rows) if find(k) == c) for c in {find(k) for k in range(len(rows))})


@pytest.mark.parametrize("crowd,stars", [(64, 2), (2, 1)])
def test_stage_keeps_one_of_near_copies(spark, sf_dir, monkeypatch, crowd, stars):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(neardup, "STARS", stars)
    rng = random.Random(5)
    rows = []
    for _ in range(40):
        w = [f"{rng.choice('abcdef')}{rng.randrange(300)}" for _ in range(rng.choice([3, 6, 30, 120, 400]))]
        rows.append(list(w))
        for _ in range(4):
            w = list(w)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10_000)}"
            rows.append(w + ["all rights reserved by the makers of this text"] * rng.randrange(2))
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(1000, None), (1001, ""), (1002, "A0 b"), (1003, "a0  B")]
    rng.shuffle(rows)
    want = kept(sorted(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.stage_near_duplicates(spark, df, sf_dir).collect())
    assert got == want and len(want) < 150


def test_stage_on_the_smallest_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = kept(sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()))
    got = corpus_pipeline.stage_near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == want
