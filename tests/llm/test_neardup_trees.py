"""The near-duplicate stage searches by the fingerprints and trees of op8, and loses no pair that these miss."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillspark.llm import neardup, simhash
from tests.llm.test_neardup import kept, shingles


def test_stage_asks_the_trees(spark, sf_dir, monkeypatch):
    rng = random.Random(3)
    rows = []
    for k in range(30):
        w = [f"w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((10 * k, " ".join(w)))
        for c in range(1, 4):
            rows.append((10 * k + c, " ".join(w[: 300 - c])))
    seen = []

    def spy(*args, **kwargs):
        seen.append(simhash.links(*args, **kwargs).localCheckpoint())
        return seen[-1]

    monkeypatch.setattr(neardup, "tree_links", spy)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.stage_near_duplicates(spark, df, sf_dir).collect())
    assert got == kept(sorted(rows)) == [10 * k for k in range(30)]
    assert len(seen) == 1 and seen[0].count() >= 60


@pytest.mark.parametrize("radius,leaf_size", [(2, 512), (2, 4), (5, 1024), (5, 8)])
def test_links_connect_exactly(spark, radius, leaf_size):
    rng = random.Random(7)
    prints = {0}
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(6):
            prints.add(p)
            for b in rng.sample(range(64), rng.randrange(1, 8)):
                p ^= 1 << b
    prints |= {1 << b for b in range(64)}
    x = np.array(sorted(prints), dtype=np.uint64)
    df = spark.createDataFrame([(int(p),) for p in x.view(np.int64)], "fp long")

    def classes(pairs):
        root = {int(p): int(p) for p in x.view(np.int64)}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {p: find(p) for p in root}

    near = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius)
    want = classes([(int(x[i].view(np.int64)), int(x[j].view(np.int64))) for i, j in near])
    found = [(r["a"], r["b"]) for r in simhash.links(df, leaf_size=leaf_size, radius=radius).collect()]
    assert classes(found) == want
    if radius == 5:
        signed = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
        assert all(signed(a, b) <= radius for a, b in found)


def test_the_sign_bit_is_a_bit():
    prints = [5, 5 ^ 1 ^ -(2**63), *(int(h) for h in np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 10))]
    (batch,) = simhash._leaf_links([pa.record_batch([pa.array([prints], pa.list_(pa.int64()))], names=["prints"])])
    assert batch.to_pylist() == [{"a": prints[0], "b": prints[1]}]


def test_shingle_hashes_stand_for_shingles():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abAB") for _ in range(n)) for n in [0, 1, 4, 5, 5, 6, 9, 60, 300]]
    of = {}
    for t in texts:
        h = neardup.shingles(t)
        assert len(h) == len(shingles(t)) and (h[1:] > h[:-1]).all()
        for g in shingles(t):
            (one,) = neardup.shingles(" ".join(g))
            assert of.setdefault(one, g) == g and one in h


def test_short_signatures_never_part_similar_sets(spark):
    rng = np.random.default_rng(2)
    rows = []
    for n in (3, 40, 300, 3000):
        h = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        most = len(h) // 9
        other = np.unique(np.concatenate([h[most:], rng.integers(-(2**63), 2**63 - 1, most)]))
        rows.append((len(h), len(other), neardup.parity(h, 512).tolist(), neardup.parity(other, 512).tolist()))
    df = spark.createDataFrame(rows, "n int, m int, x array<long>, y array<long>")
    assert df.filter(~neardup.may_meet(*map(F.col, "nmxy"))).count() == 0
