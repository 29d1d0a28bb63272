"""op11: trees against plain sums, bounds, shards of every size, awkward rows."""

import random
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import lexical
from tests.llm import cases


def plain_ranking(docs, items, top=10):
    """(item_id, rank, doc_id, score) by the contract's formula; null ids are last among ties."""
    counted = [(i, Counter(lexical.terms_of(t.encode()))) for i, t in docs if t is not None and lexical.terms_of(t.encode())]
    n, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counted:
            m = 25 + (75 * c.total() * n) // total
            score = sum(lexical.term_weight(n, df[t]) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in lexical.terms_of((text or "").encode()) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(found)[:top], 1)]
    return out


def test_terms():
    assert lexical.terms_of("A-b_C1 Ümläut, İx\x00y's".encode()) == [x.encode() for x in ("a", "b", "c1", "Ümläut", "İx", "y", "s")]
    assert lexical.terms_of(None) == [] == lexical.terms_of(b" -- ")


@pytest.mark.parametrize("n_docs", [1, 2, 31, 32, 33, 100, 1000])
def test_tree_equals_plain_sums_and_prunes(n_docs):
    rng = np.random.default_rng(n_docs)
    lists = [np.sort(rng.choice(n_docs, rng.integers(1, n_docs + 1), replace=False)) for _ in range(12)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    ords, impacts = np.concatenate(lists).astype(np.int32), rng.integers(1, 900, starts[-1])
    ids = np.sort(rng.choice(10 * n_docs, n_docs, replace=False))
    tree = lexical.Tree(starts, ords, impacts, n_docs, leaf_bits=2)
    for _ in range(20):
        terms, weights = rng.choice(12, 4, replace=False), rng.integers(1, 50, 4)
        want = np.zeros(n_docs, dtype=np.int64)
        for t, w in zip(terms, weights):
            np.add.at(want, ords[starts[t] : starts[t + 1]], w * impacts[starts[t] : starts[t + 1]])
        best = []
        opened = tree.search(terms, weights, ids, 5, best)
        order = sorted((-int(x), int(i)) for x, i in zip(want, ids) if x > 0)[:5]
        assert sorted((-s, -d) for s, d in best) == order
        assert opened <= 2 * (1 << max(1, (n_docs - 1).bit_length()))
    if n_docs == 1000:  # one document stands out: only its path and few others are opened
        one = np.array([int(np.argmax(np.bincount(ords, minlength=n_docs)))])
        high = np.where(np.isin(ords, one), 100_000, impacts)
        assert lexical.Tree(starts, ords, high, n_docs, leaf_bits=2).search(np.arange(12), np.ones(12, dtype=np.int64), ids, 1, []) < 40


def test_search_equals_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)] + [(5, docs[5][1]), (5, "w1 w2 w3"), (None, docs[5][1]), (None, None)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 20)))) for i in range(25)] + [(50, docs[5][1]), (None, "w1 w1 w9"), (51, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(repr, plain_ranking(docs, items)))
    for size in (7, 64, 4096):
        index = lexical.build_index(frame, shard_docs=size)
        for block in (1 << 25, 600):  # one block of items, and several
            got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(index, asked, block_bytes=block).collect()]
            assert sorted(map(repr, got)) == want


def test_shards_are_bounded(spark):
    docs = spark.createDataFrame([(i, " ".join(f"t{i * 7 + j}" for j in range(50))) for i in range(300)], "doc_id long, text string").coalesce(1)
    rows = lexical.build_index(docs, shard_postings=500).collect()
    assert sum(r["n_docs"] for r in rows) == 300 and max(r["n_docs"] for r in rows) == 10


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical.search(lexical.build_index(cases.empty(spark)), items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(lexical.build_index(cases.documents(spark)), none).count() == 0
