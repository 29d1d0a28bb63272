"""Operators on small cases: components, similarity joins, ranking, incremental processing, models."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import graph, incremental, rank, simjoin
from quillspark.operators.components import components
from quillspark.plans import models


def test_components_random(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for n in {x for e in edges for x in e}:
        seen, todo = {n}, [n]
        while todo:
            x = todo.pop()
            for a, b in edges:
                for p, q in ((a, b), (b, a)):
                    if p == x and q not in seen:
                        seen.add(q)
                        todo.append(q)
        root[n] = min(seen)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: r for n, r in root.items() if n in linked}


@pytest.mark.parametrize("run,few", [(1 << 18, 32 << 20), (4, 32 << 20), (4, 0)])
def test_components_of_a_small_table_are_written_once(spark, monkeypatch, run, few):
    from quillspark.operators import components as module

    written, write = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name: written.append(name) or write(df, name))
    monkeypatch.setattr(module, "BROADCAST_BYTES", few)
    if run < 1 << 18:  # no task sees more than a few edges of a component
        stars = module._stars
        monkeypatch.setattr(module, "_contract", lambda batches: (stars(*(c.to_numpy() for c in b.slice(k, run).columns)) for b in batches for k in range(0, b.num_rows, run)))
    rng = random.Random(11)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2400) for i in range(150)] + [(-5, -9), (-9, -7)]
    rng.shuffle(links)
    rows = [x if rng.random() < 0.5 else x[::-1] for x in links + links[:50]] + [(7, 7), (None, 3), (3, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    want = dict.fromkeys(range(201), 0) | dict.fromkeys(range(1000, 1200), 1000) | dict.fromkeys([*range(2000, 2150), 2400], 2000) | dict.fromkeys([-5, -7, -9], -9)
    assert got == want
    assert run < 1 << 18 or written == ["edges"]
    assert few or "star" in written


def test_components_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_pairs_brute_force(spark):
    rng = random.Random(3)
    sets = {i: sorted({f"t{rng.randrange(12)}" for _ in range(rng.randrange(1, 8))}) for i in range(40)}
    df = spark.createDataFrame(list(sets.items()), "id long, tokens array<string>")
    got = {(r["a"], r["b"]) for r in simjoin.jaccard_pairs(df, 0.6).collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(tuple(sets[i]), i)
    want = {(first[tuple(s)], i) for i, s in sets.items() if first[tuple(s)] != i}
    reps = sorted(first.values())
    want |= {(a, b) for a, b in itertools.combinations(reps, 2) if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.6}
    assert got == want
    with pytest.raises(ValueError):
        simjoin.jaccard_pairs(df, 0)


def test_cosine_pairs_dims_and_blocks(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "id long, vec array<double>")
    got = {(r["a"], r["b"]) for r in simjoin.cosine_pairs(v, 0.75, block_rows=1).collect()}
    assert got == {(1, 2), (1, 3)}
    mixed = v.unionByName(spark.createDataFrame([(9, [1.0])], "id long, vec array<double>"))
    assert simjoin.cosine_pairs(mixed, 0.1).count() == 0


def test_lexical_gates_and_ties(spark):
    docs = spark.createDataFrame([(1, ["aa", "bb"]), (2, ["aa", "bb"]), (3, ["aa"]), (4, [])], "doc long, tokens array<string>")
    prompts = spark.createDataFrame([(1, ["aa", "bb"]), (2, ["aa"])], "prompt long, tokens array<string>")
    got = [(r["prompt"], r["doc"], r["rank"]) for r in rank.lexical(docs, prompts).orderBy("prompt", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 2)]


def test_rrf_sides(spark):
    a = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 0.5, 2)], "prompt long, doc long, score double, rank int")
    b = spark.createDataFrame([(1, 12, 1.0, 1), (1, 11, 0.5, 2)], "prompt long, doc long, score double, rank int")
    assert [r["doc"] for r in rank.rrf(a, b, 20, "first").orderBy("rank").collect()] == [11, 10]
    assert [r["doc"] for r in rank.rrf(a, b, 20).orderBy("rank").collect()] == [11, 10, 12]


def test_hybrid_branches(spark):
    schema = "prompt long, doc long, score double, rank int"
    lex = spark.createDataFrame([(1, 10, 1.0, 1), (3, 30, 1.0, 1)], schema)
    sem = spark.createDataFrame([(1, 10, 1.0, 1), (2, 20, -0.5, 1)], schema)
    got = {(r["prompt"], r["doc"]) for r in rank.hybrid(lex, sem).collect()}
    assert got == {(1, 10), (2, 20), (3, 30)}


def test_zero_vector_normalises_to_itself(spark):
    v = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    assert v.select(rank.normalize(F.col("v")).alias("u")).first()["u"] == [0.0, 0.0]


def test_pending_and_upsert(spark):
    raw = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "name string, hash string")
    done = spark.createDataFrame([("a", "1"), ("b", "old")], "name string, hash string")
    assert sorted(r["name"] for r in incremental.pending(raw, done).collect()) == ["b", "c"]
    assert [r["name"] for r in incremental.pending(raw, done, only="c").collect()] == ["c"]
    assert [r["name"] for r in incremental.pending(raw, done, since="c").collect()] == ["c"]
    got = {tuple(r) for r in incremental.upsert(raw, done, "name").collect()}
    assert got == {("a", "1"), ("b", "old"), ("c", "3")}


def test_prune_links(spark):
    p = spark.createDataFrame([(1, "[[A b]] [[A b|x]] [[zz]]")], "ord long, body string")
    valid = spark.createDataFrame([("a-b",)], "slug string")
    assert graph.prune_links(p, valid).first()["body"] == "[[A b]] A b|x zz"


def test_relink_targets(spark):
    p = spark.createDataFrame([("a", "[[b]]"), ("b", ""), ("c", "<!-- quill-relink -->"), ("d", "[[d]]")], "slug string, body string")
    e = graph.link_edges(p)
    assert sorted(r["slug"] for r in graph.relink_targets(p, e).collect()) == ["c", "d"]
    assert sorted(r["slug"] for r in graph.relink_targets(p, e, all_pages=True).collect()) == ["a", "b", "c", "d"]


def test_breaker_and_stub(spark):
    def broken(prompts):
        raise OSError("down")

    df = spark.createDataFrame([("One two. Three",)], "prompt string")
    assert models.complete(df, "prompt", broken).first()["reply"] is None
    assert models.complete(df, "prompt").first()["reply"] == "## One two. Three\n\nOne two."


def test_embed_incremental_reuses(spark):
    pages = spark.createDataFrame([("a", "x y"), ("b", "z")], "slug string, text string")
    first = models.embed_incremental(pages, spark.createDataFrame([], "slug string, hash string, model string, vec array<double>"))
    cache = spark.createDataFrame([(r["slug"], r["hash"], r["model"], [9.0]) for r in first.collect() if r["slug"] == "a"], "slug string, hash string, model string, vec array<double>")
    got = {r["slug"]: r["vec"] for r in models.embed_incremental(pages, cache).collect()}
    assert got["a"] == [9.0] and len(got["b"]) == models.DIM


def test_resolve_tiers(spark):
    e = spark.createDataFrame([("f", "t", "d"), (None, "t", "d"), (None, None, "d"), (None, None, None), ("f", None, "cpf e telefone")], "file_text string, tool_text string, description string")
    assert [r["method"] for r in models.resolve(e).collect()] == ["file", "tool", "description", "unresolved", "sensitive"]


def test_cosine_in_blocks(spark, monkeypatch):
    import numpy as np

    from quillspark.operators import rank

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4 if i % 9 else 3)]) for i in range(300)] + [(400, [0.0] * 4), (401, [])]
    vectors = spark.createDataFrame(rows, "doc long, vec array<double>")
    queries = vectors.filter("doc % 20 = 0").withColumnRenamed("doc", "prompt")
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows}
    want = set()
    for q in unit:
        if q % 20 == 0:
            found = sorted((-round(float(unit[q] @ np.array(v)), 6), i) for i, v in rows if len(v) == len(unit[q]))[:7]
            want |= {(q, i, round(-s, 5), k + 1) for k, (s, i) in enumerate(found)}
    for limit in (None, False):
        if limit is False:
            monkeypatch.setattr(rank, "small", lambda *_: False)
            monkeypatch.setattr(rank, "BLOCK_ROWS", 64)
        got = {(r["prompt"], r["doc"], round(r["score"], 5) + 0.0, r["rank"]) for r in rank.cosine(vectors, queries, 7).collect()}
        assert got == {(a, b, s + 0.0, k) for a, b, s, k in want}
