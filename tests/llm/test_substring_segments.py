"""op5: windows of long repeats are not written one by one (round 3: disk over its budget), and results stay exact."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from quillspark.llm import substring
from tests.llm.test_operators import brute_repeats

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def run(spark, texts, window, gram, monkeypatch):
    """Rows of the result and rows of each intermediate table."""
    sizes, write = {}, substring.materialize

    def count(df, name):
        out = write(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(substring, "materialize", count)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return Counter(tuple(r) for r in substring.remove_repeats(df, window, gram).collect()), sizes


def test_long_repeats_write_few_windows(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(500))
    texts = [" ".join(f"a{d}_{i}" for i in range(60)) + f" {passage} " + " ".join(f"z{d}_{i}" for i in range(60)) for d in range(12)]
    got, sizes = run(spark, texts, 35, 8, monkeypatch)
    assert got == Counter((i, *x) for i, x in enumerate(brute_repeats(texts, 35)))
    # 12 * 466 windows recur; only those beside the passage's ends need a look of their own
    assert sizes["windows"] < 12 * 466 // 3
    assert spark.conf.get(CLEANUP) == "false"


@pytest.mark.parametrize("window,gram", [(35, 8), (12, 5), (6, 6), (5, 1)])
def test_segments_brute_force(spark, monkeypatch, window, gram):
    """Passages cut at any place, inside one another, repeated at once, in copies, in texts with a period."""
    rng = random.Random(window)
    pool = [[f"{k}w{rng.randrange(30)}" for _ in range(rng.randrange(window, 5 * window))] for k in range(6)]
    texts: list = ["x " * 300, "x " * 41, "a b " * 100, "a b c " * 90 + "d", None, "", "x " * window, "u v " * window + "a b " * window]
    for d in range(60):
        words: list = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(pool)
            lo = rng.randrange(len(p) // 2)
            words += p[lo : rng.randrange(lo + 1, len(p) + 1)] * rng.choice([1, 1, 1, 2])
            words += [f"n{rng.randrange(1000)}" for _ in range(rng.randrange(4))]
        texts.append(" ".join(words))
    texts += rng.sample(texts, 8) + [texts[0]]
    got, _ = run(spark, texts, window, gram, monkeypatch)
    assert got == Counter((i, *x) for i, x in enumerate(brute_repeats(texts, window)))
