"""op12: runs that cross tasks, bitmaps, awkward rows, against a plain version."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import lines
from tests.llm import cases


def plain(rows, least_chars=20, least_docs=3):
    """(doc_id, lines, dropped, digest); a null id is a document smaller than all others."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    order = lambda d: (d is not None, d or 0)
    of = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                of[key(x)].add(order(d))
    out = []
    for d, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not (len(of.get(key(x), ())) >= least_docs and order(d) < max(of[key(x)]))]
        out.append((d, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("step", [1, 2, 3, 7, 100_000])
@pytest.mark.parametrize("parts", [1, 4, 9])
def test_runs_in_batches_and_tasks(step, parts):
    """Sorted rows cut into tasks and batches at any place give the same lines."""
    rng = random.Random(step * 31 + parts)
    rows = sorted(((rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, rng.randrange(100)]), 0, -rng.randrange(30)) for _ in range(400)))
    rows = [(h, z, -d, d * 0, i) for i, (h, z, d) in enumerate(rows)]
    docs = defaultdict(set)
    for h, _, d, *_ in rows:
        docs[h].add(d)
    want = sorted((d, i) for h, _, d, _, i in rows if len(docs[h]) >= 3 and d < max(docs[h]))
    cuts = sorted(rng.sample(range(1, len(rows)), parts - 1))
    # equal (hash, document) are never cut
    cuts = [next((j for j in range(c, len(rows)) if rows[j][:3] != rows[j - 1][:3]), len(rows)) for c in cuts]
    found = []
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        runs = lines._Runs(3)
        for k in range(a, b, step):
            runs.feed(np.array(rows[k : min(b, k + step)], dtype=np.int64).reshape(-1, 5))
            found += [r for batch in runs.taken() for r in batch.to_pylist()]
        runs.end()
        found += [r for batch in runs.taken() for r in batch.to_pylist()]
    edges = defaultdict(lambda: [0, -1])
    for r in found:
        if r["kind"] == lines.EDGE:
            e = edges[r["h1"]]
            e[0], e[1] = e[0] + r["n"], max(e[1], r["did"])
    assert sum(r["kind"] == lines.EDGE for r in found) <= 2 * parts
    got = [(r["did"], r["pos"]) for r in found if r["kind"] == lines.DROP]
    got += [(r["did"], r["pos"]) for r in found if r["kind"] == lines.OPEN and edges[r["h1"]][0] >= 3 and r["did"] < edges[r["h1"]][1]]
    assert sorted(got) == want


def test_bitmaps():
    for dropped in ([0], [5], [0, 1, 2, 3], list(range(0, 5000, 3))):
        keep = lines.unpack_bits(lines.pack_bits(dropped), 5001)
        assert np.flatnonzero(~keep).tolist() == dropped
    assert lines.unpack_bits(None, 3).all() and len(lines.pack_bits(range(100_000))) < 300


def test_awkward_rows_equal_plain(spark):
    common = "A line that is in   many documents"
    rows = [(i, f"own line number {i} of this one\n{common.upper() if i % 2 else common}\n  {common}\t\nshort") for i in range(50)]
    rows += [(100, "ünïcödé zwanzig zeiche\nx"), (101, "x\n ünïcödé zwanzig zeiche"), (102, "ünïcödé zwanzig zeiche "), (103, "ÜNÏCÖDÉ ZWANZIG ZEICHE")]
    rows += [(110 + i, "nineteen characters\ntwenty characters ok") for i in range(3)]
    rows += [(120, None), (121, ""), (122, "\n\n"), (None, common), (None, common), (None, None), (7, rows[7][1]), (7, f"other\n{common}\n{common}"), (130, "\n".join(f"long line of the text, number {i}" for i in range(20_000)))]
    rows += [(131, rows[-1][1]), (132, rows[-1][1])]
    for parts in (1, 5):
        frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("did", F.lit("x")).withColumn("tk", F.lit(1)).withColumn("keep", F.lit("k")).withColumn("row", F.lit(2)).repartition(parts)
        got = sorted(repr((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"])) for r in lines.digests(frame).collect())
        assert got == plain(rows)
    out = lines.drop_lines(frame)
    assert out.columns == frame.columns
    got = sorted(repr((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest(), r["did"], r["keep"])) for r in out.collect())
    assert got == sorted(repr((d, h, "x", "k")) for d, h in ((eval(p)[0], eval(p)[3]) for p in plain(rows)))


def test_shuffled_join_of_bitmaps(spark, monkeypatch):
    rows = [(i, f"own line number {i} of this one\na line that they have in common") for i in range(40)]
    monkeypatch.setattr(lines, "small", lambda *a: False)
    got = sorted(repr(tuple(r)) for r in lines.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain(rows)


def test_empty(spark):
    assert lines.digests(cases.empty(spark)).count() == 0 and lines.drop_lines(cases.empty(spark)).count() == 0
