"""op13: against a plain version, with longer runs, ties, nulls and an empty target."""

import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quillspark.llm import resample
from tests.llm import cases


def plain(docs, target, max_run=1, least=20, share=10):
    lower = {i: i + 32 for i in range(65, 91)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    runs = lambda ws: [zlib.crc32(" ".join(ws[i : i + n]).encode()) % 10_000 for n in range(1, max_run + 1) for i in range(len(ws) - n + 1)]
    all_ = [(d, words(t)) for d, t in docs]
    s, t = Counter(b for _, ws in all_ for b in runs(ws)), Counter(b for x in target for b in runs(words(x)))
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for d, ws in all_:
        f = runs(ws)
        weight = sum(map(gain, f)) // len(f) if f else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(f), weight, score, None, len(ws)])
    able = sorted((r for r in out if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for i, r in enumerate(able[: share * len(able) // 100], 1):
        r[4] = i
    return sorted(repr(tuple(r[:5])) for r in out)


def test_equals_plain(spark):
    docs = [(r["doc_id"], r["text"]) for r in cases.documents(spark).select("doc_id", "text").collect()]
    docs += [(1000 + i, f"{cases.PROSE * (i % 4)} nr{i % 9} NUL\x00byte Ärger ÄRGER") for i in range(300)] + [(1001, cases.PROSE * 3)]
    target = [cases.PROSE, None, "", "other words entirely, 中文"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("buckets", F.lit(1)).withColumn("rank", F.lit(2))
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for run, share in ((1, 10), (3, 100), (1, 0)):
        got = resample.resample(frame, wanted, max_run=run, share=share).collect()
        assert sorted(repr(tuple(r)) for r in got) == plain(docs, target, run, share=share)


def test_empty_tables(spark):
    some = spark.createDataFrame([(1, cases.PROSE * 3)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(none, some).count() == 0
    assert [tuple(r) for r in resample.resample(some, none, share=100).collect()] == [eval(x) for x in plain([(1, cases.PROSE * 3)], [], share=100)]


def test_draw_places_ties(spark):
    rows = [(d, 30, 30, 0, s) for d, s in [(5, 10), (3, 10), (4, 10), (1, 9), (2, 11), (9, 11)]] + [(7, 3, 3, 0, 99), (8, 30, 30, 0, None)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words int, n_features long, weight long, score long")
    got = {r["doc_id"]: r["rank"] for r in resample.draw(scored, share=70).collect()}
    assert got == {2: 1, 9: 2, 3: 3, 4: 4, 5: None, 1: None, 7: None, 8: None}
