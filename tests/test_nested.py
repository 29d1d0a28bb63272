"""Balanced braces and nested maps as columns, against the driver's functions."""

import json
import random

from pyspark.sql import functions as F

from quillspark import config
from quillspark.functions import text as T


def test_extract_json_equals_driver(spark):
    rng = random.Random(9)
    fixed = [None, "", "{}", "a {\"x\": {\"y\": 1}} b", "```json\n{\"a\": [1, 2]}\n```", "} {\"b\": 2}", "{{}", "{\"s\": \"}\"} tail", "{\"s\": \"{\"} tail }", "{bad} {\"ok\": 1}", "no braces", '{"s": "{"}, {"t": "}"}', "é {\"ü\": \"ß\"} ô"]
    texts = fixed + ["".join(rng.choice(['{', '}', '"a": 1', ' ', 'x', '{"k": 2}', '```', '```json']) for _ in range(rng.randint(1, 8))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.extract_json(F.col("t")).alias("j")).collect()
    for r in got:
        want = config.extract_json(texts[r["i"]])
        assert (json.loads(r["j"]) if r["j"] is not None else None) == want, texts[r["i"]]


def test_merge_equals_driver(spark):
    rng = random.Random(10)
    one = lambda: None if rng.random() < 0.1 else {k: {x: rng.choice(["1", "2", None]) for x in rng.sample("abc", rng.randint(0, 3))} for k in rng.sample("xyz", rng.randint(0, 3))}
    rows = [(i, one(), one()) for i in range(100)]
    kind = "map<string,map<string,string>>"
    for r in spark.createDataFrame(rows, f"i int, a {kind}, b {kind}").select("i", T.merge_nested(F.col("a"), F.col("b")).alias("m")).collect():
        _, a, b = rows[r["i"]]
        assert (r["m"] if r["m"] is not None else None) == (config.merge(a, b) if a is not None and b is not None else a if b is None else b)
