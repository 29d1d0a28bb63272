"""Sources that are not there, and command-line literals against the driver's own coercion."""

import random

from pyspark.sql import functions as F

from quillspark import config as C
from quillspark.functions import text as T
from quillspark.sources import sessions as R


def test_probe_never_raises(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"type": "user", "cwd": "/w", "message": {"content": "q"}}\n')
    stores = {"claude": str(tmp_path), "codex": str(tmp_path / "none"), "cursor": "nosuch://x/y", "other": str(tmp_path)}
    assert R.available(spark, stores) == {"claude": True, "codex": False, "cursor": False, "other": False}
    assert R.union_sessions(spark, stores).count() == 1
    assert R.union_sessions(spark, {"codex": str(tmp_path / "none")}, workspace="/w").count() == 0


def test_literals_equal_the_drivers_coercion(spark):
    rng = random.Random(3)
    said = ["true", " False", "NULL", "none ", "+007", "-0", "0", "-12", "1.5", "", " ", "tru e", "--1", "9" * 30]
    said += ["".join(rng.choices("+-01 tTrue9", k=rng.randint(1, 6))) for _ in range(300)]
    kinds = {bool: "bool", type(None): "null", int: "int", str: "text"}
    for r in spark.createDataFrame([(t,) for t in said], "t string").select("t", T.literal(F.col("t")).alias("l")).collect():
        want = C.coerce(r["t"])
        value = str(want).lower() if isinstance(want, bool) else None if want is None else str(want)
        assert (r["l"]["kind"], r["l"]["value"]) == (kinds[type(want)], value), r["t"]
    assert spark.range(1).select(T.literal(F.lit(None).cast("string")).alias("l")).first()["l"]["kind"] is None
