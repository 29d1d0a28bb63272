"""Spoken secrets, masks of whole occurrences, and columns that bear the operators' own names."""

import random
import string

from pyspark.sql import functions as F

from quillspark.llm import neardup, pii, secrets, simhash


def test_spoken_secrets(spark):
    rng = random.Random(5)
    some = ["".join(rng.choices(string.ascii_letters + string.digits, k=12)) for _ in range(40)]
    said = ["the password is {}", "the password was set to {}.", "our token was {}, it works", "das Passwort lautet {}"]
    rows = [(i, said[i % 4].format(v)) for i, v in enumerate(some)]
    plain = ["the password is required for all", "the key to success is work", "the token is valid until tomorrow", "the key is RS2.5-bit strong", "my password was changed to something new"]
    rows += [(100 + i, t) for i, t in enumerate(plain)]
    found = {r["doc_id"]: r["value"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).filter("is_secret").collect()}
    assert sum(found.get(i) == v for i, v in enumerate(some)) >= 38
    assert not [i for i in found if i >= 100]


def test_masks_are_whole_occurrences(spark):
    rows = [(1, 'pwd="Qw7kLm2p" then aQw7kLm2pz and Qw7kLm2p.'), (2, "set pwd=Gh7!\\Ek$2z now, Gh7!\\Ek$2z too")]
    got = {r["doc_id"]: r["text"] for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == f'pwd="{secrets.MASK}" then aQw7kLm2pz and {secrets.MASK}.'
    assert got[2] == f"set pwd={secrets.MASK} now, {secrets.MASK} too"


def test_columns_of_any_name_stay(spark, monkeypatch):
    names = ["_secrets", "_secret_doc", "_near_set", "_near_row", "_simhash_row", "_Simhash_fp", "_pii_row", "_pii_terms", "__pii_row", "_lang"]
    rows = [(1, "the long text of one document here", 5), (2, "the long text of one document here", 5), (3, 'token = "269b1cea0846965f2d3ecb5cdb87c0edc7a7a587"', 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({n: F.lit(i) for i, n in enumerate(names)})
    monkeypatch.setattr(pii, "BROADCAST_BYTES", -1)
    for f, n in ((secrets.redact, 3), (neardup.keep_one, 2), (simhash.keep_one, 2), (pii.sanitise_table, 3)):
        out = f(docs)
        assert out.columns == docs.columns, f
        got = out.select(*names).collect()
        assert len(got) == n and all(list(r) == list(range(len(names))) for r in got), f
