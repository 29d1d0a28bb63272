"""Copies are no evidence against a disclosing term."""

from quillspark.llm import pii
from quillspark.llm.common import table
from tests.llm import cases


def test_copies_do_not_hide_a_disclosing_term(spark, monkeypatch):
    rows = [(i, f"report{'x' * i} Zanzibar joe@corp.example wrote page{'y' * i} today") for i in range(6)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(200 + i, "Zanzibar alone") for i in range(40)] + [(300, None)]
    rows += [(400 + i, f"some common{'z' * i} words Kilimanjaro here") for i in range(9)]
    rows += [(500 + i, f"note{'x' * i} Kilimanjaro ann@corp.example text{'y' * i} end") for i in range(4)]
    for limit in (pii.BROADCAST_BYTES, 0):
        monkeypatch.setattr(pii, "BROADCAST_BYTES", limit)
        got = {r["doc_id"]: r["spans"] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[200] == "term:0:8" and got[400] == ""


def plain_terms(texts):
    """The protected words by their definition: counted over distinct neighbourhoods."""
    import math
    from collections import defaultdict

    total = sum(len(t.split()) if t.split() else 1 for t in texts)
    beside, near, places = defaultdict(set), defaultdict(set), defaultdict(set)
    for t in texts:
        for entity, words, around in pii.beside(t, pii.base_spans(t)):
            near[entity].add(around)
            for _, w in words:
                beside[w, entity].add(around)
    wanted = {w for w, _ in beside}
    for t in texts:
        for w, around in pii.occurrences(t, wanted.__contains__):
            places[w].add(around)
    out = set()
    for (w, e), c in beside.items():
        ic, p = -math.log2(min(1, len(near[e]) / total)), len(c) / max(len(places[w]), len(c))
        if len(c) >= pii.MIN_CONTEXTS and p >= pii.MIN_DISCLOSURE and math.log2(p) + ic >= pii.LEAK * ic - 1e-9:
            out.add(w)
    return out


def test_terms_against_brute_force_on_both_ways(spark, sf_dir, monkeypatch):
    texts = [r["text"] for r in table(spark, sf_dir, "documents").select("text").collect() if r["text"]]
    for k, name in enumerate(["Übermut²x", "Ñandúes", "Żółwie", "common"]):
        texts += [f"w{'x' * j} {name} k{k}@corp.example von{'y' * j} hier" for j in range(2 + 2 * k)] + [f"{name} selbst{'z' * j}" for j in range(k)]
    texts += [f"common word{'q' * j} alone" for j in range(30)]
    want = plain_terms(texts)
    assert "ñandúes" in want and "common" not in want
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)] + [(9999, None, "e")], "doc_id long, text string, _pii string")
    results = []
    for limit in (pii.BROADCAST_BYTES, 0):
        monkeypatch.setattr(pii, "BROADCAST_BYTES", limit)
        assert {r["term"] for r in pii.disclosing_terms(df).collect()} == want
        results.append((sorted(map(tuple, pii.detect(df).collect())), sorted(map(str, pii.sanitise_table(df).collect()))))
    assert results[0] == results[1]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise_table(df).collect()}
    assert clean[9999] is None and len(clean) == len(texts) + 1
    for i, t in enumerate(texts):
        base, terms = pii.all_spans(t, frozenset(want))
        assert clean[i] == pii.sanitise(t, base + terms)


def test_sanitised_table_keeps_rows_and_columns(spark):
    docs = cases.documents(spark)
    out = pii.sanitise_table(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert "[email]" in next(r["text"] for r in out.collect() if r["doc_id"] == 13)
