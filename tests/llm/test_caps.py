"""Bounds that must not cost a case: n-grams of small languages, long words beside an entity."""

from quillspark.llm import langid, pii


def test_even_share():
    assert langid.even_share([], 10) == 0 and langid.even_share([3, 4], 10) == 4
    assert langid.even_share([100, 2, 100], 20) == 9 and langid.even_share([100, 100], 30) == 15
    for sizes in ([5, 9, 30, 2], [1000, 10], [7], [1] * 9):
        for most in (9, 20, 40):
            share = langid.even_share(sizes, most)
            assert sum(min(s, share) for s in sizes) <= max(most, 0) or share == 0


def test_a_small_language_keeps_its_ngrams_where_the_bound_binds(spark, monkeypatch):
    rows = [(i, "en", f"the quick brown fox number {i} jumps over lazy dogs and more words of everyday prose {i * 7}") for i in range(300)]
    rows += [(1000 + i, "xx", "zyxq vuwk qqzo") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    monkeypatch.setattr(langid, "MOST_GRAMS", 30)
    got = langid.train(docs).predict(["zyxq vuwk qqzo", "the quick brown fox jumps"])
    assert got[0] == ["xx", "en"] and got[1][0] > 0.6  # 15 of its 21


def test_words_beside_an_entity_are_whole(spark):
    words = [f"{c}" * 70 for c in "abcdef"]
    text = " ".join(words) + " joe@example.org " + " ".join(w.upper() for w in words)
    ((_, near, _),) = list(pii.beside(text, pii.base_spans(text)))
    assert [w for _, w in near] == words[1:] + words[:5]
    assert all(text[at : at + 70].lower() == w for at, w in near)
    short = "a bc joe@example.org d"
    ((_, near, _),) = list(pii.beside(short, pii.base_spans(short)))
    assert all(short[at : at + len(w)] == w for at, w in near)
