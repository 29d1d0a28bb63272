"""Languages with few labelled rows are learned, whatever their n-grams' counts."""

import zlib

from quillspark.llm import langid


def test_few_labelled_rows(spark):
    texts = {"de": "der schnelle braune fuchs springt über den faulen hund", "fr": "le renard brun saute par dessus le chien paresseux", "en": "the quick brown fox jumps over the lazy dog"}
    free = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, lang, t) for i, (lang, t) in zip(free, texts.items())] + [(free[5], "xx", None), (free[6], "yy", "123"), (1000, None, "der faule hund"), (1001, None, "ÿÿÿ ŵŵŵ"), (1002, None, "12")]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert [got[i] for i in free[:3]] == ["de", "fr", "en"] and got[1000] == "de" and got[1001] in texts and got[1002] == "und"
