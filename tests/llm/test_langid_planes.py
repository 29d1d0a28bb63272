"""More languages than one bit plane holds."""

from quillspark.llm import langid


def test_more_languages_than_one_plane(spark):
    word = lambda k, j: "".join(chr(0x4E00 + 40 * k + (7 * j + n) % 40) for n in range(6))
    rows = [(100 * k + j, f"l{k:03d}", " ".join(word(k, j + n) for n in range(20))) for k in range(70) for j in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    want = {i: lang for i, lang, _ in rows}
    model = langid.train(df)
    assert len(model.languages) == 70
    assert all(r["lang_pred"] == want[r["doc_id"]] for r in langid.identify(df, model).collect())
