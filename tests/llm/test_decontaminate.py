"""Decontamination: documents that hold an item in another place, filling or setting than the other tests have."""

from quillspark.llm import decontaminate


def found(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench).collect()}


def test_copies_filled_differently(spark):
    item = "the shop sold 12 red apples for 30 cents and later it got 7 more crates with 15 green pears in each of them"
    other = item.replace("12", "77").replace("30", "41").replace("7 more", "9 more").replace("15", "66")
    third = other.replace("66", "88").replace("41", "43").replace("77", "78").replace("9 more", "8 more")
    cut = lambda t: t.replace("and later it", "and then much later it")
    gap = " and so the long work sheet goes on to the next of its many tasks with some other words "
    texts = [gap.join([item, other]), gap.join([item, other, third]), f"{item} {other} {third}", gap.join([cut(other), cut(third)]), gap]
    assert found(spark, [item], texts) == {(0, 0), (1, 0), (2, 0), (3, 0)}


def test_names_first_in_their_sentences_and_items_after_headings(spark):
    short = "Tom has 3 red apples. Ann has 4 green pears. Bob has 5 blue plums. Eve has 6 ripe figs."
    swapped = short.replace("Tom", "Kim").replace("Ann", "Lea").replace("Bob", "Max").replace("Eve", "Zoe").replace("3", "8")
    question = "What is the capital of France"
    verse = "Rivers run Slowly down to Seas of sand"
    texts = [f"Some words. {swapped} The end.", f"Q1 {question}", f"Heading\n{question}? Paris", f"it says {verse.lower()} there", "What is the colour of"]
    assert found(spark, [short, question, verse], texts) == {(0, 0), (1, 1), (2, 1), (3, 2)}


def test_items_of_hardly_more_than_placeholders(spark):
    texts = ["Sums: What is 345 * 27 ? It is 9315", "What is 346 * 27 ?", "12 13 14 15 16 17 18 19 20 21", "list 12 13 14 15 16 17 18 19 20 22"]
    assert found(spark, ["What is 345 * 27 ?", texts[2]], texts) == {(0, 0), (2, 1), (3, 1)}
