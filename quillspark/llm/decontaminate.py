"""Benchmark decontamination by template windows.

Native expressions only.  A text becomes template tokens: numbers, names (capitalised words but function
words, wherever they stand) and units after numbers are typed placeholders, other words are lower-cased without
punctuation.  Both forms are made by a few passes over the whole text, word for word alike, and their windows are
cut from it as strings, so a match is of the words themselves.  Texts in which no three words of a benchmark window
stand at their distances cannot match and are left out before (``candidates``).  Windows of template tokens, and those of the words,
are hash-joined with those of the benchmark items; a matching document keeps the words that
fill its slots, and the filling must be a function of the item's: a re-parameterised question swaps values
consistently, while an unrelated text that shares a frame does not.  Each occurrence of an item is judged by itself,
so a document may hold any number of copies that are filled differently.

Edge cases: null and empty texts match nothing; an item of fewer tokens than the window is one window of its own
length; items without tokens are ignored, items of hardly more than numbers and names are found only
word for word; each row is judged by itself, whatever its doc_id (null and repeated ones too), and rows of one
doc_id give one result for each item, the best; very long texts cost in proportion to their length; an empty table or
benchmark gives no rows; other columns are ignored by ``find`` and kept by ``remove``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WORD_GAP, materialize, small, table

#: Template tokens of a window; least share of an item's windows in a contaminated document; literal words of a window.
WINDOW, SHARE, LITERALS = 8, 0.5, 3
#: Slots of a match that must be filled consistently.
CONSISTENT = 0.8
#: Offsets (place in the document less place in the item) of one occurrence are at most so far from the next.
DRIFT = 4

#: Typed placeholders of a template, and the mark of a capitalised word until it is known to be a name.
CAPITAL, NUM, UNIT, NAME = "\u0001", "\u0002", "\u0003", "\u0004"
UNITS = "mm|cm|m|km|g|kg|mg|t|l|ml|s|ms|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|miles?|meters?|metres?|grams?|kilograms?|litres?|liters?|degrees?|percent|dollars?|euros?|pounds?|cents?|usd|eur|gbp|mph|kmh|feet|foot|inch|inches|v|w|kw|hz|mb|gb"

#: Words that are never names, however they are written (English, French, German, Spanish).
FUNCTION_WORDS = sorted(set(
    """a an the this that these those it its he she they we you i his her their our your my him them us me who whom whose which what
    when where why how if then else than as and or but nor so yet not no yes of in on at by for from with without to into onto over
    under after before during between among about against through while because since until although though unless once is are was
    were be been being am do does did done has have had having can could will would shall should may might must let there here all
    any both each every either neither some many much more most few less several such only also just too very now again however
    le la les un une des du de et ou mais donc or ni car que qui quoi dont où quand comment pourquoi quel quelle quels quelles ce
    cet cette ces il elle ils elles on nous vous je tu son sa ses leur leurs notre nos votre vos mon ma mes dans sur sous par pour
    avec sans chez vers entre après avant pendant si est sont était être a ont avait avoir ne pas plus
    der die das den dem des ein eine einer eines einem einen und oder aber denn dass wenn weil als wie was wer wo wann warum welche
    welcher welches er sie es wir ihr ich du sein seine ihre unser euer mein dein in im an am auf aus bei mit nach von vom zu zum zur
    für über unter vor hinter zwischen durch gegen ohne um ist sind war waren hat haben hatte wird werden kann können nicht kein keine
    el los las lo una unos unas y o u pero sino que quien cuando donde como cual cuales cuanto cuantos por para con sin sobre entre
    desde hasta en del al se su sus mi tu nuestro nuestra este esta estos estas ese esa eso él ella ellos ellas es son era fue ser
    estar está están hay ha han no sí más muy
    qué quién cuándo dónde cómo cuál cuáles cuánto cuántos cuántas""".split()
))


def _templates(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with w and t: the words without punctuation, lower-cased, and the template tokens, each after a space.

    Words without letter or digit go first, so the words of both stand at the same places.
    """
    gone = r"[^\p{L}\p{N} ]*+"
    passes = [
        (rf" {gone}[0-9]++(?:[.,:/][0-9]++)*+(?:st|nd|rd|th)?+{gone}(?= )", f" {NUM}"),
        (rf"{NUM} (?i:{UNITS}){gone}(?= )", f"{NUM} {UNIT}"),
        (rf" {gone}(?=\p{{Lu}}\p{{Ll}})", f" {CAPITAL}"),
    ]
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), CAPITAL + NUM + UNIT + NAME, "")
    df = df.withColumn("_s", F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), r"\s++(?:[^\p{L}\p{N}\s]++\s++)*+", " "))
    typed = F.col("_s")
    for pattern, to in passes:
        typed = F.regexp_replace(typed, pattern, to)
    typed = F.lower(F.regexp_replace(typed, rf"[^\p{{L}}\p{{N}} {CAPITAL}-{UNIT}]++", ""))
    typed = F.regexp_replace(typed, rf"{CAPITAL}(?!(?:{'|'.join(FUNCTION_WORDS)}) )[^ ]++", NAME)
    return df.withColumns({"w": F.lower(F.regexp_replace("_s", r"[^\p{L}\p{N} ]++", "")), "t": F.translate(typed, CAPITAL, "")}).drop("_s")


def _windows(tokens: Column, size: int) -> Column:
    """All windows of ``size`` tokens as strings, by one pass over the text."""
    return F.regexp_extract_all(tokens, F.lit(f" (?=({' '.join(['[^ ]++'] * size)}) )"), F.lit(1))


def item_windows(benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """item (row number), item_id, way, key, size, item_at, slots (words), typed, n_windows of every item, durable.

    Way 0 is the windows of ``literals`` plain words at least (placeholders alone never match by template), found by
    template or by words.  Way 1 is all windows, found by words alone, so that an item of numbers and names is
    found word for word.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    array = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    items = _templates(rows, F.col("text")).select(F.monotonically_increasing_id().alias("item"), "item_id", array(F.col("t")).alias("t"), array(F.col("w")).alias("w")).filter(F.size("t") > 0)
    t, w, size = F.col("t"), F.col("w"), F.least(F.lit(window), F.size("t"))
    slot = lambda x: x.isin(NUM, UNIT, NAME)
    plain = lambda i: F.size(F.filter(F.slice(t, i, size), lambda x: ~slot(x))) >= F.least(F.lit(literals), size)
    places = F.sequence(F.lit(1), F.size(t) - size + 1)
    items = items.withColumns({"_every": places, "_some": F.filter(places, plain)})
    row = lambda i, way, c, at: F.struct(F.lit(way).alias("way"), F.array_join(F.slice(c, i, size), " ").alias("key"), i.alias("item_at"), F.slice(w, i, size).alias("slots"), F.transform(F.slice(t, i, size), slot).alias("typed"), F.size(at).alias("n_windows"))
    found = lambda way, c, at: F.transform(at, lambda i: row(i, way, F.col(c), F.col(at)))
    each = F.array_distinct(F.concat(*[found(*x) for x in ((0, "t", "_some"), (0, "w", "_some"), (1, "w", "_every"))]))
    out = items.select("item", "item_id", size.alias("size"), F.explode(each).alias("x"))
    return materialize(out.select("item", "item_id", "size", "x.*"), "benchmark-windows")


def candidates(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` that can hold a window of the benchmark, by an exact necessary condition.

    A matching window has its plain words at their places, so the three longest of them are in the text at their
    distances.  Words are tested by one hash probe each; templates are made of the rows that pass alone.
    A benchmark too large to broadcast leaves all rows.
    """
    free = F.filter(F.transform("slots", lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))), lambda x: (F.col("way") == 1) | ~F.get("typed", x["i"]))
    three = bench.select(F.slice(F.sort_array(free), 1, 3).alias("p")).select(*[F.get("p", F.least(F.lit(k), F.size("p") - 1)).alias(f"w{k}") for k in range(3)])
    places = [(F.col(f"w{k}.i") - F.col("w0.i")).alias(f"apart{k}") for k in (1, 2)]
    known = three.select(F.xxhash64("w0.x").alias("h"), *[F.col(f"w{k}.x").alias(f"word{k}") for k in range(3)], *places).distinct()
    if not small(bench, F.octet_length("key") * 3 + 200):
        return docs
    key = F.xxhash64("text")
    words = F.split(F.lower(F.regexp_replace(F.col("text").cast("string"), r"[^\p{L}\p{N}\s]++", "")), WORD_GAP)
    each = docs.select("text", words.alias("words")).select("text", "words", F.posexplode("words").alias("at", "word"))
    there = [F.get("words", F.col("at") + F.col(f"apart{k}")) == F.col(f"word{k}") for k in (1, 2)]
    met = each.join(F.broadcast(known), (F.xxhash64("word") == F.col("h")) & (F.col("word") == F.col("word0")) & there[0] & there[1])
    found = materialize(met.select(key.alias("_may")).distinct(), "benchmark-candidates")
    side = F.broadcast(found) if small(found, 64) else found
    return docs.join(side, key == F.col("_may"), "left_semi")


def _hits(docs: DataFrame, bench: DataFrame, key: list[str]) -> DataFrame:
    """row, the columns of ``key``, item, item_id, way, item_at, at, n_windows, filling of all matching windows, durable."""
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())  # at most ``window`` values
    texts = _templates(candidates(docs, bench).withColumn("row", F.monotonically_increasing_id()), F.col("text"))
    cut = F.array(*[F.struct(_windows(F.col("t"), s).alias("tw"), _windows(F.col("w"), s).alias("ww")) for s in sizes or [WINDOW]])
    sized = texts.select("row", *key, F.explode(cut).alias("z")).select("row", *key, F.col("z.tw").alias("tw"), F.col("z.ww").alias("ww"))
    placed = sized.select("row", *key, F.posexplode(F.arrays_zip("tw", "ww")).alias("at", "x")).select("row", *key, "at", "x.tw", "x.ww")
    known = bench.select(F.xxhash64("key").alias("h")).distinct()
    ours = [F.xxhash64("tw"), F.xxhash64("ww")]
    if small(bench, 64):
        met = placed
        for i, h in enumerate(ours):
            met = met.join(F.broadcast(known.withColumnRenamed("h", f"_h{i}")), h == F.col(f"_h{i}"), "left")
        met = met.filter(F.col("_h0").isNotNull() | F.col("_h1").isNotNull())
    else:
        met = placed.withColumn("h", F.explode(F.array_distinct(F.array(*ours)))).join(known, "h", "left_semi")
    met = met.select("row", *key, "at", "ww", F.explode(F.array_distinct(F.array("tw", "ww"))).alias("key"))
    wide = F.broadcast(bench) if small(bench, F.octet_length("key") * 3 + F.size("slots") * 40 + 200) else bench
    filled = F.filter(F.arrays_zip("slots", F.split("ww", " ").alias("filled"), "typed"), lambda z: z["typed"])
    return materialize(met.join(wide, "key").select("row", *key, "item", "item_id", "way", "item_at", "at", "n_windows", filled.alias("filling")).distinct(), "benchmark-hits")


def _occurrences(pairs: DataFrame) -> DataFrame:
    """Every pair once for each level of grouping: level and part (the occurrence it belongs to).

    Level 0 is the pairs of one offset (an unbroken copy), level 1 those of offsets at most DRIFT apart from the next
    (a copy with words put in or left out), level 2 all of a document (an item in distant parts).
    """
    pairs = pairs.withColumn("off", F.col("at") - F.col("item_at"))
    order = Window.partitionBy("row", "item").orderBy("off")
    starts = (F.col("off") - F.lag("off").over(order) > DRIFT).cast("int")
    runs = pairs.select("row", "item", "off").distinct().withColumn("new", F.coalesce(starts, F.lit(0)))
    runs = runs.withColumn("run", F.sum("new").over(order).cast("int")).drop("new")
    level = lambda k, part: F.struct(F.lit(k).alias("level"), part.cast("int").alias("part"))
    each = F.explode(F.array(level(0, F.col("off")), level(1, F.col("run")), level(2, F.lit(0))))
    return pairs.join(runs, ["row", "item", "off"]).withColumn("g", each).select("*", "g.level", "g.part").drop("g", "off", "run")


def find_rows(docs: DataFrame, benchmark: DataFrame, key: list[str], window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """The columns of ``key``, item_id, n_matched, n_windows, coverage, consistency of every contaminated (row, item).

    Coverage and consistency are those of one occurrence, the best; one that passes both thresholds suffices.
    """
    hits = _hits(docs, item_windows(benchmark, window), key)
    pairs = _occurrences(hits.select("row", "item", "way", "item_at", "at", "n_windows", "filling"))
    group = ["row", "item", "way", "level", "part"]
    matched = pairs.groupBy(*group).agg(F.countDistinct("item_at").alias("n_matched"), F.max("n_windows").alias("n_windows"))
    both = matched.withColumn("coverage", F.round(F.col("n_matched") / F.col("n_windows"), 6)).filter(F.col("coverage") >= share)
    slots = pairs.select(*group, F.explode("filling").alias("z")).select(*group, F.col("z.slots").alias("a"), F.col("z.filled").alias("b")).groupBy(*group, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    best = slots.groupBy(*group, "a").agg(F.max("n").alias("most"), F.sum("n").alias("all")).groupBy(*group).agg((F.sum("most") / F.sum("all")).alias("consistency"))
    out = both.join(best, group, "left").withColumn("consistency", F.round(F.coalesce("consistency", F.lit(1.0)), 6)).filter(F.col("consistency") >= CONSISTENT)
    top = out.groupBy("row", "item").agg(F.max(F.struct("coverage", "consistency", "n_matched", "n_windows")).alias("x"))
    named = hits.select("row", "item", "item_id", *key).distinct()
    return top.join(named, ["row", "item"]).select(*key, "item_id", "x.n_matched", "x.n_windows", "x.coverage", "x.consistency")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, coverage, consistency of every contaminated (document, item)."""
    rows = find_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, ["doc_id"], window, share)
    top = F.max(F.struct("coverage", "consistency", "n_matched", "n_windows")).alias("x")
    return rows.groupBy("doc_id", "item_id").agg(top).select("doc_id", "item_id", "x.n_matched", "x.n_windows", "x.coverage", "x.consistency")


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; each row is judged by itself, whatever its doc_id."""
    keys = {"_leak": F.xxhash64("doc_id", "text"), "_leak2": F.xxhash64(F.lit(1), "text", "doc_id")}
    found = find_rows(docs.select(*[c.alias(k) for k, c in keys.items()], "text"), benchmark, list(keys))
    found = materialize(found.select(*keys).distinct(), "benchmark-leaks")
    side = F.broadcast(found) if small(found, 64) else found
    return docs.join(side, (keys["_leak"] == side["_leak"]) & (keys["_leak2"] == side["_leak2"]), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE_SQL: dict[str, str] = {}
