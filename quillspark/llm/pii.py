"""Personal data: base patterns, and terms that disclose a protected entity by corpus co-occurrence.

Base spans are e-mail addresses, IPs, card and phone numbers.  Their values are the protected entities.  A word
in an entity's neighbourhood is a candidate.  Over the whole corpus, P(entity) is the share of all words that are
beside the entity, P(entity|word) the share of the word's occurrences that are; the word discloses
``PMI = log2(P(entity|word) / P(entity))`` of the entity's ``IC = -log2 P(entity)`` bits.  A word that discloses LEAK of
them, beside the entity more often than not and in several contexts, is
protected wherever it occurs, as a span of kind ``term``.  Equal neighbourhoods count once, beside an
entity and elsewhere, so copies of a document are no evidence for or against a word.  ``sanitise_table`` replaces
all spans by their kind.

Edge cases: null and empty texts have no spans; very long texts cost in proportion to their length; repeated rows give
equal rows; an empty table gives none; a null doc_id is carried; other columns are ignored by ``detect`` and kept by
``sanitise_table``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import BROADCAST_BYTES, WORD_GAP, free, materialize, modest, rows, table

KINDS = ("email", "ip", "card", "phone")
#: Words on each side of an entity that are candidates; distinct neighbourhoods, P(entity|word) and share of the
#: entity's bits that protect one.
CONTEXT_WORDS, MIN_CONTEXTS, MIN_DISCLOSURE, LEAK = 5, 3, 0.5, 0.9
TERM_BYTES = 128

_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_word = re.compile(r"[^\W\d_]{4,}")
_email_left = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping matches, found from each @: the local part is all that can stand before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _email_left:
            start -= 1
        m = _domain.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [("email", *s) for s in emails(text)]
    out += [("ip", m.start(), m.end()) for m in _ip.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
    for m in _card.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _phone.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _words_before(text: str, end: int) -> list[tuple[int, str]]:
    """The last CONTEXT_WORDS words that end at ``end`` or before, with their places, however long they are."""
    width = 200
    while True:
        start = max(0, end - width)
        found = [(m.start(), m[0].lower()) for m in _word.finditer(text, start, end)]
        if start == 0 or len(found) > CONTEXT_WORDS:  # of more words the first may be cut, and is left out
            return found[-CONTEXT_WORDS:]
        width *= 4


def beside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, list[tuple[int, str]], int]]:
    """(entity, candidate words with their places, neighbourhood) of every span; entity and neighbourhood are hashes."""
    for kind, a, b in spans:
        near = _words_before(text, a) + [(m.start(), m[0].lower()) for m in islice(_word.finditer(text, b), CONTEXT_WORDS)]
        entity = xxhash.xxh64_intdigest(f"{kind}:{text[a:b].lower()}") >> 1
        yield entity, near, xxhash.xxh64_intdigest(" ".join(w for _, w in near)) >> 1


def contexts(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, entity, neighbourhood) of every candidate word; entity and neighbourhood are hashes."""
    for entity, near, around in beside(text, spans):
        for term in {w for _, w in near}:
            yield term, entity, around


def occurrences(text: str, wanted: Callable[[str], bool]) -> Iterator[tuple[str, int]]:
    """(term, neighbourhood) of every occurrence of a wanted word: those of the entities beside it, or else its own."""
    words = [(m.start(), m[0].lower()) for m in _word.finditer(text)]
    hits = [i for i, (_, w) in enumerate(words) if wanted(w)]
    if not hits:
        return
    by_place: dict[int, list[int]] = {}
    for _, near, around in beside(text, base_spans(text)):
        for at, _ in near:
            by_place.setdefault(at, []).append(around)
    for i in hits:
        at, term = words[i]
        if at in by_place:
            for around in by_place[at]:
                yield term, around
        else:
            yield term, xxhash.xxh64_intdigest(" ".join(w for _, w in words[max(0, i - CONTEXT_WORDS) : i + CONTEXT_WORDS + 1])) >> 1


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """Durable table term, entity, contexts, occurrences, bits of all words above the thresholds."""

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            found: set = set()
            for t in b.column(0).to_pylist():
                if t and (spans := base_spans(t)):
                    found.update(contexts(t, spans))
            if found:
                term, entity, around = zip(*sorted(found))
                yield pa.record_batch([pa.array(term, pa.string()), pa.array(entity, pa.int64()), pa.array(around, pa.int64())], names=["term", "entity", "around"])

    texts = docs.select(F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    seen = texts.mapInArrow(candidates, "term string, entity long, around long").distinct()
    seen = materialize(seen, "pii-contexts")
    total = max(1, texts.agg(F.sum(F.size(F.split("text", WORD_GAP))).alias("n")).first()["n"] or 0)
    around = seen.select("entity", "around").distinct().groupBy("entity").agg((-F.log2(F.least(F.lit(1.0), F.count(F.lit(1)) / F.lit(float(total))))).alias("ic"))
    pairs = seen.groupBy("term", "entity").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= MIN_CONTEXTS)
    least = F.greatest(F.lit(MIN_DISCLOSURE), F.pow(F.lit(2.0), -(1 - LEAK) * F.col("ic")))
    pairs = materialize(pairs.join(around, "entity").select("term", "entity", "contexts", "ic", least.alias("least")), "pii-pairs")
    n = pairs.count()
    if n == 0:
        return pairs.select("term", "entity", "contexts", F.lit(0).cast("long").alias("occurrences"), F.lit(0.0).alias("bits"), "ic")
    # a term seen in more neighbourhoods than this is below the thresholds, whatever else there is of it
    most = pairs.groupBy("term").agg(F.floor(F.max(F.col("contexts") / F.col("least"))).alias("most"))
    limits = docs.sparkSession.sparkContext.broadcast({r["term"]: r["most"] for r in most.collect()}) if n * TERM_BYTES <= BROADCAST_BYTES else None

    def units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = limits.value if limits is not None else None
        task: dict[str, set[int]] = {}
        wanted = (lambda w: w in most and len(task.get(w, ())) <= most[w]) if most is not None else (lambda w: True)
        for b in rows(batches):
            found = []
            for t in b.column(0).to_pylist():
                for term, around in occurrences(t, wanted):
                    if most is not None:
                        seen = task.setdefault(term, set())
                        if around in seen or len(seen) > most[term]:
                            continue
                        seen.add(around)
                    found.append((term, around))
            if found:
                term, around = zip(*found)
                yield pa.record_batch([pa.array(term, pa.string()), pa.array(around, pa.int64())], names=["term", "around"])

    counted = texts.mapInArrow(units, "term string, around long")
    if limits is None:
        counted = counted.join(pairs.select("term").distinct(), "term", "left_semi")
    totals = counted.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("occurrences"))
    disclosure = F.col("contexts") / F.greatest("occurrences", "contexts")
    scored = pairs.join(totals, "term").filter(disclosure >= F.col("least")).withColumn("bits", F.log2(disclosure) + F.col("ic"))
    return materialize(scored.select("term", "entity", "contexts", "occurrences", "bits", "ic"), "pii-terms")


def _with_terms(docs: DataFrame) -> tuple[DataFrame, Callable[[pa.RecordBatch], list[frozenset[str]]]]:
    """``docs`` and a function that gives the protected words of each row of a batch of it.

    They are broadcast if their size allows it; else each text's own come to it by a join, as a last column.
    """
    modest(docs.sparkSession)
    found = materialize(disclosing_terms(docs).select("term").distinct(), "pii-words")
    if found.count() * TERM_BYTES <= BROADCAST_BYTES:
        shared = docs.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in found.collect()))
        return docs, lambda b: [shared.value] * b.num_rows

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            pairs = [(i, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in {m[0].lower() for m in _word.finditer(t or "")}]
            yield pa.record_batch([pa.array([i for i, _ in pairs], pa.int64()), pa.array([w for _, w in pairs], pa.string())], names=["_pii_row", "term"])

    row, terms = free(docs, "_pii_row"), free(docs, "_pii_terms")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "pii-docs")
    each = keyed.select(F.col(row).alias("_pii_row"), F.col("text").cast("string")).mapInArrow(words, "_pii_row long, term string")
    mine = each.join(found, "term", "left_semi").groupBy(F.col("_pii_row").alias(row)).agg(F.collect_set("term").alias(terms))
    return keyed.join(mine, row, "left").select(*docs.columns, terms), lambda b: [frozenset(x or ()) for x in b.column(b.num_columns - 1).to_pylist()]


def all_spans(text: str, terms: frozenset[str]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the spans of protected words that meet none of them."""
    spans = base_spans(text)
    found = [m.span() for m in _word.finditer(text) if m[0].lower() in terms] if terms else []
    return spans, [("term", a, e) for a, e in found if not any(a < y and x < e for _, x, y in spans)]


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, their digest, and all spans of every row."""
    source, terms_of = _with_terms(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = lambda spans: ",".join(f"{k}:{a}:{e}" for k, a, e in spans)
        for b in rows(batches):
            out = []
            for text, keep in zip(b.column(1).to_pylist(), terms_of(b)):
                spans, terms = all_spans(text or "", keep)
                n_kind = Counter(s[0] for s in spans)
                out.append((*(n_kind[k] for k in KINDS), hashlib.sha256(form(spans).encode()).hexdigest(), form(spans + terms), len(terms)))
            cols = list(zip(*out))
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term"])

    return source.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long")


def sanitise_table(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` generalised to its kind in brackets; a null text stays null."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    source, terms_of = _with_terms(docs)
    at, n = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            texts = []
            for text, keep in zip(b.column(at).to_pylist(), terms_of(b)):
                spans, terms = all_spans(text or "", keep)
                texts.append(text and sanitise(text, spans + terms))
            columns = list(b.columns[:n])
            columns[at] = pa.array(texts, pa.string())
            yield pa.record_batch(columns, names=docs_columns)

    docs_columns = docs.columns
    return source.mapInArrow(run, docs.schema)


def sanitise(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets (the generalised form)."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


QUERIES = {"op6_pii": op6_pii}
ORACLE_SQL: dict[str, str] = {}
