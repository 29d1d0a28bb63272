"""Model calls: completion and embedding protocols with deterministic stubs, and the pipelines around them.

A completer or embedder is any picklable callable on a list; batches reach it through Arrow, so a real provider
is called a batch at a time.  The stubs need no network and give the same output on every run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import scrub as S
from quillspark.functions import text as T
from quillspark.operators import incremental as I

Completer = Callable[[list[str]], list[str]]
Embedder = Callable[[list[str]], list[list[float]]]
BATCH, DIM = 64, 32
#: Errors in a row after which a stage stops calling its model.
BREAKER = 5


def stub_complete(prompts: list[str]) -> list[str]:
    """Headed digest of the prompt: the first sentence under a title."""
    return [f"## {' '.join(p.split()[:6])}\n\n{re.split(r'(?<=[.!?])', p.strip(), maxsplit=1)[0].strip()}" for p in prompts]


def stub_embed(texts: list[str]) -> list[list[float]]:
    """Hashed bag of words, unit length."""
    out = []
    for t in texts:
        v = [0.0] * DIM
        for w in t.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "big")
            v[h % DIM] += 1.0 if h >> 31 else -1.0
        n = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / n for x in v])
    return out


def complete(df: DataFrame, prompt: str, completer: Completer = stub_complete, column: str = "reply") -> DataFrame:
    """``df`` with the model's reply to column ``prompt``; after BREAKER failed batches in a row the rest is null."""

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        failed = 0
        for s in batches:
            out: list = []
            for i in range(0, len(s), BATCH):
                part = s.iloc[i : i + BATCH].fillna("").tolist()
                try:
                    if failed >= BREAKER:
                        raise RuntimeError("the breaker is open")
                    out += completer(part)
                    failed = 0
                except Exception:  # noqa: BLE001  a provider's error costs its batch, not the job
                    failed += 1
                    out += [None] * len(part)
            yield pd.Series(out, index=s.index, dtype="object")

    return df.withColumn(column, call(F.col(prompt)))


def embed(df: DataFrame, text: str, embedder: Embedder = stub_embed, column: str = "vec") -> DataFrame:
    """``df`` with the vector of column ``text``, in batches."""
    names = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                part = b.slice(i, BATCH)
                vecs = embedder([t or "" for t in part.column(names.index(text)).to_pylist()])
                yield pa.record_batch([*part.columns, pa.array(vecs, pa.list_(pa.float64()))], names=[*names, column])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{schema}, {column} array<double>")


def embed_incremental(pages: DataFrame, cache: DataFrame, model: str = "stub", embedder: Embedder = stub_embed) -> DataFrame:
    """(slug, hash, model, vec): cached vectors of unchanged pages(slug, text), new ones of the others."""
    hashed = pages.select("slug", F.col("text"), F.substring(F.sha2("text", 256), 1, 16).alias("hash"))
    planned = I.cache_plan(hashed, cache, model)
    kept = planned.filter(F.col("action") == "reuse").join(cache.select("slug", "vec"), "slug").select("slug", "hash", F.lit(model).alias("model"), "vec")
    made = embed(planned.filter(F.col("action") == "embed").select("slug", "hash", "text"), "text", embedder).select("slug", "hash", F.lit(model).alias("model"), "vec")
    return kept.unionByName(made)


def resolve(entries: DataFrame, include_sensitive: bool = False) -> DataFrame:
    """Entries(file_text, tool_text, description) with text and method of their first tier that has any."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    blocked = S.is_sensitive(F.col("description")) & F.lit(not include_sensitive)
    method = F.when(blocked, "sensitive").when(has("file_text"), "file").when(has("tool_text"), "tool").when(has("description"), "description").otherwise("unresolved")
    text = F.when(blocked, F.lit(None)).when(has("file_text"), F.col("file_text")).when(has("tool_text"), F.col("tool_text")).when(has("description"), F.trim("description"))
    return entries.withColumns({"method": method, "text": text})


def synthesize(notes: DataFrame, pages: DataFrame, completer: Completer = stub_complete) -> DataFrame:
    """(slug, title, kind, n_notes, sources, body, action): notes(raw_name, source, title, kind, text) merged into pages.

    Proposals are made for all notes at once; notes of one slug are then merged in the order of their names,
    repeated paragraphs once, with the kind of the lower rank.
    """
    from quillspark.operators.rollup import KIND_RANK

    proposed = complete(notes.withColumn("prompt", T.excerpt(F.col("text"), 50000)), "prompt", completer)
    ranks = F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv])
    keyed = proposed.filter(F.col("reply").isNotNull()).withColumn("slug", T.slug_chain(F.lit(None), F.col("title"), F.col("reply"), F.col("raw_name")))
    merged = keyed.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("raw_name", "source", "title", "reply"))).alias("n"), F.min_by("kind", ranks[F.col("kind")]).alias("kind"))
    made = merged.select(
        "slug",
        F.get("n", F.lit(0))["title"].alias("title"),
        "kind",
        F.size("n").alias("n_notes"),
        F.array_distinct(F.transform("n", lambda x: F.concat_ws(":", x["source"], x["raw_name"]))).alias("sources"),
        T.dedup_blocks(F.array_join(F.transform("n", lambda x: T.clean_body(x["reply"])), "\n\n")).alias("body"),
    )
    old = pages.select("slug", F.lit(True).alias("_had"))
    return made.join(old, "slug", "left").withColumn("action", F.when(F.col("_had"), "update").otherwise("create")).drop("_had")
