"""Shared plumbing of the training-data operators: word rules and batches (durable tables: quillspark.durable)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.durable import BROADCAST_BYTES, materialize, small, table

__all__ = ["BROADCAST_BYTES", "WORD_GAP", "chunks", "free", "holds_any", "materialize", "modest", "rows", "small", "table", "words_column", "words_of"]

#: The contracts' words are maximal runs of characters outside this class (ASCII white space).
WORD_GAP = "[\\x20\\x09-\\x0D]+"


#: Rows of an Arrow batch of whole texts; the session's default would hold five times as many in every Python task.
BATCH_ROWS = 2000


def modest(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to BATCH_ROWS, unless it is set to fewer rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def free(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def holds_any(text: Column, parts: list[str]) -> Column:
    """Whether ``text`` holds one of ``parts`` (in lower case), whatever its case: cheap, to go before a pattern."""
    return F.exists(F.array(F.lower(text)), lambda low: reduce(or_, [F.contains(low, F.lit(p)) for p in parts]))


def chunks(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters; a longer text is a range of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def rows(batches: Iterable[pa.RecordBatch], most: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to ``most`` rows, which bounds what one step of a Python stage holds."""
    for b in batches:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)


def words_of(text: str | None) -> list[bytes]:
    """The contracts' words as UTF-8: ``bytes.split`` cuts at exactly the class of WORD_GAP."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def words_column(text: Column) -> Column:
    """The same words as a native array column (null text: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")
