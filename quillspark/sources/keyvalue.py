"""SQLite tables of (key, value) rows as a data source that filters and splits by key.

Filters on the key (equality, membership, prefix, range, not null) are pushed into each file's own query, where the
key's index serves them; Spark evaluates the others.  With option ``slices`` a file is read in that many ranges of keys
of about equal rows, each a task.  Rows come as Arrow batches.  Files are opened for reading only and have to be
where the tasks run, as SQLite has no remote files.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

BATCH_ROWS = 2000
_SCHEMA = pa.schema([("key", pa.string()), ("value", pa.string())])
_COMPARED = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}

Clause = tuple[str, tuple]


def starts_with(prefix: str) -> Clause:
    """Keys with a prefix: a range that an index can serve, and the exact test."""
    clause, values = "substr(key, 1, ?) = ?", (len(prefix), prefix)
    return (f"key >= ? AND {clause}", (prefix, *values)) if prefix else ("key IS NOT NULL", ())


def clause_of(f: D.Filter) -> Clause | None:
    """SQL of a filter on the key; None for others, which Spark evaluates.  Keys compare by their bytes in both."""
    if getattr(f, "attribute", None) != ("key",):
        return None
    if isinstance(f, D.IsNotNull):
        return "key IS NOT NULL", ()
    if isinstance(f, D.StringStartsWith):
        return starts_with(f.value)
    if type(f) in _COMPARED and isinstance(f.value, str):
        return f"key {_COMPARED[type(f)]} ? COLLATE BINARY", (f.value,)
    if isinstance(f, D.In) and all(isinstance(v, str) for v in f.value):
        return f"key COLLATE BINARY IN ({', '.join('?' * len(f.value))})", tuple(f.value)
    return None


@contextlib.contextmanager
def _opened(path: str):
    import sqlite3

    con = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    try:
        yield con
    finally:
        con.close()


def _where(clauses: list[Clause]) -> Clause:
    return " AND ".join(f"({c})" for c, _ in clauses) or "1", tuple(v for _, values in clauses for v in values)


def _table(name: str) -> str:
    if not name.isidentifier():
        raise ValueError(f"not a table name: {name}")
    return name


def _selected(con, table: str, clauses: list[Clause]) -> Iterator[tuple[str, str]]:
    where, values = _where(clauses)
    for key, value in con.execute(f"SELECT key, value FROM {_table(table)} WHERE {where}", values):
        yield key, value.decode("utf-8", "replace") if isinstance(value, bytes) else None if value is None else str(value)


def key_values(path: str, table: str, prefix: str) -> Iterator[tuple[str, str]]:
    """(key, value) rows of a SQLite table whose keys start with ``prefix``."""
    with _opened(path) as con:
        yield from _selected(con, table, [starts_with(prefix)])


@dataclass
class KeyRange(D.InputPartition):
    """Rows of a file from one key (inclusive) to another (exclusive); None is open, and null keys are before all."""

    path: str
    first: str | None = None
    end: str | None = None

    def clauses(self) -> list[Clause]:
        if self.first is None:
            return [] if self.end is None else [("key IS NULL OR key < ? COLLATE BINARY", (self.end,))]
        return [("key >= ? COLLATE BINARY", (self.first,)), *([("key < ? COLLATE BINARY", (self.end,))] if self.end is not None else [])]


class KeyValueSource(D.DataSource):
    """Options: path (several by commas), table, prefix (of keys), slices (tasks a file), push (see read_key_values)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_kv"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> D.DataSourceReader:
        return KeyValueReader(dict(self.options))


class KeyValueReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.table, self.slices = options["path"].split(","), options.get("table", "cursorDiskKV"), int(options.get("slices", 1))
        self.push = options.get("push", "false") == "true"
        self.pushed: list[Clause] = [starts_with(options["prefix"])] if options.get("prefix") else []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            clause = clause_of(f) if self.push else None
            if clause is None:
                yield f
            else:
                self.pushed.append(clause)

    def _ranges(self, path: str) -> list[KeyRange]:
        """Ranges of about equal rows among those that the filters leave."""
        if self.slices < 2:
            return [KeyRange(path)]
        where, values = _where(self.pushed)
        source = f"FROM {_table(self.table)} WHERE {where}"
        with _opened(path) as con:
            n = con.execute(f"SELECT count(*) {source}", values).fetchone()[0]
            places = sorted({n * i // self.slices for i in range(1, self.slices)} - {0})
            cuts = [con.execute(f"SELECT key {source} ORDER BY key COLLATE BINARY LIMIT 1 OFFSET ?", (*values, p)).fetchone()[0] for p in places]
        ends = [None, *sorted({c for c in cuts if c is not None}, key=lambda k: k.encode()), None]
        return [KeyRange(path, a, b) for a, b in zip(ends, ends[1:])]

    def partitions(self) -> list[D.InputPartition]:
        return [r for path in self.paths for r in self._ranges(path)]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        with _opened(partition.path) as con:
            held: list[tuple] = []
            for row in _selected(con, self.table, [*self.pushed, *partition.clauses()]):
                held.append(row)
                if len(held) == BATCH_ROWS:
                    yield _batch(held)
                    held = []
            if held:
                yield _batch(held)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], pa.string()) for i in (0, 1)], schema=_SCHEMA)


def read_key_values(spark: SparkSession, path: str, table: str = "cursorDiskKV", slices: int = 1, push: bool = False) -> DataFrame:
    """(key, value) of a file or several (by commas).

    With ``push``, filters on the key go into the files' queries.  Spark 4.1 keeps what was pushed with the loaded
    DataFrame and not with the plan, so such a DataFrame may stand in one place under one filter only: read again for
    another filter.  Without it, a DataFrame may be filtered in any number of ways, and Spark filters the rows.
    """
    spark.dataSource.register(KeyValueSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite_kv").option("path", path).option("table", table).option("slices", slices).option("push", str(push).lower()).load()
