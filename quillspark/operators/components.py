"""Connected components of an edge table by alternating large and small stars.

Every step only moves edges towards the smallest neighbour and is a grouped minimum (partial, so a hot node
is combined before the shuffle), written and joined back by node (a join of two plain tables, in which Spark
can split the rows of a hot node).  Before the first round and after each, a task turns every run of a bounded number of
its edges into stars, which leaves a small table nothing to do.  Edges whose minima are within the broadcast bound take
one plan a round and write only its result.  No links or components reach the driver, only two values a round: the
number of edges and whether every component is a star by now.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.durable import BROADCAST_BYTES, materialize

#: Edges of a task that are turned into stars at a time.
RUN = 1 << 18


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Each node of the edges but the smallest of its component, with that one: the same components, no more edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root, last = np.arange(len(nodes)), None
    while last is None or (root != last).any():
        last, root = root, root.copy()
        low = np.minimum(last[x], last[y])
        np.minimum.at(root, last[x], low)
        np.minimum.at(root, last[y], low)
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(nodes))
    return pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["a", "b"])


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        run.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(a) for a, _ in run) >= RUN:
            yield _stars(*map(np.concatenate, zip(*run)))
            run = []
    if run:
        yield _stars(*map(np.concatenate, zip(*run)))


def _written(edges: DataFrame) -> DataFrame:
    """Durable table a, b with the components of ``edges``, most of them as stars."""
    return materialize(edges.distinct().mapInArrow(_contract, "a long, b long"), "edges")


def _settled(edges: DataFrame) -> tuple[int, bool]:
    """The number of edges, and whether each node either is linked to one smaller node and to nothing else, or to larger ones only."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")
    each = edges.select(ends).select("e.node", "e.up").groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    r = each.agg(F.sum("up").alias("n"), F.bool_and((F.col("up") == 0) | ((F.col("up") == 1) & (F.col("least") == 1))).alias("stars")).first()
    return r["n"] or 0, r["stars"]


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = edges.select(ends).select("e.a", "e.b")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    least = F.broadcast(least) if few else materialize(least, "star")
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    least = F.broadcast(least) if few else materialize(least, "star")
    return down.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long); the root is the component's smallest node.

    Null ends and loops are ignored; an empty edge table gives an empty result.
    """
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), (F.col("a") != F.col("b")).alias("apart"))
    now = _written(down.filter("apart").select(F.col("a").cast("long"), F.col("b").cast("long")))
    n, stars = _settled(now)
    while n and not stars:
        few = 2 * n * 64 <= BROADCAST_BYTES
        moved = _large_star(now, few)
        moved = _small_star(moved if few else materialize(moved, "edges"), few)
        now = _written(moved.filter(F.col("a") != F.col("b")))
        n, stars = _settled(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
