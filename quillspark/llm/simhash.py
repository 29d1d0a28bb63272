"""SimHash near-duplicates: vantage-point trees over fingerprint blocks, exact links, connected components.

A pair at Hamming distance ``radius`` or less agrees wholly on one of ``radius + 1`` blocks of the fingerprint
(pigeonhole), so each block has a vantage-point tree of its own: a level splits by the distance to its vantage
point, and the triangle bound prunes every shell that is further from the query's than the radius left to a
block, which is zero.  A fingerprint thus has exactly one leaf in each tree and no boundary overlap has to be
queried elsewhere.  (Over whole fingerprints, nearly half of them lie within two bits of the median shell: a
tree over 64 bits would query almost everything.)  Leaves are compared exactly.  A leaf too large to compare
uses another exact way: two fingerprints within two bits share a neighbour within one bit, and at most 65
fingerprints share one neighbour, whatever the size of the leaf.  At a wider radius such a leaf is dealt into parts, and
every two of them are compared in a group of their own.

Edge cases: null and empty texts have fingerprint zero, linked like any other; repeated rows give equal rows;
an empty table gives none; null doc_ids get the smallest id of their component, or null if it has none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import free, materialize, modest, rows, small, table
from quillspark.operators.components import components

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Levels of a block's tree, and the leaf size from which the other exact way is taken.
LEVELS, LEAF = 8, 512


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles (repeats included)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return int.from_bytes(digest(b" ".join(words), SEED), "big")
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return majority(np.frombuffer(b"".join([digest(g, SEED) for g in grams]), dtype=np.uint8).reshape(-1, 8))


def majority(h: np.ndarray) -> int:
    """Unsigned fingerprint of hashes (big-endian bytes, one row a hash): the bits that over half of them have."""
    ones = np.unpackbits(h, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


@F.pandas_udf(T.LongType())
def fingerprint_column(texts: pd.Series) -> pd.Series:
    """Fingerprints as signed longs."""
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64), dtype="int64")


def block_masks(blocks: int) -> list[int]:
    """Bit masks of nearly equal blocks that cover 64 bits."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in pairwise(cuts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def vantage_points(prints: DataFrame, levels: int = LEVELS) -> list[int]:
    """The fingerprints with the smallest hashes (a bounded sample), padded by fixed ones if there are fewer."""
    found = [r["fp"] for r in prints.select("fp", F.xxhash64("fp").alias("o")).orderBy("o", "fp").limit(levels).collect()]
    return found + [_signed(xxhash.xxh64_intdigest(str(i), SEED)) for i in range(levels - len(found))]


def leaf(fp: Column, mask: int, points: list[int]) -> Column:
    """The leaf of a block's tree: its path of distances to the vantage points, as one number."""
    path = F.lit(0).cast("long")
    for p in points:
        path = path * (mask.bit_count() + 1) + F.bit_count((fp.bitwiseXOR(F.lit(p))).bitwiseAND(F.lit(_signed(mask)))).cast("long")
    return path


def _leaf_links(batches: Iterable[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links inside each leaf: exact comparison in blocks of rows, one edge a merge."""
    for b in rows(batches, 64):
        left, right = [], []
        for prints in b.column(0):
            x = prints.values.to_numpy(zero_copy_only=False)
            bits = x.view(np.uint64)  # of a negative number, bitwise_count counts those of its absolute value
            root = list(range(len(x)))

            def find(i: int, root: list[int] = root) -> int:
                while root[i] != i:
                    root[i] = i = root[root[i]]
                return i

            for k in range(0, len(x), LEAF):
                met = np.bitwise_count(bits[k : k + LEAF, None] ^ bits[None, k:]) <= radius
                for i, j in zip(*np.nonzero(np.triu(met, 1))):
                    a, c = find(int(i) + k), find(int(j) + k)
                    if a != c:
                        root[max(a, c)] = min(a, c)
                        left.append(int(x[i + k]))
                        right.append(int(x[j + k]))
        yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def links(prints: DataFrame, leaf_size: int = LEAF, levels: int = LEVELS, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints (column fp) exactly as distance <= radius does."""
    points = vantage_points(prints, levels)
    trees = F.array(*[F.struct(F.lit(i).alias("tree"), leaf(F.col("fp"), m, points).alias("leaf")) for i, m in enumerate(block_masks(radius + 1))])
    keyed = prints.select("fp", F.explode(trees).alias("k")).select("fp", "k.tree", "k.leaf")
    hot = materialize(keyed.groupBy("tree", "leaf").count().filter(F.col("count") > leaf_size).select("tree", "leaf", F.ceil(F.col("count") / leaf_size).alias("parts")), "hot-leaves")
    some_hot = not hot.isEmpty()
    cold = keyed
    if some_hot:
        key = F.broadcast(hot) if small(hot, 64) else hot
        cold = keyed.join(key, ["tree", "leaf"], "left_anti")
    cold = cold.groupBy("tree", "leaf").agg(F.collect_list("fp").alias("prints")).filter(F.size("prints") > 1).select("prints")
    compare = lambda batches: _leaf_links(batches, radius)
    found = cold.mapInArrow(compare, "a long, b long")
    if some_hot and radius <= 2:
        one_bit = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
        crowd = keyed.join(key, ["tree", "leaf"], "left_semi").select("fp").distinct()
        near = crowd.select("fp", F.explode(one_bit).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
        met = near.groupBy("centre").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("prints")).filter(F.size("prints") > 1)
        found = found.unionAll(met.select("a", F.explode("prints").alias("b")).filter(F.col("a") != F.col("b")).distinct())
    elif some_hot:
        # every two parts of a hot leaf meet in a group of their own
        dealt = keyed.join(key, ["tree", "leaf"]).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")))
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: o != F.col("mine"))
        dealt = dealt.select("tree", "leaf", "fp", "mine", F.explode(others).alias("other"))
        both = dealt.groupBy("tree", "leaf", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        found = found.unionAll(both.agg(F.collect_list("fp").alias("prints")).select("prints").mapInArrow(compare, "a long, b long"))
    return found


def classes(tagged: DataFrame) -> DataFrame:
    """(fp, root) of each distinct fingerprint of a durable table with column fp."""
    prints = materialize(tagged.select("fp").distinct(), "prints")
    return prints.join(components(links(prints)), prints["fp"] == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every row."""
    modest(docs.sparkSession)
    tagged = materialize(docs.select(F.col("doc_id").cast("long"), fingerprint_column(F.col("text").cast("string")).alias("fp")), "simhash")
    by_print = materialize(classes(tagged), "classes")
    least = tagged.groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = by_print.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(by_print.join(ids, "root").select("fp", "component_id"), "components")
    return tagged.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest doc_id stays."""
    row, mark = free(docs, "_simhash_row"), free(docs, "_simhash_fp")
    whole = materialize(docs.withColumns({row: F.monotonically_increasing_id(), mark: fingerprint_column(F.col("text").cast("string"))}), "simhash-rows")
    tagged = whole.select(F.col(mark).alias("fp"), F.col(row).alias("rid"), F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(row).alias("rid")).alias("rank"))
    by_print = materialize(classes(tagged), "classes")
    least = tagged.groupBy("fp").agg(F.min("rank").alias("least"))
    first = materialize(by_print.join(least, "fp").groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.rid").alias(row)), "simhash-kept")
    key = F.broadcast(first) if small(first, 64) else first
    return whole.join(key, row, "left_semi").drop(row, mark)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
ORACLE_SQL: dict[str, str] = {}
