"""Near-duplicate stage: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Exact.  First the method of op8: SimHashes of the sets, vantage-point trees that find those within RADIUS bits, an exact
check of these candidates, components.  Such pairs lie up to 14 bits and more apart, though, where no tree prunes (of the
48 in documents at sf0.1, 4 are within five bits); all others are found by a join:

1.  Two such sets share a shingle among the first ``n - ceil(0.8 n) + 1`` of each in any common order (prefix filter),
    so only prefixes are joined, and of them only shingles that stand in several.  The order has the shingles that
    stand in several first prefixes behind those that do not (a bit map of fixed size) and those that a
    bounded sample shows often at its end, so that boilerplate and chance seldom meet; map and sample change the time
    taken, never the result.
2.  The members of a shingle that are not in the component of one of them are compared with it alone (a star), and those
    of other components than its with another one, and so on for STARS rounds.  That joins most of a group of
    copies at a linear number of comparisons; then only members of different components are compared in pairs.
3.  A pair's signatures, eight or more parity bits a shingle, differ in at most as many bits as the sets differ
    in shingles.  This bound, in the join itself and on short signatures first, leaves hardly more than the similar
    pairs, whose whole sets are then intersected.

Texts of equal words are one node.  Shingles are 64-bit hashes of lower-cased (A-Z) words.

Edge cases: a text of fewer than five words is one shingle; null and empty texts have the same, empty set; very long
texts cost in proportion to their length; repeated rows are one group; an empty
table gives none; of a component the row with the smallest doc_id stays, one without doc_id only if none has one;
other columns are kept.  Members of one shingle that no star joins are compared in pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import free, materialize, modest, rows, small
from quillspark.llm.simhash import SEED, majority
from quillspark.llm.simhash import links as tree_links
from quillspark.operators.components import components

SHINGLE = 5
#: A shingle's hash: its words' hashes times one odd factor for each place, summed, and mixed by shifts and factors.
FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
MIX = [(np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB))]
#: Least similarity, as a fraction.
NUM, DEN = 4, 5
#: Rows of the sample for the order, rows there from which a shingle counts as often seen, most shingles kept of them.
SAMPLE, OFTEN, MOST = 20_000, 3, 1 << 18
#: Bits of the map of shared shingles that goes to all tasks (8 MB at any input size).
MAP_BITS = 1 << 26
#: Words of the short signatures that pairs are judged by first.
BRIEF = 8
#: Fingerprint bits within which the trees search, and the leaf size from which a leaf is dealt into parts.
RADIUS, LEAF = 5, 1024
#: Rounds of stars before pairs.
STARS = 2
#: Members of a shingle from which a pair is one row of the join, not one for each shingle it shares.
CROWD = 64


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    words = lowered(text)
    if not words:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_digest
    if len(words) < SHINGLE:
        return np.frombuffer(digest(b" ".join(words), SEED), dtype="<i8")
    h = np.frombuffer(b"".join([digest(w, SEED) for w in words]), dtype="<u8")
    n = len(h) - SHINGLE + 1
    x = h[:n] * FACTORS[0]
    for i in range(1, SHINGLE):
        x += h[i : i + n] * FACTORS[i]
    for shift, factor in MIX:
        x ^= x >> shift
        x *= factor
    x ^= x >> np.uint64(32)
    x = np.sort(x.view(np.int64))
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def lowered(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def often_seen(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that several rows of a bounded sample hold, and in how many."""
    texts = docs.select(F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    share = min(1.0, SAMPLE / max(1, texts.count()))
    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))).distinct()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            found = [shingles(t) for t in b.column(0).to_pylist()]
            if found:
                yield pa.record_batch([pa.array(np.concatenate(found))], names=["t"])

    seen = sample.mapInArrow(cut, "t long").groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    found = seen.orderBy(F.desc("n"), "t").limit(MOST).toArrow().sort_by("t")
    return found["t"].to_numpy(), found["n"].to_numpy()


def signature(h: np.ndarray) -> np.ndarray:
    """Parity bits of a set's hashes, eight or more bits a shingle (a power of two, whole words)."""
    bits = max(64, 1 << max(0, 8 * len(h) - 1).bit_length())
    return parity(h, bits)


def parity(h: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the hashes at each of ``bits`` places (a power of two, 64 at least), as whole words."""
    odd = np.bincount((h & (bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def simhash(h: np.ndarray) -> int:
    """The set's SimHash, of 64 bits, as a signed long."""
    x = majority(h.astype(">i8").view(np.uint8).reshape(-1, 8)) if len(h) else 0
    return x - (1 << 64) if x >> 63 else x


def with_words(docs: DataFrame, name: str = "_near_words") -> DataFrame:
    """``docs`` with the column ``name``, the digest of each row's words in their order."""
    at = docs.columns.index("text")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            words = [xxhash.xxh3_128_digest(b" ".join(lowered(t))) for t in b.column(at).to_pylist()]
            yield pa.record_batch([*b.columns, pa.array(words, pa.binary())], names=[*b.schema.names, name])

    return docs.mapInArrow(cut, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


class Order:
    """The common order of shingles: seldom seen ones first, by the bit map, the sample's count and the hash."""

    def __init__(self, often: np.ndarray, times: np.ndarray, bitmap: np.ndarray | None = None):
        self.often, self.times, self.bitmap = often, times, bitmap

    def prefix(self, h: np.ndarray) -> np.ndarray:
        n = len(h)
        if not n:
            return h
        keys = [h]
        if len(self.often):
            i = np.minimum(np.searchsorted(self.often, h), len(self.often) - 1)
            keys.append(np.where(self.often[i] == h, self.times[i], 0))
        if self.bitmap is not None:
            keys.append(self.known(h))
        return h[np.lexsort(keys)][: n - -(-NUM * n // DEN) + 1]

    def known(self, h: np.ndarray) -> np.ndarray:
        low = h & (MAP_BITS - 1)
        return (self.bitmap[low >> 6] >> (low & 63)) & 1


def shared_shingles(each: DataFrame) -> DataFrame:
    """Durable table t, first (the smallest id) of the shingles that several rows of each (id, t) have."""
    found = each.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("first")).filter(F.col("c") > 1)
    return materialize(found.select("t", "first"), "near-shared")


def bit_map(shared: DataFrame) -> np.ndarray:
    """Map of MAP_BITS bits, one set for each shingle of ``shared``: at most MAP_BITS / 64 rows reach the driver."""
    place = F.col("t").bitwiseAND(F.lit(MAP_BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = shared.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def with_prefixes(texts: DataFrame, sample: DataFrame) -> DataFrame:
    """id, n (size of the set), prefix (its rarest shingles), signature, brief (short signature), fp (SimHash) of texts (id, text)."""
    spark, often = texts.sparkSession, often_seen(sample)
    first = spark.sparkContext.broadcast(Order(*often))

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = first.value
        for b in rows(batches):
            found = [order.prefix(shingles(t)) for t in b.column(1).to_pylist()]
            if found:
                owner = np.repeat(np.arange(b.num_rows), [len(f) for f in found])
                yield pa.record_batch([b.column(0).take(pa.array(owner)), pa.array(np.concatenate(found))], names=["id", "t"])

    seen = shared_shingles(texts.select("id", "text").mapInArrow(tokens, "id long, t long"))
    second = spark.sparkContext.broadcast(Order(*often, bit_map(seen)))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = second.value
        for b in rows(batches):
            found = [shingles(t) for t in b.column(1).to_pylist()]
            lists = [pa.array([f(h) for h in found], pa.list_(pa.int64())) for f in (order.prefix, signature, lambda h: parity(h, 64 * BRIEF))]
            columns = [pa.array([len(h) for h in found], pa.int32()), *lists, pa.array([simhash(h) for h in found], pa.int64())]
            yield pa.record_batch([b.column(0), *columns], names=["id", "n", "prefix", "signature", "brief", "fp"])

    return texts.select("id", "text").mapInArrow(cut, "id long, n int, prefix array<long>, signature array<long>, brief array<long>, fp long")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _shingle_column(texts):  # noqa: ANN001, ANN202
    return texts.map(shingles)


def members(nodes: DataFrame) -> DataFrame:
    """Durable table t, id, n, first of the shingles that stand in several prefixes (first: the smallest id of t)."""
    shared = shared_shingles(nodes.select("id", F.explode("prefix").alias("t")))
    everywhere = nodes.sparkSession.sparkContext.broadcast(Order(np.zeros(0), np.zeros(0), bit_map(shared)))

    def some(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefixes = b.column(2)
            t = prefixes.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(b.num_rows), prefixes.value_lengths().to_numpy(zero_copy_only=False))
            keep = everywhere.value.known(t) == 1
            owner = pa.array(owner[keep])
            yield pa.record_batch([b.column(0).take(owner), b.column(1).take(owner), pa.array(t[keep])], names=["id", "n", "t"])

    each = nodes.select("id", "n", "prefix").mapInArrow(some, "id long, n int, t long")
    side = F.broadcast(shared) if small(shared, 64) else shared
    return materialize(each.join(side, "t").select("t", "id", "n", "first"), "near-members")


def fold(s: Column, size: Column) -> Column:
    """A signature of up to twice ``size`` words as one of ``size`` words (the parity bits of its halves together)."""
    return F.when(F.size(s) > size, F.zip_with(F.slice(s, F.lit(1), size), F.slice(s, size + 1, size), lambda x, y: x.bitwiseXOR(y))).otherwise(s)


def may_be_similar(n: Column, m: Column, x: Column, y: Column) -> Column:
    """Bounds that similar sets keep: their sizes n and m, then the bits in which their signatures x and y differ."""
    size = F.least(F.size(x), F.size(y))  # of similar sets, one is at most twice the other
    apart = F.aggregate(F.zip_with(fold(x, size), fold(y, size), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, p: a + p)
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & ((NUM + DEN) * apart <= (DEN - NUM) * (n + m))


def may_meet(n: Column, m: Column, x: Column, y: Column) -> Column:
    """The same bounds on signatures of BRIEF words, without a loop: cheap, but weak on sets of thousands of shingles."""
    apart = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BRIEF)), F.lit(0))
    return (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & ((NUM + DEN) * apart <= (DEN - NUM) * (n + m))


def similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The durable table of those pairs (a, b) that are similar enough: by sizes, signatures, then whole sets."""
    marks = nodes.select("id", "n", "signature")
    mark = lambda k, n, s: marks.select(F.col("id").alias(k), F.col("n").alias(n), F.col("signature").alias(s))
    near = pairs.join(mark("a", "n", "x"), "a").join(mark("b", "m", "y"), "b").filter(may_be_similar(*map(F.col, "nmxy")))
    near = materialize(near.select("a", "b"), "near-candidates")
    ends = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    ends = F.broadcast(ends) if small(near, 128) else ends
    sets = materialize(texts.join(ends, "id", "left_semi").select("id", _shingle_column("text").alias("set")), "near-sets")
    both = near.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return materialize(both.filter((NUM + DEN) * common >= NUM * (F.size("x") + F.size("y"))).select("a", "b"), "near-links")


def near_prints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids that connect those whose SimHashes are at most RADIUS bits apart, found by the trees of op8."""
    least = materialize(nodes.groupBy("fp").agg(F.min("id").alias("least")), "near-prints")
    near = tree_links(least.select("fp"), leaf_size=LEAF, radius=RADIUS)
    end = lambda k, to: least.select(F.col("fp").alias(k), F.col("least").alias(to))
    apart = near.join(end("a", "x"), "a").join(end("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    equal = nodes.join(least, "fp").filter(F.col("id") != F.col("least")).select(F.col("least").alias("a"), F.col("id").alias("b"))
    return apart.unionAll(equal).distinct()


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the rows of two durable tables (those of with_prefixes; id, text), one a distinct
    text, exactly as a similarity of NUM / DEN does."""
    found = similar(near_prints(nodes), nodes, texts)
    roots = materialize(components(found), "near-roots")
    side = F.broadcast(roots) if small(roots, 64) else roots
    root_of = lambda k, to: side.select(F.col("node").alias(k), F.col("root").alias(to))
    each = members(nodes).join(root_of("id", "root"), "id", "left").join(root_of("first", "_root"), "first", "left")
    each = each.select("t", "id", "n", F.coalesce("root", "id").alias("root"), "first", F.coalesce("_root", "first").alias("_root"))
    for k in range(STARS):
        # the centre of a shingle has met all its other members after this round and leaves
        if k == 0:
            centred = each.withColumnRenamed("first", "centre")
        else:
            centre = each.groupBy("t").agg(F.min(F.struct(F.xxhash64("id", F.lit(k)), F.col("id"), F.col("root"))).alias("c"), F.max("root").alias("hi"), F.min("root").alias("lo")).filter(F.col("lo") < F.col("hi"))
            centre = materialize(centre.select("t", F.col("c.id").alias("centre"), F.col("c.root").alias("_root")), "near-centres")
            centred = materialize(each.join(centre, "t"), "near-rest")
        rest = centred.filter(F.col("id") != F.col("centre"))
        pairs = rest.filter(F.col("root") != F.col("_root")).select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).distinct()
        found = found.unionAll(similar(pairs, nodes, texts))
        roots = components(found)
        each = rest.select("t", "id", "n").join(roots, F.col("id") == F.col("node"), "left").select("t", "id", "n", F.coalesce("root", "id").alias("root"))
        each = materialize(each, "near-rest")
    rest = each
    mixed = rest.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), (F.count(F.lit(1)) > CROWD).alias("crowd")).filter(F.col("lo") < F.col("hi"))
    rest = materialize(rest.join(materialize(mixed.select("t", "crowd"), "near-mixed"), "t"), "near-rest")
    mine = materialize(rest.filter("crowd").groupBy("id").agg(F.collect_list("t").alias("mine")), "near-mine")
    rest = rest.join(mine, "id", "left").join(nodes.select("id", "signature", "brief"), "id")
    rest = materialize(rest.select("t", "id", "n", "root", "crowd", F.when(F.col("crowd"), F.col("mine")).alias("mine"), "signature", "brief"), "near-rest")
    other = rest.select(F.col("t").alias("_t"), F.col("id").alias("b"), F.col("n").alias("m"), F.col("root").alias("_root"), F.col("mine").alias("_mine"), F.col("signature").alias("_signature"), F.col("brief").alias("_brief"))
    bounds = may_meet(F.col("n"), F.col("m"), F.col("brief"), F.col("_brief")) & may_be_similar(F.col("n"), F.col("m"), F.col("signature"), F.col("_signature"))
    once = ~F.col("crowd") | (F.col("t") == F.array_min(F.array_intersect("mine", "_mine")))
    met = rest.join(other, (F.col("t") == F.col("_t")) & (F.col("id") < F.col("b")) & (F.col("root") != F.col("_root")) & bounds & once)
    met = materialize(met.select(F.col("id").alias("a"), "b").distinct(), "near-met")
    return found.unionAll(similar(met, nodes, texts))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest doc_id stays."""
    modest(docs.sparkSession)
    row, mark = free(docs, "_near_row"), free(docs, "_near_words")
    whole = materialize(with_words(docs.withColumns({row: F.monotonically_increasing_id(), "text": F.col("text").cast("string")}), mark), "near-rows")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(row).alias("rid"))
    least = materialize(whole.groupBy(mark).agg(F.min(rank).alias("least")).select(F.col("least.rid").alias("id"), "least"), "near-sets-first")
    key = least.select(F.col("id").alias(row))
    key = F.broadcast(key) if small(least, 64) else key
    texts = whole.join(key, row, "left_semi").select(F.col(row).alias("id"), "text")
    nodes = materialize(with_prefixes(texts, docs), "near-nodes")
    roots = components(links(nodes, whole.select(F.col(row).alias("id"), "text")))
    first = least.join(roots, least["id"] == F.col("node"), "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("least").alias("least"))
    first = materialize(first.select(F.col("least.rid").alias(row)), "near-kept")
    key = F.broadcast(first) if small(first, 64) else first
    return whole.join(key, row, "left_semi").select(*docs.columns)
