"""Near-duplicate groups by SimHash links that are verified by exact Jaccard similarity, and the rest of the pairs.

A pair is linked if the sets of its shingles have a Jaccard similarity of ``SIMILARITY`` or more.
Close fingerprints, found by the vantage-point trees of ``simhash``, are the first candidates. Similar texts
differ in more bits than trees can search, so that the rest comes from prefixes: under any one order of
all shingles, two such sets of which the larger has n shingles share ``SIMILARITY * n`` of them, so the first
``n - SIMILARITY * n + 1`` of each set have one in common. No pair is lost by that, and each candidate is
verified. The first token that two sets share, at place i of n and j of m in the order, leaves at most ``min(n - i, m - j)`` in
common, and of the smaller set a shorter prefix will do. The next test is by parity marks: a bit for each hash value modulo the mark's length tells whether an odd number of
shingles fell there, so that two sets differ in at least as many shingles as their marks differ in bits. Only pairs
that this leaves possible are compared as sets. A mark of 256 bits travels with each shared token, so that the join itself
leaves out most pairs of a crowd that shares a token without being similar. Shingles that are frequent in a sample of texts are last in
the order; the sample alters speed alone.

Together with the fingerprints' candidates up to three leaders for each prefix shingle are compared, which is
linear in the rows and gathers large groups of near copies; after that only pairs that aren't yet in one component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_order, forget, only_cache, written
from .components import connected_components
from .simhash import RADIUS, links as close_fingerprints, of_hashes, shingle_hashes

#: Least similarity of linked texts, and words in a shingle.
SIMILARITY, SHINGLE = 0.8, 5
#: Columns with a set's mark of 256 bits.
SHORT = ["_s0", "_s1", "_s2", "_s3"]
#: Texts sampled to tell frequent shingles, texts of the sample that make one frequent, most of them told.
SAMPLE_ROWS, FREQUENT, MOST_FREQUENT = 8192, 4, 1 << 18


def _prefix(grams: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the common order: seldom ones by hash, then frequent ones, most frequent last."""
    n = len(grams)
    length = n - math.ceil(round(similarity * n, 6)) + 1 if n else 0
    rank = np.zeros(n, np.int64)
    if len(common):
        order = np.argsort(common)
        at = np.minimum(np.searchsorted(common, grams, sorter=order), len(common) - 1)
        rank = np.where(common[order[at]] == grams, order[at] + 1, 0)
    return grams[np.lexsort((grams, rank))[:length]]


def _mark(grams: np.ndarray) -> bytes:
    """The parity of the number of shingles by hash modulo a power of two, as large as the set at least."""
    size = 1 << max(6, (len(grams) - 1).bit_length())
    odd = np.bincount(((grams >> np.uint64(9)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _short_mark(grams: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles by hash modulo 256, as four numbers."""
    odd = np.bincount(((grams >> np.uint64(9)) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _may_be_similar(a: bytes, b: bytes, n: int, m: int, similarity: float) -> bool:
    """Whether marks of sets of n and m shingles allow the similarity: at most (n + m) * (1 - s) / (1 + s) shingles may differ."""
    a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(a) > len(b):  # halves of a mark, one over the other, are the mark of half the length
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-6


def _sets(batches: Iterator[pa.RecordBatch], shingle: int, fps: list[int] | None = None) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches (text last), and the sorted distinct shingles of each row; fps is set to their fingerprints."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, sets = batch.slice(at, 256), []
            if fps is not None:
                fps.clear()
            for t in part.column(part.num_columns - 1):
                hashes = shingle_hashes(t.as_py(), shingle)
                if fps is not None:
                    fps.append(of_hashes(hashes))
                sets.append(np.unique(hashes))
            yield part, sets


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64)))


def _key(grams: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(grams.tobytes(), 7)


def _frequent(texts: DataFrame, shingle: int) -> np.ndarray:
    """Frequent shingles of a sample, in ascending frequency."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("jaccard")
        for _, sets in _sets(batches, shingle):
            yield pa.record_batch([pa.array(np.concatenate(sets).view(np.int64))], names=["gram"])

    share = min(1.0, SAMPLE_ROWS / max(1, texts.count()))
    sample = texts.where(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * SAMPLE_ROWS).select("text")
    counts = sample.mapInArrow(make, "gram long").groupBy("gram").count().where(F.col("count") >= FREQUENT)
    found = counts.orderBy(F.desc("count"), "gram").limit(MOST_FREQUENT).toPandas()
    return found.gram.to_numpy(np.int64).view(np.uint64)[::-1].copy()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, kept) for every row of ``docs``.

    Words and shingles are those of ``simhash``: fewer words than a shingle are one shingle. Texts
    without words (null, empty) are one group. Groups are the components of the links; ``kept``
    marks the first row of each in the order of id (a missing one last) and text hash, and any row
    that repeats both.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    common = spark.sparkContext.broadcast(_frequent(own, shingle))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("jaccard")
        fps: list[int] = []
        for part, sets in _sets(batches, shingle, fps):
            keys = np.array([_key(s) for s in sets], np.uint64).view(np.int64)
            sizes = pa.array([len(s) for s in sets], pa.int32())
            yield pa.record_batch([part.column(0), part.column(1), pa.array(keys), pa.array(np.array(fps, np.uint64).view(np.int64)), sizes, pa.array([_mark(s) for s in sets], pa.binary()), _lists([_short_mark(s).view(np.uint64) for s in sets]), _lists([_prefix(s, common.value, similarity) for s in sets])], names=["doc_id", "text_hash", "key", "fp", "n", "mark", "short", "prefix"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, shingle):
            yield pa.record_batch([part.column(0), _lists(sets)], names=["key", "grams"])

    made = written(own.mapInArrow(make, "doc_id long, text_hash long, key long, fp long, n int, mark binary, short array<long>, prefix array<long>"))
    first = written(made.groupBy("key").agg(F.min(F.struct(doc_order(F.col("doc_id")).alias("id"), "text_hash")).alias("_first")))
    rows = made.select(F.posexplode("prefix").alias("place", "token"), "key", "n", *(F.get("short", F.lit(k)).alias(c) for k, c in enumerate(SHORT)))
    repeated = written(rows.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("token"))
    shared = written(rows.join(repeated, "token").dropDuplicates(["token", "key"]))
    forget(repeated)
    marks = written(made.select("key", "n", "mark").dropDuplicates(["key"]))

    def near(n: Column, m: Column) -> Column:
        return F.least(n, m) >= F.lit(similarity) * F.greatest(n, m) - 1e-6

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_may_be_similar(x, y, n, m, similarity) for x, y, n, m in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs that are similar, told by marks and then by the sets of those that are left."""
        sides = [marks.select(F.col("key").alias(k), F.col("mark").alias(f"_{k}"), F.col("n").alias(f"_n{k}")) for k in "ab"]
        likely = written(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "_a", "_b", "_na", "_nb").mapInArrow(sieve, "a long, b long"))
        wanted = written(first.join(likely.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key").select(F.col("_first.id").alias("_id"), F.col("_first.text_hash").alias("_t"), "key"))
        # One text for each set that is left, as the set itself.
        texts = own.join(wanted, (doc_order(F.col("doc_id")) == F.col("_id")) & (F.col("text_hash") == F.col("_t"))).select("key", "text")
        sets = written(texts.mapInArrow(grams, "key long, grams array<long>").dropDuplicates(["key"]))
        both = likely.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("_a")), "a").join(sets.select(F.col("key").alias("b"), F.col("grams").alias("_b")), "b")
        both = both.select("a", "b", (F.size("_a") + F.size("_b")).alias("_n"), F.size(F.array_intersect("_a", "_b")).alias("_m"))
        found = written(both.where(F.col("_m") >= F.lit(similarity) * (F.col("_n") - F.col("_m")) - 1e-6).select("a", "b"))
        forget(likely, wanted, sets)
        return found

    # Sets of one fingerprint meet its first one; first ones of close fingerprints meet each other.
    printed = made.select("key", "fp").distinct()
    firsts = written(printed.groupBy("fp").agg(F.min("key").alias("first"), F.max("key").alias("last")))
    close = written(close_fingerprints(firsts, radius))
    told = close.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("_a")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("_b")), "b").select("_a", "_b")
    same = printed.join(firsts.where("first <> last"), "fp").select(F.col("key").alias("_a"), F.col("first").alias("_b")).where("_a <> _b")
    proposed = told.union(same).select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b"))

    ranks = [F.col("key"), -F.col("key"), F.xxhash64("key")]
    leaders = shared.groupBy("token").agg(*(F.min(F.struct(r.alias("r"), F.col("key").alias("k"), F.col("n").alias("m"))).alias(f"_{i}") for i, r in enumerate(ranks)))
    led = shared.join(leaders.select("token", F.array("_0", "_1", "_2").alias("_l")), "token").select("key", "n", F.explode("_l").alias("_l"))
    by_leaders = led.where((F.col("key") != F.col("_l.k")) & near(F.col("n"), F.col("_l.m"))).select(F.greatest("key", "_l.k").alias("a"), F.least("key", "_l.k").alias("b"))
    pairs = written(by_leaders.union(proposed).distinct())
    linked = links(pairs)
    roots = connected_components(linked).select(F.col("node").alias("key"), "root")
    told = written(shared.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))
    # b is the smaller set of a pair, or the one with the smaller key: at least 2s / (1 + s) of it is shared.
    share = F.lit(similarity / (1 + similarity))
    index = told.where(F.col("n") - F.col("place") >= 2 * share * F.col("n") - 1e-6)
    other = index.select("token", F.col("key").alias("b"), F.col("n").alias("m"), F.col("root").alias("_r"), F.col("place").alias("_p"), *(F.col(c).alias(f"{c}b") for c in SHORT))
    total = F.col("n") + F.col("m")
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}b"))) for c in SHORT), F.lit(0))
    larger = (F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("a") > F.col("b")))
    fits = near(F.col("n"), F.col("m")) & (F.least(F.col("n") - F.col("place"), F.col("m") - F.col("_p")) >= share * total - 1e-6)
    fits &= apart <= total * F.lit((1 - similarity) / (1 + similarity)) + 1e-6
    rest = told.withColumnRenamed("key", "a").join(other, "token").where(larger & (F.col("root") != F.col("_r")) & fits)
    rest = rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    more = links(rest.distinct().join(pairs, ["a", "b"], "left_anti"))
    forget(shared, pairs, told, marks)
    roots = connected_components(linked.union(more)).select(F.col("node").alias("key"), "root")

    members = written(first.join(roots, "key", "left"))
    lowest = written(members.where("root IS NOT NULL").groupBy("root").agg(F.min("_first").alias("_low")))
    ids = members.join(lowest, "root", "left").select(F.col("key").alias("_key"), F.coalesce("_low", "_first").alias("_low"))
    mine = F.struct(doc_order(F.col("doc_id")).alias("id"), "text_hash")
    return made.drop("prefix", "mark", "short").join(ids, made.key == ids._key).select("doc_id", "text_hash", (mine == F.col("_low")).alias("kept"))
