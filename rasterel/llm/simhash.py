"""SimHash near-duplicate groups (operator 10), linked by vantage-point trees.

Fingerprints are made batch by batch from word shingles. Distinct fingerprints then go to the
shards of a vantage-point tree: at each inner node a point is sent to the near or the far side
by its Hamming distance from the vantage point, and near points within the radius of the
boundary are also sent to the far side as queries. So each close pair meets in exactly one
shard. There, a local tree of the same kind prunes by the triangle inequality down to small
blocks, which are compared bit by bit. A shard returns a spanning forest of its links, not the
pairs; components join the forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, doc_order, fresh, only_cache, written
from .components import connected_components

#: Bits in which linked fingerprints may differ, and words in a shingle.
RADIUS, SHINGLE = 4, 4
#: Fingerprints meant for one shard; at most so many are sampled to place the vantage points.
SHARD_ROWS, SAMPLE_ROWS = 32768, 1 << 16
#: Sampled fingerprints that a shard of the planted tree takes; shards beyond that are split by drawn vantage points.
LEAST_SAMPLE = 16
#: Blocks of this size are compared without further pruning.
LEAF = 256

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_BITS = np.arange(64, dtype=np.uint64)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each word shingle of a text, in order."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # splits at space and \t to \r
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    begins = (ends - size).tolist()
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(begins[:n], ends)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a whole text, unsigned; 0 if it has no word."""
    return of_hashes(shingle_hashes(text, shingle))


def of_hashes(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    n = len(h)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.bitwise_or.reduce(np.where(2 * ones > n, np.uint64(1) << _BITS, np.uint64(0))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id long, text_hash long, fp long) for every row; fp holds the 64 bits as a signed number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("simhash")
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return own.mapInArrow(make, "doc_id long, text_hash long, fp long")


def _distance(points: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ point).astype(np.int16)


def _vantage(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A vantage point and the distance that halves the points best, of a few tried; None if no split helps."""
    best = None
    for v in rng.choice(points, min(6, len(points)), replace=False):
        d = _distance(points, v)
        mu = int(np.median(d))
        mu -= (d <= mu).all()
        near, border = (d <= mu).mean(), ((d <= mu) & (d > mu - RADIUS)).mean()
        cost = near**2 + (1 - near) * (1 - near + border)
        if 0 < near < 1 and (best is None or cost < best[0]):
            best = cost, v, mu
    return best and best[1:]


def plant(sample: np.ndarray, leaves: int, seed: int = 11) -> list[tuple[int, int, int, int]]:
    """Inner nodes (vantage point, boundary, near child, far child) of the tree that places shards.

    A child below 0 is shard ``-1 - child``. The nodes number below ``leaves`` at any table size,
    for the sample that places them has a fixed bound.
    """
    rng, nodes, shards = np.random.default_rng(seed), [], [0]

    def grow(points: np.ndarray, parts: int) -> int:
        split = _vantage(points, rng) if parts > 1 and len(points) > 8 else None
        if split is None:
            shards[0] += 1
            return -shards[0]
        at = len(nodes)
        nodes.append(None)
        near = _distance(points, split[0]) <= split[1]
        nodes[at] = (int(split[0]), split[1], grow(points[near], (parts + 1) // 2), grow(points[~near], parts // 2))
        return at

    grow(sample, leaves)
    return nodes


def _drawn(shard: int) -> tuple[np.uint64, int]:
    """Vantage point and boundary of a node below the planted tree: a hash of its number, and half of the bits."""
    x = (shard * 0x9E3779B97F4A7C15 + 0xD1342543DE82EF95) % 2**64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    return np.uint64(x ^ (x >> 31)), 31 + (x >> 7 & 1)


def route(points: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int = RADIUS, deeper: int = 0) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(shard, points, home) such that a close pair meets in one shard, at least one of the two at home.

    Each shard of the planted nodes is split ``deeper`` times more, by vantage points that follow from
    the shard's number: no table of nodes bounds the number of shards.
    """
    todo = [(0 if nodes else -1, 0, points, True)]
    while todo:
        at, level, own, home = todo.pop()
        if not len(own):
            continue
        if at < 0:
            shard = -1 - at
            if level == deeper:
                yield shard, own, home
                continue
            v, mu = _drawn(shard * 64 + level)
            near_child, far_child = -1 - 2 * shard, -2 - 2 * shard
            level += 1
        else:
            v, mu, near_child, far_child = nodes[at]
        d = _distance(own, np.uint64(v))
        near = d <= mu
        if home:
            todo += [(near_child, level, own[near], True), (far_child, level, own[~near], True), (far_child, level, own[near & (d > mu - radius)], False)]
        else:  # a query goes wherever the triangle bound leaves a match possible
            todo += [(near_child, level, own[d <= mu + radius], False), (far_child, level, own[d > mu - radius], False)]


class _Forest:
    """Union by smallest index over arrays of pairs."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            up = self.roots()
            a, b = up[a], up[b]
            open_ = a != b
            a, b = np.maximum(a, b)[open_], np.minimum(a, b)[open_]
            np.minimum.at(self.up, a, b)


def close_links(home: np.ndarray, guests: np.ndarray, radius: int = RADIUS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as two arrays, of the pairs within ``radius`` among home and between home and guests."""
    points = np.concatenate([home, guests])
    forest, rng = _Forest(len(points)), np.random.default_rng(seed)

    def compare(own: np.ndarray, other: np.ndarray) -> None:
        step = max(1, (1 << 20) // max(1, len(other)))
        for i in range(0, len(own), step):
            a, b = np.nonzero(np.bitwise_count(points[own[i : i + step], None] ^ points[None, other]) <= radius)
            forest.join(own[i + a], other[b])

    def search(own: np.ndarray, visit: np.ndarray) -> None:
        """own: indices whose pairs among themselves and with visit are sought."""
        split = _vantage(points[own], rng) if len(own) > LEAF else None
        if split is None:
            compare(own, np.concatenate([own, visit]))
            return
        v, mu = split
        d, g = _distance(points[own], v), _distance(points[visit], v)
        search(own[d <= mu], visit[g <= mu + radius])
        search(own[d > mu], np.concatenate([own[(d <= mu) & (d > mu - radius)], visit[g > mu - radius]]))

    search(np.arange(len(home)), np.arange(len(home), len(points)))
    up = forest.roots()
    linked = np.flatnonzero(up != np.arange(len(points)))
    return points[linked], points[up[linked]]


def links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, sample_rows: int = LEAST_SAMPLE) -> DataFrame:
    """(a, b), a spanning forest of each shard's pairs of fingerprints (column fp) within ``radius``: it joins what any pair joins."""
    spark = fps.sparkSession
    distinct = written(fps.select("fp").distinct())
    n = distinct.count()
    leaves = max(1, -(-n // shard_rows))
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    # Which vantage points are drawn alters speed alone: any tree finds every pair.
    picked = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * SAMPLE_ROWS).toPandas().fp.sort_values().to_numpy()
    nodes = plant(picked.astype(np.int64).view(np.uint64), min(leaves, max(1, len(picked) // sample_rows)))
    deeper = max(0, math.ceil(math.log2(leaves / (len(nodes) + 1))))
    tree = spark.sparkContext.broadcast(nodes)  # at most 2 * SAMPLE_ROWS / LEAST_SAMPLE nodes

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, own, home in route(points, tree.value, radius, deeper):
                yield pa.record_batch([pa.array(np.full(len(own), shard, np.int64)), pa.array(own.view(np.int64)), pa.array(np.full(len(own), home))], names=["shard", "fp", "home"])

    def link(rows: pa.Table) -> pa.Table:
        own = rows.column("fp").to_numpy().view(np.uint64)
        home = rows.column("home").to_numpy(zero_copy_only=False)
        order = np.argsort(own, kind="stable")  # the outcome doesn't depend on the order of arrival
        own, home = own[order], home[order]
        a, b = close_links(own[home], own[~home], radius)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    sent = distinct.mapInArrow(send, "shard long, fp long, home boolean")
    return sent.groupBy("shard").applyInArrow(link, "a long, b long")


def link_components(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, sample_rows: int = LEAST_SAMPLE) -> DataFrame:
    """(fp, root) of the fingerprints in the column fp that are within ``radius`` of another one."""
    return connected_components(links(fps, radius, shard_rows, sample_rows)).select(F.col("node").alias("fp"), "root")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, kept) for every row of ``docs``.

    Words are what stands between characters of ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; shingles
    are joined by one space, repeats count. Fewer words than a shingle are one shingle; a text
    without words (null, empty) has fingerprint 0, linked like any other. component_id is the
    smallest id reachable over links of at most ``radius`` bits, the row's own included. A missing
    id counts as larger than any other; component_id is null if no row of the component has one.
    ``kept`` marks the component's first row in the order of id and text hash (and any row that
    repeats both). Other columns aren't read.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle))
    linked = link_components(fps, radius, shard_rows)
    own = F.struct(doc_order(F.col("doc_id")).alias("id"), "text_hash")
    first = fps.groupBy("fp").agg(F.min(own).alias("_first"))
    # Only linked fingerprints meet their component; with plain tables on both sides Spark splits a large one.
    members = written(first.join(linked, "fp", "left").select("fp", "_first", "root"))
    lowest = written(members.where("root IS NOT NULL").groupBy("root").agg(F.min("_first").alias("_low")))
    ids = members.join(lowest, "root", "left").select(F.col("fp").alias("_fp"), F.coalesce("_low", "_first").alias("_low"))
    return fps.join(ids, fps.fp == ids._fp).select("doc_id", "text_hash", "fp", F.nullif(F.col("_low.id"), F.lit(NO_ID)).alias("component_id"), (own == F.col("_low")).alias("kept"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns kept.

    It is the row with the smallest id and, of rows with one id, the smallest text hash; of rows
    that repeat both, any one. With ``similarity`` fingerprints only propose links: texts are linked by
    an exact Jaccard similarity of their shingles, and pairs beyond the radius are found as well (``jaccard``).
    """
    d, t = fresh(docs, "_d", "_t")
    if similarity is None:
        groups = near_duplicate_groups(docs, id_col, text_col, **options)
    else:
        from .jaccard import similar_groups

        groups = similar_groups(docs, id_col, text_col, similarity, **options)
    keep = written(groups.where("kept").select(doc_order(F.col("doc_id")).alias(d), F.col("text_hash").alias(t)).distinct())
    marked = docs.withColumns({d: doc_order(F.col(id_col)), t: F.xxhash64(F.col(text_col).cast("string"))})
    return marked.join(keep, [d, t], "left_semi").dropDuplicates([d, t]).drop(d, t)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprint in hexadecimal digits and component."""
    out = near_duplicate_groups(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
