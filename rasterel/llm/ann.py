"""Approximate nearest neighbours (operator 9): one navigable small-world graph per shard.

Vectors are dealt to shards of bounded size by a hash. A shard's index is a hierarchy of graphs
in flat neighbour arrays: each vector draws a top level, each level links its vectors to diverse
near ones. Within a shard the near ones are found exactly, in blocks of matrix products, so that
a level is built at once. Search walks down greedily and keeps a beam on the lowest level, for a
block of queries at a time. Shards' answers are merged by score.

Inner products become distances by one added coordinate, sqrt(R² - |x|²), which makes the largest
product the nearest point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors meant for a shard; links of a vector on upper levels (twice that on the lowest); beam width.
SHARD_ROWS, LINKS, BEAM = 8192, 16, 160
#: Near vectors among which a vector's links are chosen; queries searched at a time.
CANDIDATES, QUERY_BLOCK = 64, 512
#: Blocks for which a task loads a shard's index once; most tasks; columns of an index.
BLOCKS_A_TASK, MOST_TASKS, INDEX = 8, 1 << 16, ("ids", "points", "owner", "sizes", "links")


def _near(points: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k nearest other points of each point, nearest first; by blocks."""
    n = len(points)
    k = min(k, n - 1)
    squares = (points**2).sum(axis=1)
    out = np.empty((n, k), np.int32)
    for i in range(0, n, 512):
        d = squares[None] - 2 * (points[i : i + 512] @ points.T)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        order = np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable")
        out[i : i + 512] = np.take_along_axis(near, order, 1)
    return out


def _diverse(points: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each point's near ones, those nearer to it than to any chosen before; -1 fills up."""
    n, k = near.shape
    out = np.full((n, most), -1, np.int32)
    for i in range(0, n, 512):
        own, cand = points[i : i + 512], points[near[i : i + 512]]
        to_own = ((cand - own[:, None]) ** 2).sum(axis=2)
        squares = (cand**2).sum(axis=2)
        between = squares[:, :, None] + squares[:, None] - 2 * cand @ cand.transpose(0, 2, 1)
        chosen = np.zeros(to_own.shape, bool)
        for c in range(k):
            hidden = (chosen & (between[:, c] < to_own[:, c, None])).any(axis=1)
            chosen[:, c] = ~hidden & (chosen.sum(axis=1) < most)
        for c in range(k):  # room that is left goes to the nearest others
            chosen[:, c] |= chosen.sum(axis=1) < most // 2
        row, col = np.nonzero(chosen)
        place = np.cumsum(chosen, axis=1)[row, col] - 1
        fits = place < most
        out[i + row[fits], place[fits]] = near[i + row[fits], col[fits]]
    return out


def _both_ways(links: np.ndarray, most: int) -> np.ndarray:
    """links with each link's reverse added, up to ``most`` a point; what is far goes first."""
    n = len(links)
    row, rank = np.nonzero(links >= 0)
    to = links[row, rank]
    a, b, order = np.r_[row, to], np.r_[to, row], np.r_[rank, rank + 0.5]
    keep = np.lexsort((order, b, a))
    a, b, order = a[keep], b[keep], order[keep]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
    a, b, order = a[new], b[new], order[new]
    keep = np.lexsort((order, a))
    a, b = a[keep], b[keep]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    fits = place < most
    out = np.full((n, most), -1, np.int32)
    out[a[fits], place[fits]] = b[fits]
    return out


class Graph:
    """The index of one shard: points, their top levels, and per level its members and flat links."""

    def __init__(self, points: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.points, self.levels = points, levels

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 7, links: int = LINKS) -> Graph:
        """vectors: distinct rows. Building depends on the rows and the seed only."""
        squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
        points = np.c_[vectors, np.sqrt(np.maximum(squares.max() - squares, 0))].astype(np.float32)
        top = np.minimum(-np.log(1 - np.random.default_rng(seed).random(len(points))) / np.log(links), 20).astype(int)
        levels = []
        for level in range(top.max() + 1):
            members = np.flatnonzero(top >= level).astype(np.int32)
            most = links * (1 + (level == 0))
            if len(members) > 1:
                own = points[members]
                chosen = _both_ways(_diverse(own, _near(own, CANDIDATES), most), most * 2)
            else:
                chosen = np.full((len(members), 1), -1, np.int32)
            levels.append((members, np.where(chosen >= 0, members[chosen], -1).astype(np.int32)))
        return cls(points, levels)

    def search(self, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, products) of about the k largest inner products of each query; -1 fills up."""
        q = np.c_[queries, np.zeros(len(queries), np.float32)].astype(np.float32)
        rows = np.arange(len(q))
        at = np.full(len(q), self.levels[-1][0][0])
        score = (q * self.points[at]).sum(axis=1)
        for members, links in self.levels[:0:-1]:  # downhill on the upper levels
            place = np.full(len(self.points), -1, np.int32)
            place[members] = np.arange(len(members))
            live = rows
            while len(live):
                near = links[place[at[live]]]
                s = np.where(near >= 0, np.einsum("qd,qnd->qn", q[live], self.points[near]), -np.inf)
                best = s.argmax(axis=1)
                gain = s[np.arange(len(live)), best] > score[live]
                live, near, best, s = live[gain], near[gain], best[gain], s[gain]
                at[live] = near[np.arange(len(live)), best]
                score[live] = s[np.arange(len(live)), best]
        members, links = self.levels[0]
        beam = max(beam, k)
        seen = np.zeros((len(q), len(self.points) + 1), bool)  # the last column stands for no point
        seen[:, -1] = True
        seen[rows, at] = True
        ids = np.full((len(q), beam), -1, np.int32)
        found = np.full((len(q), beam), -np.inf, np.float32)
        fresh = np.zeros((len(q), beam), bool)
        ids[:, 0], found[:, 0], fresh[:, 0] = at, score, True
        live = rows
        while len(live):
            next_ = np.where(fresh[live], found[live], -np.inf)
            # the best few open points of the beam at once
            pick = np.argpartition(-next_, 3, axis=1)[:, :4]
            ok = np.take_along_axis(next_, pick, 1) > -np.inf
            live, pick, ok = live[ok.any(axis=1)], pick[ok.any(axis=1)], ok[ok.any(axis=1)]
            if not len(live):
                break
            own = np.arange(len(live))[:, None]
            fresh[live[:, None], pick] = False
            near = np.where(ok[:, :, None], links[ids[live[:, None], pick]], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = np.where(seen[live[:, None], near], -1, near)
            seen[live[:, None], near] = True
            seen[:, -1] = True
            s = np.where(near >= 0, np.einsum("qd,qnd->qn", q[live], self.points[near]), -np.inf).astype(np.float32)
            all_ids, all_s = np.c_[ids[live], near], np.c_[found[live], s]
            all_fresh = np.c_[fresh[live], near >= 0]
            keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            ids[live], found[live], fresh[live] = all_ids[own, keep], all_s[own, keep], all_fresh[own, keep] & (all_s[own, keep] > -np.inf)
        order = np.argsort(-found, axis=1, kind="stable")[:, : max(k, 1)]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(found, order, 1)


def _usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows with an id whose vector has finite components only, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(shard, dim, ids, vectors, owner, graph arrays) with one row a shard, and the number of shards.

    rows: (id, v). Equal vectors of a shard are one point of its graph: neither copies nor ties
    crowd out links. Vectors of different lengths are in different indexes.
    """
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.size("v")), F.lit(shards)).cast("int")).withColumn("dim", F.size("v"))

    def build(part: pa.Table) -> pa.Table:
        ids = part.column("id").to_numpy()
        dim = part.column("dim")[0].as_py()
        v = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        points, owner = np.unique(v, axis=0, return_inverse=True)
        graph = Graph.build(points)
        sizes = [x for m, l in graph.levels for x in (len(m), l.shape[1])]
        links = np.concatenate([np.r_[m, l.ravel()] for m, l in graph.levels]).astype(np.int32)
        cells = [part.column("shard")[0].as_py(), dim, ids.tobytes(), points.tobytes(), owner.ravel().astype(np.int32).tobytes(), np.array(sizes, np.int32).tobytes(), links.tobytes()]
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.table([pa.array([c], t) for c, t in zip(cells, kinds)], names=["shard", "dim", "ids", "points", "owner", "sizes", "links"])

    made = keyed.groupBy("shard", "dim").applyInArrow(build, "shard int, dim int, ids binary, points binary, owner binary, sizes binary, links binary")
    return made, shards


def _loaded(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    ids, owner = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["owner"], np.int32)
    vectors = np.frombuffer(row["points"], np.float64).reshape(-1, row["dim"])
    squares = (vectors**2).sum(axis=1)
    points = np.c_[vectors, np.sqrt(np.maximum(squares.max() - squares, 0))].astype(np.float32)
    links, sizes, at, levels = np.frombuffer(row["links"], np.int32), np.frombuffer(row["sizes"], np.int32).reshape(-1, 2), 0, []
    for n, width in sizes.tolist():
        levels.append((links[at : at + n], links[at + n : at + n + n * width].reshape(n, width)))
        at += n + n * width
    return ids, owner, vectors, Graph(points, levels)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of each query's k nearest rows, but those with its own id.

    Nearest is the largest inner product, in double precision on the original vectors; ties go to
    the smaller id. Rows and queries without id, and with null, zero or non-finite vectors, take no
    part; a query meets rows of its own length only. Fewer candidates than k: all of them.
    Rows that repeat an id and vector count once. Other columns aren't read.
    """
    base = _usable(rows, id_col, vector_col).distinct()
    index, shards = build_index(base, shard_rows)
    asked = _usable(queries, id_col, vector_col).distinct()
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def pack(part: pa.Table) -> pa.Table:
        ids, dim = part.column("id").to_numpy(), part.column("dim")[0].as_py()
        v = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        order = np.argsort(ids, kind="stable")
        cells = (dim, part.column("block")[0].as_py(), ids[order].tobytes(), v[order].tobytes())
        return pa.table([pa.array([c], t) for c, t in zip(cells, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["dim", "block", "q_ids", "q"])

    # Each shard's index goes to Python once for some blocks of queries: it comes first, its blocks follow row by row.
    index = written(index)
    some = F.floor(F.col("block") / BLOCKS_A_TASK).cast("long")
    groups = -(-n_blocks // BLOCKS_A_TASK)
    blocks = asked.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(n_blocks)), "dim": F.size("v")}).groupBy("block", "dim").applyInArrow(pack, "dim int, block long, q_ids binary, q binary")
    none = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    # Every block of queries meets every shard.
    dealt = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", "dim", some.alias("part"), F.lit(1).alias("kind"), *none(*INDEX), "q_ids", "q")
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).select("shard", "dim", "part", F.lit(0).alias("kind"), *INDEX, *none("q_ids", "q"))
    pairs = copies.union(dealt).repartition(min(shards * groups, MOST_TASKS), "shard", "dim", "part").sortWithinPartitions("shard", "dim", "part", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            for row in (dict(zip(batch.schema.names, r)) for r in zip(*batch.columns)):
                row = {k: v.as_py() for k, v in row.items()}
                if row["kind"] == 0:
                    last, held = (row["shard"], row["dim"]), row
                    continue
                if last != (row["shard"], row["dim"]):  # no vector of this length in the shard
                    continue
                if isinstance(held, dict):  # an index that no query follows isn't loaded
                    held = _loaded(held)
                ids, owner, vectors, graph = held
                q_ids = np.frombuffer(row["q_ids"], np.int64)
                q = np.frombuffer(row["q"], np.float64).reshape(len(q_ids), -1)
                by_point = np.argsort(owner, kind="stable")  # ids ascend within a point
                begin = np.searchsorted(owner[by_point], np.arange(len(vectors) + 1))
                found, _ = graph.search(q, min(len(vectors), k + 8), beam)
                out: list[tuple[np.ndarray, ...]] = []
                for i in range(len(q)):
                    near = found[i][found[i] >= 0]
                    score = (vectors[near] * q[i]).cumsum(axis=1)[:, -1]  # summed in order, as SQL does
                    order = np.argsort(-score, kind="stable")
                    own_ids = np.concatenate([ids[by_point[begin[p] : min(begin[p + 1], begin[p] + k + 1)]] for p in near[order]])
                    own_score = np.repeat(score[order], np.minimum(begin[near[order] + 1] - begin[near[order]], k + 1))
                    other = own_ids != q_ids[i]
                    own_ids, own_score = own_ids[other], own_score[other]
                    first = np.lexsort((own_ids, -own_score))[:k]
                    out.append((np.full(len(first), q_ids[i]), own_ids[first], own_score[first]))
                if out:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    hits = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    distinct = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return distinct.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest of each vector whose id is divisible by ``every``, among all others."""
    rows = embeddings.select("vec_id", "embedding")
    return nearest(rows.where(F.col("vec_id") % every == 0), rows, k)


#: DuckDB form of ``digest``, by brute force: equal to it where a shard holds all vectors and search misses none.
SQL = """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL),
u AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM u q JOIN u c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
