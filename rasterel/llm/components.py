"""Connected components over an edge table, by rounds of DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours; and the table that it reads."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written, so that a hub's rows meet one row of a plain table: Spark broadcasts it or splits the hub.
    low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), low


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of those neighbours."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(low, "a").select(F.explode(F.array("a", "b")).alias("n"), "m").where("n <> m").select(F.col("n").alias("a"), F.col("m").alias("b")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the undirected edge table (a long, b long).

    root is the smallest node of the component. Alternating large-star and small-star rounds:
    each is two aggregates and two joins, no node's neighbours are ever gathered in one row, and
    the table never grows. Rounds are cut by written tables and end when a round changes nothing.
    Loops are ignored; an empty table gives no rows.
    """
    now = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)))
    before = now.agg(mark).first()[0]
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        large, low = _large_star(now)
        last, now = now, written(_small_star(large))
        forget(last, low)
        after = now.agg(mark).first()[0]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
