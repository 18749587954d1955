"""Connected components of an undirected edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.operators.skew import FEW, gathered, hot_keys, local_join
from sedge.session import cut, drop


def _both(edges: DataFrame, few: bool) -> DataFrame:
    return gathered(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), few)


def _star(edges: DataFrame, large: bool, few: bool, hot: list) -> DataFrame:
    """One contraction: every larger (smaller or equal) neighbour of a vertex is linked to the least vertex of its neighbourhood."""
    near = _both(edges, few) if large else edges  # an edge stands at its larger end, so these are the smaller neighbours
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = local_join(near, least, "u", few, hot)
    linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return gathered(linked.where("u <> v"), few).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(key, root) for every key of an edge, root the least key of its component.

    Rows with a null key and self pairs link nothing and are left out.  Ends when a pass changes no edge; the
    number of passes grows with the logarithm of the longest path.
    """
    edges = stored = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == mark or not now.n:
            break
        mark = now
        few = now.n <= FEW
        edges = gathered(edges, few)
        # a vertex with many smaller neighbours after the first star had at least as many before it, so one look serves both
        hot = [] if few else hot_keys(_both(edges, few), "u")
        half = cut(_star(edges, True, few, hot))
        new = cut(_star(gathered(half, few), False, few, hot))
        drop(half), drop(stored)
        edges = stored = new
    return edges.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())
