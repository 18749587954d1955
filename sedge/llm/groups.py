"""Consolidating pairwise matches into groups (problem 7).

Connected components by low-diameter decomposition.  Every vertex draws an exponential shift; a
cluster grows from each vertex, starting earlier the larger its shift, one hop a step, and a
vertex joins the cluster that reaches it first.  The clusters are contracted to super-vertices,
the edges between them are made distinct, and the decomposition recurses on those until no edge is
left; the assignments of all levels are composed.  A level shrinks the graph by a constant factor
whatever its shape (a chain of thousands of keys takes a handful of levels, where plain label
propagation takes thousands of steps).

Growth is cut off after ``HOPS`` steps a level.  Any assignment made by then joins a vertex to one
it is linked to, so the cut only costs further levels, never a link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.operators.skew import FEW, gathered, hot_keys, local_join, salted_join
from sedge.session import cut, drop

#: Rate of the exponential shifts: the mean head start of a cluster is 1/BETA hops.
BETA = 0.3
#: Steps of growth a level.
HOPS = 4


def _shift(level: int):
    """An exponential draw per vertex and level, the same whenever it is computed again."""
    u = (F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(u) / BETA


def _clusters(edges: DataFrame, level: int, few: bool, hot: list) -> DataFrame:
    """(id, center) of each vertex of the symmetric ``edges`` (src, dst): the cluster that reaches it first."""
    vertices = edges.select(F.col("src").alias("id")).distinct()
    reached = vertices.select("id", (-_shift(level)).alias("at"), F.col("id").alias("center"))
    # a vertex keeps its own arrival through an edge of length 0 to itself, so a step reads ``reached`` once
    loops = vertices.select("id", F.col("id").alias("dst"), F.lit(0.0).alias("len"))
    steps = gathered(edges.select(F.col("src").alias("id"), "dst", F.lit(1.0).alias("len")).unionByName(loops), few)
    for _ in range(HOPS):
        reached = (
            local_join(steps, reached, "id", few, hot)
            .groupBy("dst")
            .agg(F.min(F.struct((F.col("at") + F.col("len")).alias("at"), "center")).alias("first"))
            .select(F.col("dst").alias("id"), "first.at", "first.center")
        )
    return reached.select("id", "center")


def _contract(edges: DataFrame, clusters: DataFrame, few: bool, hot: list) -> DataFrame:
    """The distinct edges between different clusters, both directions."""
    names = clusters.select(F.col("id").alias("src"), F.col("center").alias("csrc"))
    half = local_join(edges, names, "src", few, hot).select("csrc", "dst")
    both = local_join(half, names.select(F.col("src").alias("dst"), F.col("csrc").alias("cdst")), "dst", few, hot)
    return both.where("csrc <> cdst").select(F.col("csrc").alias("src"), F.col("cdst").alias("dst")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex of ``edges`` (src BIGINT, dst BIGINT, in any direction, no nulls).

    Self pairs and repeated pairs are allowed; a vertex that only has a self pair is not returned.
    """
    two_way = edges.where("src <> dst").select("src", "dst")
    edges = cut(two_way.unionByName(two_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    levels = []
    while n := edges.count():
        few = n <= FEW
        graph = gathered(edges, few)
        hot = [] if few else hot_keys(edges, "src")  # the edges stand in both directions, so the same keys are heavy as ends
        clusters = cut(_clusters(graph, len(levels), few, hot))
        levels.append((clusters, few))
        finer, edges = edges, cut(_contract(graph, gathered(clusters, few), few, hot))
        drop(finer)
    if not levels:
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("root"))
    clusters, few = levels.pop()
    roots = gathered(clusters, few).select("id", F.col("center").alias("root"))
    while levels:
        clusters, few = levels.pop()
        upper = roots.select(F.col("id").alias("center"), "root")
        below = local_join(gathered(clusters, few), upper, "center", few, [], "left") if few else salted_join(clusters, upper, "center", "left")
        roots = below.select("id", F.coalesce("root", "center").alias("root"))
    return roots


def group_pairs(pairs: DataFrame, key_a: str = "key_a", key_b: str = "key_b", same: str = "same") -> DataFrame:
    """(node_key, group_key): every non-null key, and the smallest key (by bytes) of its group.

    A row with ``same`` true and both keys links them, whatever other rows say; null or false
    ``same``, and rows with a null key, link nothing, but their keys come out, alone if nothing
    else links them.  Self pairs, repeated and reversed rows change nothing.  An empty table gives
    no rows.  Keys are numbered by a stored table rather than hashed, so no two ever collide.
    """
    keyed = pairs.select(F.col(key_a).alias("a"), F.col(key_b).alias("b"), F.col(same).alias("same"))
    keys = cut(
        keyed.select(F.explode(F.array("a", "b")).alias("node_key")).where("node_key is not null").distinct().withColumn("id", F.monotonically_increasing_id())
    )
    links = keyed.where("same and a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    half = salted_join(cut(links), keys.select(F.col("node_key").alias("a"), F.col("id").alias("src")), "a").select("src", "b")
    edges = salted_join(cut(half), keys.select(F.col("node_key").alias("b"), F.col("id").alias("dst")), "b").select("src", "dst")
    rooted = keys.join(components(edges), "id", "left").select("node_key", F.coalesce("root", "id").alias("root"))
    rooted = cut(rooted)
    smallest = rooted.groupBy("root").agg(F.min("node_key").alias("group_key"))
    return salted_join(rooted, smallest, "root").select("node_key", "group_key")
