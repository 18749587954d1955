"""Communities of a weighted graph, their records, and the exact separation of contradicting groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.operators.resolving import smallest_cut
from sedge.session import cut

#: Largest group that is separated exactly; greater ones are held back.
EXACT = 12


def propagate(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community) after a fixed number of rounds of weighted label propagation.

    edges: a, b, weight.  In each round a node takes the label of greatest summed weight among its neighbours and itself (its own label
    weighs as its heaviest edge), ties to the smaller label.  Neighbour labels are summed before any shuffle by node.
    """
    both = edges.select(F.col("a").alias("n"), F.col("b").alias("m"), "weight").unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m"), "weight"))
    both = cut(both.groupBy("n", "m").agg(F.sum("weight").alias("weight")))
    own = both.groupBy("n").agg(F.max("weight").alias("weight"))
    loops = cut(both.unionByName(own.select("n", F.col("n").alias("m"), "weight")))
    labels = own.select(F.col("n").alias("node"), F.col("n").alias("community"))
    for _ in range(rounds):
        votes = loops.join(labels.withColumnRenamed("node", "m"), "m").groupBy("n", "community").agg(F.sum("weight").alias("w"))
        labels = cut(votes.groupBy("n").agg(F.min_by("community", F.struct((-F.col("w")).alias("w"), "community")).alias("community")).withColumnRenamed("n", "node"))
    return labels


def two_level(edges: DataFrame, nodes: DataFrame, rounds: int = 5, split: int = 25) -> DataFrame:
    """(node, top, lower): communities of the whole graph, and of each with more than ``split`` members those within it.

    edges: a, b, weight; nodes: node (those without an edge are communities of their own).  A community is named by its least member.  Both levels
    come from label propagation: the greater ones are propagated again on their inner edges only, all at once.
    """
    found = propagate(edges, rounds)
    top = nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("community", "node").alias("label"))
    top = cut(_named(top, "label").withColumnRenamed("label", "top"))
    big = top.groupBy("top").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select("top")
    of = top.join(big, "top", "left_semi")
    inner = edges.join(of.select(F.col("node").alias("a"), F.col("top").alias("__a")), "a").join(of.select(F.col("node").alias("b"), F.col("top").alias("__b")), "b").where("__a = __b").select("a", "b", "weight")
    parts = propagate(inner, rounds).withColumnRenamed("community", "part")
    lower = top.join(parts, "node", "left").withColumn("label", F.coalesce("part", F.col("top")))
    return _named(lower.select("node", "top", "label"), "label").select("node", "top", F.col("label").alias("lower"))


def _named(labels: DataFrame, column: str) -> DataFrame:
    """``labels`` with each community named by its least node."""
    names = labels.groupBy(column).agg(F.min("node").alias("__least"))
    return labels.join(names, column).withColumn(column, F.col("__least")).drop("__least")


def tree(levels: DataFrame, report_least: int = 3) -> DataFrame:
    """(community_id, level, parent, members, member_hash, reportable) of both levels; a lower community that is its whole top one stands once, on top."""
    tops = records(levels.select("node", F.col("top").alias("community")), report_least).withColumn("level", F.lit("top"))
    lows = records(levels.where("true").select("node", F.col("lower").alias("community")), report_least).withColumn("level", F.lit("lower"))
    of = levels.select(F.col("lower").alias("community"), "top").distinct()
    parents = of.join(tops.select(F.col("community").alias("top"), F.col("community_id").alias("parent"), F.col("member_hash").alias("__whole")), "top")
    below = lows.join(parents, "community").where("member_hash <> __whole").select(F.concat(F.lit("lower-"), F.substring("member_hash", 1, 12)).alias("community_id"), "level", "parent", "members", "member_hash", "reportable")
    return tops.select("community_id", "level", F.lit(None).cast("string").alias("parent"), "members", "member_hash", "reportable").unionByName(below)


def or_children(citing: DataFrame, tree_edges: DataFrame) -> DataFrame:
    """(community, chunk): chunks of a community itself and of its children.  citing: community, chunk; tree_edges: parent, child."""
    of_child = tree_edges.select(F.col("parent").alias("community"), F.col("child").alias("__c")).join(citing.select(F.col("community").alias("__c"), "chunk"), "__c").select("community", "chunk")
    return citing.select("community", "chunk").unionByName(of_child).distinct()


def records(labels: DataFrame, report_least: int = 3) -> DataFrame:
    """(community_id, community, members, member_hash, reportable): the hash is of the sorted members as JSON, the id of its first 12 digits."""
    text = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.col("node").cast("string"))), lambda m: F.concat(F.lit('"'), m, F.lit('"'))), ","), F.lit("]"))
    g = labels.groupBy("community").agg(F.count(F.lit(1)).alias("members"), F.sha2(text, 256).alias("member_hash"))
    return g.select(F.concat(F.lit("top-"), F.substring("member_hash", 1, 12)).alias("community_id"), "community", "members", "member_hash", (F.col("members") >= report_least).alias("reportable"))


def ranked_passages(labels: DataFrame, edges: DataFrame, cites: DataFrame) -> DataFrame:
    """(community, chunk, n, place): chunks by how often the members and the inner edges of a community cite them, ties by chunk.

    edges: a, b, chunk; cites: node, chunk; a chunk counts once for a member and once for an edge.
    """
    of = labels.select("node", "community")
    by_node = cites.distinct().join(of, "node").select("community", "chunk")
    ends = edges.distinct().join(of.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(of.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    by_edge = ends.where("ca = cb").select(F.col("ca").alias("community"), "chunk")
    counts = by_node.unionByName(by_edge).groupBy("community", "chunk").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "chunk")))


def separate(pairs: DataFrame, group: str) -> DataFrame:
    """(group, state, links_cut): groups without contradiction are ``clean``, those over EXACT keys ``held_back``, the others ``cut``, or ``tied`` if several smallest cuts differ.

    pairs: group, key_a, key_b, same.  Only contradicting groups of bounded size are gathered.
    """
    size = pairs.select(group, F.explode(F.array("key_a", "key_b")).alias("k")).groupBy(group).agg(F.count_distinct("k").alias("keys"))
    state = pairs.groupBy(group).agg(F.bool_or(~F.col("same")).alias("against")).join(size, group)
    easy = state.where(f"not against or keys > {EXACT}").select(group, F.when(~F.col("against"), "clean").otherwise("held_back").alias("state"), F.lit(0).alias("links_cut"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        same = [tuple(sorted(x)) for x in pdf.loc[pdf.same, ["key_a", "key_b"]].itertuples(index=False)]
        against = [tuple(sorted(x)) for x in pdf.loc[~pdf.same, ["key_a", "key_b"]].itertuples(index=False)]
        n, _, ways, _ = smallest_cut([x for x in same if x not in against], against)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "state": ["cut" if ways == 1 else "tied"], "links_cut": [n]})

    hard = pairs.select(group, "key_a", "key_b", "same").distinct().join(state.where(f"against and keys <= {EXACT}").select(group), group, "left_semi")
    return easy.unionByName(hard.groupBy(group).applyInPandas(solve, f"{group} {dict(pairs.dtypes)[group]}, state string, links_cut int"))
