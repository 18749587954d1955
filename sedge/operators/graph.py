"""The property graph with evidence: merging, checks, expansion and tracing, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.operators.skew import salted_join
from sedge.session import cut

# fixed values: how firmly a passage supports an item, best first
CONFIDENCES = ("stated", "implied", "uncertain")


def confidence_rank(c: Column) -> Column:
    """3 for stated, 2 for implied, 1 for uncertain, 0 for anything else, any case."""
    low = F.lower(F.trim(c))
    return F.when(low == "stated", 3).when(low == "implied", 2).when(low == "uncertain", 1).otherwise(0)


def best_evidence(evidence: DataFrame) -> DataFrame:
    """One row per (node_key, chunk_id): the entry of best confidence, the later of equal ones; nulls of either key are left out."""
    e = evidence.withColumn("chunk_id", F.btrim("chunk_id", F.lit(" \t"))).where("node_key is not null and chunk_id is not null")
    return e.groupBy("node_key", "chunk_id").agg(
        F.max_by(F.struct("label", "span", "confidence"), F.struct(confidence_rank(F.col("confidence")), "extracted_at", "evidence_id")).alias("row"), F.count(F.lit(1)).alias("entries")
    ).select("node_key", "chunk_id", "row.*", "entries")


def nodes(evidence: DataFrame) -> DataFrame:
    """One row per node: label of its last evidence, number of chunks, best confidence rank, filings."""
    e = best_evidence(evidence)
    return e.groupBy("node_key").agg(
        F.max_by("label", "chunk_id").alias("label"), F.count(F.lit(1)).alias("chunks"), F.max(confidence_rank(F.col("confidence"))).alias("best"), F.count_distinct(F.regexp_replace("chunk_id", ":[^:]*$", "")).alias("filings")
    )


def violations(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item, rule) of every broken rule; an item breaks a rule once.

    Rules: blank_key, blank_span, unknown_confidence, unknown_chunk, label_mismatch (the key does not begin with the label),
    unscoped_key (no accession number in the key), repeated_evidence (an evidence_id on several chunks).
    """
    e = evidence.withColumn("chunk", F.btrim("chunk_id", F.lit(" \t"))).withColumn("item", F.col("evidence_id").cast("string"))
    known = chunks.select(F.col("chunk_id").alias("chunk")).distinct()
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    rules = F.filter(
        F.array(
            F.when(blank("node_key"), "blank_key"),
            F.when(blank("span"), "blank_span"),
            F.when(confidence_rank(F.col("confidence")) == 0, "unknown_confidence").when(F.col("confidence").isNull(), "unknown_confidence"),
            F.when(~F.col("node_key").startswith(F.concat("label", F.lit(":"))), "label_mismatch"),
            F.when(~F.col("node_key").rlike(r"^[A-Za-z]+:[0-9]{10}-[0-9]{2}-[0-9]{6}:"), "unscoped_key"),
        ),
        lambda r: r.isNotNull(),
    )
    own = e.select("item", F.explode(rules).alias("rule"))
    lost = e.where("chunk is not null").join(known, "chunk", "left_anti").select("item", F.lit("unknown_chunk").alias("rule"))
    several = e.where("chunk is not null").groupBy("item").agg(F.count_distinct("chunk").alias("n")).where("n > 1").select("item", F.lit("repeated_evidence").alias("rule"))
    return own.unionByName(lost).unionByName(several).distinct()


def undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of every edge, as (node, other, ...)."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.select(F.col(a).alias("node"), F.col(b).alias("other"), *rest).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"), *rest))


def expand(anchors: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(anchor, node, hop) for every node within ``hops`` steps, with the least number of steps; anchors: anchor; edges: node, other, both directions.

    Edges are made distinct once; the rows of hub nodes are salted.
    """
    seen = anchors.select("anchor", F.col("anchor").alias("node"), F.lit(0).alias("hop")).distinct()
    rim = seen
    edges = edges.select("node", "other").distinct()
    edges = cut(edges) if hops > 1 else edges
    for k in range(1, hops + 1):
        step = salted_join(edges, rim, "node").select("anchor", F.col("other").alias("node"), F.lit(k).alias("hop")).distinct()
        rim = step.join(seen.select("anchor", "node"), ["anchor", "node"], "left_anti")
        rim = cut(rim) if k < hops else rim  # read again for the next hop, and for what has been seen
        seen = seen.unionByName(rim)
    return seen


def rank_chunks(anchors: DataFrame, citing: DataFrame, k: int) -> DataFrame:
    """(chunk, score, rank): chunks by the sum over anchors of similarity times one plus the anchor's edges that cite them.

    anchors: node, similarity; citing: node, chunk, edge (null for the node's own evidence).  An edge counts once a chunk.
    Scores are rounded to 9 places before they are ordered; ties go by chunk.
    """
    per = citing.groupBy("node", "chunk").agg(F.count_distinct("edge").alias("edges"))
    score = per.join(anchors, "node").groupBy("chunk").agg(F.sum(F.col("similarity") * (1 + F.col("edges"))).alias("score"))
    order = Window.orderBy(F.desc(F.round("score", 9)), "chunk")
    return score.orderBy(F.desc(F.round("score", 9)), "chunk").limit(k).withColumn("rank", F.row_number().over(order))


def shared_pairs(membership: DataFrame, group: str, node: str) -> DataFrame:
    """(a, b, weight): pairs of nodes that stand in one group, with the number of groups; for groups of bounded size, such as the lines of an order."""
    m = membership.select(group, node).where(F.col(group).isNotNull() & F.col(node).isNotNull()).distinct()
    return m.select(group, F.col(node).alias("a")).join(m.select(group, F.col(node).alias("b")), group).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def first_provenance(citations: DataFrame, held: DataFrame) -> DataFrame:
    """(citation, chunk, via): for each cited chunk the community of lowest rank that holds it, node evidence before edge evidence, then the smaller key; null is a break."""
    best = held.groupBy("chunk").agg(F.min_by("via", F.struct("rank", "by_edge", "via")).alias("via"))
    return citations.join(best, "chunk", "left").select("citation", "chunk", "via")


def overlapping(spans: DataFrame, group: str, key: str, lo: str, hi: str) -> DataFrame:
    """(key, overlap): spans that begin before the furthest end of those that begin earlier in their group, with the overlap's length; one pass, no pairs."""
    w = Window.partitionBy(group).orderBy(lo, hi, key).rowsBetween(Window.unboundedPreceding, -1)
    seen = spans.withColumn("__end", F.max(hi).over(w))
    return seen.where(F.col("__end") > F.col(lo)).select(key, (F.least(F.col("__end"), F.col(hi)) - F.col(lo)).alias("overlap"))
