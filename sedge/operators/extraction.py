"""Checks of extraction replies: nodes and triples against an ontology, first failing rule wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPLY = "struct<nodes:array<struct<id:string,label:string,name:string,value:string,evidence_span:string,confidence:string>>,triples:array<struct<start:string,type:string,end:string,evidence_span:string,confidence:string>>>"


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that fails, or null."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(True)), name) for name, broken in rules])


def number(c: Column) -> Column:
    """A JSON scalar as a finite number; booleans, words and infinities give null."""
    return F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), c.cast("double"))


def parsed(replies: DataFrame) -> DataFrame:
    """(chunk_id, text, reply): replies as structs; one that is no such object has a null reply."""
    return replies.select("chunk_id", "text", F.from_json("reply", REPLY).alias("reply"))


def checked_nodes(replies: DataFrame, labels: list[str]) -> DataFrame:
    """(chunk_id, pos, id, label, name, reason): every proposed node with the first rule that it breaks, or null.

    Order of the rules: label, id, duplicate_id, confidence, name, value (metrics only), span.
    """
    n = replies.select("chunk_id", "text", F.posexplode("reply.nodes").alias("pos", "n")).select("chunk_id", "text", "pos", "n.*")
    twice = F.count(F.lit(1)).over(Window.partitionBy("chunk_id", "id")) > 1
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    reason = first_reason(
        ("label", ~F.col("label").isin(*labels)), ("id", blank("id")), ("duplicate_id", twice), ("confidence", ~F.lower("confidence").isin("stated", "implied", "uncertain")), ("name", blank("name")),
        ("value", F.when(F.col("label") == "MetricValue", number(F.col("value")).isNull()).otherwise(F.lit(False))), ("span", blank("evidence_span") | ~F.contains("text", "evidence_span")),
    )
    return n.select("chunk_id", "pos", "id", "label", "name", "confidence", "evidence_span", reason.alias("reason"))


def checked_triples(replies: DataFrame, nodes: DataFrame, allowed: DataFrame, symmetric: list[str]) -> DataFrame:
    """(chunk_id, pos, start, type, end, reason): every proposed edge; edges of symmetric types are stored smaller end first.

    allowed: start_label, type, end_label (the ontology, a fixed list).  Order of the rules: endpoint, type, pair, confidence, span, self_loop.
    """
    t = replies.select("chunk_id", "text", F.posexplode("reply.triples").alias("pos", "t")).select("chunk_id", "text", "pos", "t.*")
    good = nodes.where("reason is null").select("chunk_id", "id", "label")
    t = t.join(good.select("chunk_id", F.col("id").alias("start"), F.col("label").alias("start_label")), ["chunk_id", "start"], "left")
    t = t.join(good.select("chunk_id", F.col("id").alias("end"), F.col("label").alias("end_label")), ["chunk_id", "end"], "left")
    pairs = F.broadcast(allowed.withColumn("__pair", F.lit(True)))
    types = F.broadcast(allowed.select("type").distinct().withColumn("__type", F.lit(True)))
    t = t.join(types, "type", "left").join(pairs, ["start_label", "type", "end_label"], "left")
    blank = F.col("evidence_span").isNull() | (F.trim("evidence_span") == "")
    reason = first_reason(
        ("endpoint", F.col("start_label").isNull() | F.col("end_label").isNull()), ("type", F.col("__type").isNull()), ("pair", F.col("__pair").isNull()),
        ("confidence", ~F.lower("confidence").isin("stated", "implied", "uncertain")), ("span", blank | ~F.contains("text", "evidence_span")), ("self_loop", F.col("start") == F.col("end")),
    )
    swap = F.col("type").isin(*symmetric) & (F.col("start") > F.col("end"))
    return t.select("chunk_id", "pos", F.when(swap, F.col("end")).otherwise(F.col("start")).alias("start"), "type", F.when(swap, F.col("start")).otherwise(F.col("end")).alias("end"), reason.alias("reason"))


def rejections(checked: DataFrame) -> DataFrame:
    """(reason, n): rejected candidates by reason, and the accepted under ``ok``."""
    return checked.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
