"""Retrieval arms behind one interface: questions in, ranked chunks out; and the vector and graph arms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.operators.vectors import cosine, top_k

#: What every arm gives: question, chunk, score, rank.
COLUMNS = ("question", "chunk", "score", "rank")


class Arms:
    """A registry of arms: name -> function of a table of questions."""

    def __init__(self) -> None:
        self._arms: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str, arm: Callable[[DataFrame], DataFrame]) -> None:
        if name in self._arms:
            raise ValueError(f"there is an arm {name} already")
        self._arms[name] = arm

    @property
    def names(self) -> list[str]:
        return sorted(self._arms)

    def run(self, questions: DataFrame, routes: DataFrame | None = None) -> DataFrame:
        """(arm, question, chunk, score, rank) of every arm, or with ``routes`` (question, arm) of each question's own; routes to no known arm give no rows."""
        if not self._arms:
            raise ValueError("no arms")
        out = []
        for name in self.names:
            own = questions if routes is None else questions.join(routes.where(F.col("arm") == name).select("question").distinct(), "question", "left_semi")
            got = self._arms[name](own)
            if tuple(got.columns) != COLUMNS:
                raise ValueError(f"arm {name} gives {got.columns}")
            out.append(got.withColumn("arm", F.lit(name)).select("arm", *COLUMNS))
        return reduce(DataFrame.unionByName, out)


def vector_arm(questions: DataFrame, vectors: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(question, chunk, score, rank): the ``k`` chunks of highest cosine, ties by chunk; of the filings ``allowed`` (question, filing) where a question has any.

    questions: question, vector; vectors: chunk, filing, vector.  Questions without a filter are searched in blocks against all vectors; those with one meet
    the vectors of their own filings only, by an equi-join on the filing.
    """
    free = questions if allowed is None else questions.join(allowed.select("question").distinct(), "question", "left_anti")
    near = top_k(vectors.select(F.col("chunk").alias("id"), "vector"), free.select(F.col("question").alias("id"), "vector"), k, "id", "vector", skip_self=False)
    out = near.select(F.col("query").alias("question"), F.col("id").alias("chunk"), F.round("score", 9).alias("score"), "rank")
    if allowed is None:
        return out
    asked = questions.join(allowed.distinct(), "question").select("question", F.col("vector").alias("__q"), "filing")
    score = F.round(cosine(F.col("__q"), F.col("vector")), 9)
    pairs = asked.join(vectors, "filing").select("question", "chunk", score.alias("score")).where("score is not null").distinct()
    own = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "chunk"))).where(F.col("rank") <= k)
    return out.unionByName(own)


def graph_arm(anchors: DataFrame, citing: DataFrame, k: int) -> DataFrame:
    """(question, chunk, score, rank): chunks by the sum over a question's anchors of similarity times one plus the anchor's edges that cite them, ties by chunk.

    anchors: question, node, similarity; citing: node, chunk, edge (null for own evidence).
    """
    per = citing.groupBy("node", "chunk").agg(F.count_distinct("edge").alias("edges"))
    score = per.join(anchors, "node").groupBy("question", "chunk").agg(F.round(F.sum(F.col("similarity") * (1 + F.col("edges"))), 9).alias("score"))
    return score.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "chunk"))).where(F.col("rank") <= k)
