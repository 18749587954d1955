"""Retrieval metrics, intervals and agreement statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z_95 = 1.959963984540054


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Share of the distinct gold items among the first ``k`` retrieved; null without gold."""
    n = F.size(F.array_distinct(gold))
    return F.when(n > 0, F.size(F.array_intersect(F.slice(retrieved, 1, k), gold)) / n)


def precision_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Share of the first ``k`` places that hold gold, divided by ``k`` even when fewer were retrieved; null without gold."""
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(F.slice(retrieved, 1, k), gold)) / F.lit(k))


def wrong_evidence(retrieved: DataFrame, gold: DataFrame, negatives: DataFrame) -> DataFrame:
    """(query, item): negatives ranked above at least one gold item of their query.

    retrieved: query, item, rank; gold and negatives: query, item.  A gold item that was not retrieved ranks after
    all retrieved ones; of a repeated item the first place counts.  Queries without gold have no hits.
    """
    first = retrieved.groupBy("query", "item").agg(F.min("rank").alias("rank"))
    last = first.groupBy("query").agg((F.max("rank") + 1).alias("after"))
    worst = gold.distinct().join(first, ["query", "item"], "left").join(last, "query", "left").groupBy("query").agg(F.max(F.coalesce("rank", "after", F.lit(1))).alias("worst"))
    return negatives.distinct().join(first, ["query", "item"]).join(worst, "query").where("rank < worst").select("query", "item")


def wilson(successes: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null for n = 0."""
    p, z2 = successes / n, z * z
    mid, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    ok = n > 0
    return F.when(ok, (mid - half) / (1 + z2 / n)), F.when(ok, (mid + half) / (1 + z2 / n))


def fisher(rho: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Bounds of a correlation by Fisher's transformation; null for n < 4 or a correlation of 1 or -1."""
    ok = (n > 3) & (F.abs(rho) < 1)
    half = z / F.sqrt(F.when(n > 3, n - 3))
    return F.when(ok, F.tanh(F.atanh(rho) - half)), F.when(ok, F.tanh(F.atanh(rho) + half))


def kappa(both_yes: Column, a_yes: Column, b_yes: Column, n: Column) -> Column:
    """Cohen's kappa of two raters' yes/no verdicts from their counts; null where chance agreement is 1 or n = 0."""
    both_no = n - a_yes - b_yes + both_yes
    agreed = (both_yes + both_no) / F.when(n > 0, n)
    chance = (a_yes * b_yes + (n - a_yes) * (n - b_yes)) / F.when(n > 0, n * n)
    return F.when(chance < 1, (agreed - chance) / (1 - chance))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by..., n, rho): rank correlation with average ranks for ties; null for n < 3 or a constant side.

    Ranks come from counts per distinct value, so a group is sorted by its distinct values only.
    """
    given = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(c: str, name: str) -> DataFrame:
        counts = given.groupBy(*by, c).agg(F.count(F.lit(1)).alias("__c"))
        before = Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(*by, c, (F.coalesce(F.sum("__c").over(before), F.lit(0)) + (F.col("__c") + 1) / 2).alias(name))

    ranked = given.join(ranks(x, "__rx"), [*by, x]).join(ranks(y, "__ry"), [*by, y])
    out = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.covar_pop("__rx", "__ry") / F.nullif(F.stddev_pop("__rx") * F.stddev_pop("__ry"), F.lit(0.0))).alias("rho"))
    return out.withColumn("rho", F.when(F.col("n") >= 3, F.col("rho")))
