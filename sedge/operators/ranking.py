"""Rankings, budgets, quotas and deterministic draws."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_of(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, with their ``place``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def first_seen(rows: DataFrame, by: str, item: str, position: list[str], k: int) -> DataFrame:
    """(by, item, score, rank): items of each group ranked by their first appearance, score 1/rank, the first ``k``."""
    first = rows.where(F.col(item).isNotNull()).groupBy(by, item).agg(F.min(F.struct(*position)).alias("__at"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("__at", item)))
    return ranked.where(F.col("rank") <= k).select(by, item, F.round(1 / F.col("rank"), 6).alias("score"), "rank")


def budget_prefix(rows: DataFrame, by: str, order: list[str], size: str, budget: int) -> DataFrame:
    """The rows of each group up to the first that would exceed the budget; the first row is always kept."""
    w = Window.partitionBy(by).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rows.withColumn("__n", F.row_number().over(w)).withColumn("__sum", F.sum(size).over(run))
    kept = kept.withColumn("__over", F.max((F.col("__sum") > budget).cast("int")).over(run))
    return kept.where("__over = 0 or __n = 1").drop("__n", "__sum", "__over")


def budget_skip(rows: DataFrame, by: str, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """(by, key): rows taken in order while they fit, skipping those that do not; the first is always kept.

    Groups are streamed in order through their task with the sum so far; no group is gathered.  Rows without a size take no part.
    """
    kinds = dict(rows.dtypes)
    given = rows.where(F.col(size).isNotNull()).select(by, *[F.col(o).alias(f"__o{k}") for k, o in enumerate(order)], F.col(key).alias("__k"), F.col(size).cast("long").alias("__s"))
    line = given.repartition(by).sortWithinPartitions(by, *[f"__o{k}" for k in range(len(order))], "__k", "__s")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = object()
        group, used = nothing, 0
        for pdf in batches:
            kept = []
            for k, (g, s) in enumerate(zip(pdf[by].tolist(), pdf["__s"].tolist())):
                if g != group and not (pd.isna(g) and group is None):
                    group, used = None if pd.isna(g) else g, s
                    kept.append(k)
                elif used + s <= budget:
                    used += s
                    kept.append(k)
            yield pd.DataFrame({by: pdf[by].iloc[kept], key: pdf["__k"].iloc[kept]})

    return line.select(by, "__k", "__s").mapInPandas(run, f"`{by}` {kinds[by]}, `{key}` {kinds[key]}")


def quotas(counts: DataFrame, by: str, n: str, size: int) -> DataFrame:
    """(by, seats): ``size`` seats shared in proportion to ``n`` by highest averages, one each first; ties to the smaller name."""
    given = counts.where(F.col(n) > 0)
    own = given.withColumn("__seat", F.explode(F.sequence(F.lit(0), F.least(F.col(n), F.lit(size)).cast("int") - 1)))
    claim = F.when(F.col("__seat") == 0, F.lit(float("inf"))).otherwise(F.col(n) / (F.col("__seat") + 1))
    won = own.withColumn("__claim", claim).orderBy(F.desc("__claim"), F.desc(n), by).limit(size)
    return won.groupBy(by).agg(F.count(F.lit(1)).alias("seats"))


def draw(df: DataFrame, by: str, key: str, sizes: dict[str, int], seed: str) -> DataFrame:
    """A deterministic draw of ``sizes[group]`` rows a group, in the order of a salted SHA-256 of the key."""
    order = F.sha2(F.concat(F.lit(seed + "\n"), F.col(key).cast("string")), 256)
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col(by))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order, key))).where(F.col("place") <= wanted)


def hash_percent(c: Column) -> Column:
    """SHA-256 of a text as a number modulo 100, by its hexadecimal digits."""
    digits = F.transform(F.filter(F.split(F.sha2(c, 256), ""), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda acc, x: (acc * 16 + x) % 100)


def repeats(df: DataFrame, identity: list[str], order: str) -> DataFrame:
    """The rows that are not the first of their identity."""
    return df.withColumn("__first", F.min(order).over(Window.partitionBy(*identity))).where(F.col(order) > F.col("__first")).drop("__first")


def replay(events: DataFrame, key: str, at: str, kind: str, undo: str) -> DataFrame:
    """(key, active, events): the state of every key after its log is replayed in order of ``at``; an ``undo`` event takes back all before it."""
    last = events.where(F.col(key).isNotNull()).groupBy(key)
    return last.agg(F.max_by(F.col(kind) != undo, F.struct(*[F.col(c) for c in at.split(",")])).alias("active"), F.count(F.lit(1)).alias("events"))


def packed(units: DataFrame, doc: str, start: str, end: str, tokens: str, limit: int, overlap: int) -> DataFrame:
    """(doc, ordinal, char_start, char_end, tokens): units of a document packed greedily into chunks of at most ``limit`` tokens.

    A chunk begins with the last units of the one before whose tokens sum to at most ``overlap``, if the next unit then still fits.  A unit
    over the limit is a chunk of its own.  Documents are folded one at a time, in the order of ``start``.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([start, end], kind="stable")
        s, e, t = (pdf[c].tolist() for c in (start, end, tokens))
        rows, first, k = [], 0, 0
        while k < len(s):
            used, first = 0, k
            if rows:
                back = k
                while back > 0 and used + t[back - 1] <= overlap and used + t[back - 1] + t[k] <= limit and s[back - 1] > rows[-1][2]:
                    back -= 1
                    used += t[back]
                first = back
            used += t[k]
            k += 1
            while k < len(s) and used + t[k] <= limit:
                used += t[k]
                k += 1
            rows.append((pdf[doc].iloc[0], len(rows), s[first], e[k - 1], used))
        return pd.DataFrame(rows, columns=[doc, "ordinal", "char_start", "char_end", "tokens"])

    kind = dict(units.dtypes)[doc]
    return units.groupBy(doc).applyInPandas(fold, f"{doc} {kind}, ordinal int, char_start int, char_end int, tokens long")


def sentence_bounds(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end): pieces of a text after a full stop, question or exclamation mark with its closers and a blank, or at a blank line."""
    import re

    edge = re.compile(r"(?<=[.?!])[\"'”’)\]]*\s+|\n\s*\n\s*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text]):
                at = 0
                for m in [*edge.finditer(t), None]:
                    end = m.start() if m else len(t)
                    while m and end < m.end() and not t[end].isspace():
                        end += 1
                    if end > at and t[at:end].strip():
                        rows.append((k, at, end))
                    at = m.end() if m else end
            yield pd.DataFrame(rows, columns=[key, "start", "end"])

    kind = dict(texts.dtypes)[key]
    return texts.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {kind}, start int, end int")
