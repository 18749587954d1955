"""Exact cosine search of a stated set of query vectors against all rows."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors broadcast at once; a larger set is searched in several blocks.  Similarities that a task holds at once.
BLOCK, TILE = 20_000, 4_000_000


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of equal length, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector scaled to length 1; null for a null, empty or all-zero vector."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where either has no direction."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def _matrix(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _usable(df: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    return df.where(v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))


def top_k(base: DataFrame, queries: DataFrame, k: int, key: str, vector: str, facet: str | None = None, skip_self: bool = True) -> DataFrame:
    """(query, key, score, rank): the ``k`` rows of ``base`` of highest cosine for every row of ``queries``, ties by key.

    With ``facet`` a query is compared with the rows of its own facet value only.  Vectors without direction take no part.  Both inputs have the
    columns ``key``, ``vector`` and ``facet``.  Queries go out in blocks of at most BLOCK; every task keeps its own best
    ``k`` a query, so only these are shuffled.
    """
    columns = [key, vector] + ([facet] if facet else [])
    asked = _usable(queries.select(*columns), vector)
    count = ceil(asked.count() / BLOCK)
    blocks = asked.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(max(1, count))).cast("int"))
    kind = dict(base.dtypes)[key]
    out = None
    for b in range(count):
        part = blocks.where(F.col("__block") == b).toPandas()
        shared = base.sparkSession.sparkContext.broadcast((part[key].to_numpy(), _matrix(part[vector]), part[facet].to_numpy() if facet else None))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q, own = shared.value
            best: pd.DataFrame | None = None
            for pdf in batches:
                if not len(pdf):
                    continue
                x, keys = _matrix(pdf[vector]), pdf[key].to_numpy()
                new = [] if best is None else [best]
                step = max(1, TILE // len(pdf))
                for start in range(0, len(q), step):
                    at = slice(start, start + step)
                    s = np.round(q[at] @ x.T, 9)
                    if facet:
                        s[own[at, None] != pdf[facet].to_numpy()[None, :]] = -9
                    if skip_self:
                        s[ids[at, None] == keys[None, :]] = -9
                    keep = min(k, s.shape[1])
                    floor = -np.partition(-s, keep - 1, axis=1)[:, keep - 1 : keep]
                    r, c = np.nonzero((s >= floor) & (s > -2))
                    new.append(pd.DataFrame({"query": ids[at][r], key: keys[c], "score": s[r, c]}))
                best = pd.concat(new).sort_values(["query", "score", key], ascending=[True, False, True]).groupby("query").head(k)
            if best is not None:
                yield best

        rows = _usable(base.select(*columns), vector).mapInPandas(run, f"query {kind}, {key} {kind}, score double")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return base.select(F.col(key).alias("query"), key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
    order = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
