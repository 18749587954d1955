"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds more than one in HEAVY_PARTS of the rows, so there are fewer than
#: HEAVY_PARTS heavy keys whatever the size of the data: the list of them is always broadcastable.
HEAVY_PARTS = 64


def heavy_keys(df: DataFrame, key: str, parts: int = HEAVY_PARTS) -> DataFrame:
    """The keys with more than 1/``parts`` of the non-null keyed rows: fewer than ``parts`` rows, column ``key``.

    Null keys and empty inputs give no rows.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    return counts.join(F.broadcast(total), F.col("__n") * parts > F.col("__total")).select(key)


def hot_keys(df: DataFrame, key: str, parts: int = HEAVY_PARTS) -> list:
    """The heavy keys themselves: fewer than ``parts`` values, found by one aggregation."""
    return [r[0] for r in heavy_keys(df, key, parts).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = 32, parts: int = HEAVY_PARTS, hot: list | None = None) -> DataFrame:
    """Equi-join on ``key`` with the heavy keys of ``left`` spread over ``salts`` partitions.

    ``right`` should be unique (or nearly so) per key; its rows for heavy keys, at most
    ``parts`` x duplicates, are copied ``salts`` times.  ``how`` is inner, left, left_semi or
    left_anti.  Null keys never match.  Both sides must share no other column name than ``key``.
    ``hot`` are the heavy keys where they are known already; without any the join is a plain one.
    The salt is a hash of the row, so that a task that runs again salts alike (rows that are equal throughout stay together).
    Where they are not given they are part of the plan, a broadcast of fewer than ``parts`` rows, and
    nothing runs before the action; ``left`` is then read twice, so cut it if it is dear.
    """
    if hot is not None and not hot:
        return left.join(right, key, how)
    if hot is None:
        heavy = heavy_keys(left, key, parts).select(F.col(key).alias("__heavy"))
    else:
        heavy = left.sparkSession.createDataFrame([(h,) for h in hot], left.select(F.col(key).alias("__heavy")).schema)
    keys = F.broadcast(heavy)
    spread = F.when(F.col("__heavy").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    l2 = left.join(keys, F.col(key) == F.col("__heavy"), "left").withColumn("__salt", spread).drop("__heavy")
    copies = F.when(F.col("__heavy").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    r2 = right.join(keys, F.col(key) == F.col("__heavy"), "left").withColumn("__salt", F.explode(copies)).drop("__heavy")
    return l2.join(r2, [key, "__salt"], how).drop("__salt")


#: Up to so many rows an iterative operator works in one partition, where a pass is a single stage; more go over all partitions.
FEW = 500_000


def gathered(df: DataFrame, few: bool) -> DataFrame:
    """``df`` in one partition if it has ``few`` rows: joins and aggregations of such tables need no exchange."""
    return df.coalesce(1) if few else df


def local_join(left: DataFrame, right: DataFrame, key: str, few: bool, hot: list, how: str = "inner") -> DataFrame:
    """The join of two tables ``gathered`` in one partition by a hash table of the right one, or a salted join."""
    return left.join(right.hint("shuffle_hash"), key, how) if few else salted_join(left, right, key, how, hot=hot)
