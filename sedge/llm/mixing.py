"""Mixing sources to target weights (problem 9).

Weighted fair queueing: the documents of each source are shuffled, sources with a repeat cap above
one are queued again in a fresh order, and each document gets a virtual finish time, the tokens of
its source up to and including it divided by the source's target share.  The mixture is all
documents in order of finish time, up to the total budget.

The running token counts are made in two steps: sums per source, pass and slot of the shuffle
order (a row for ``PER_SLOT`` documents), then running counts within a slot.  So no source, however large, has to be
counted through in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.session import cut, slices, spread

#: Documents a slot of an order, about; a source gets as many slots a pass as it needs.
PER_SLOT = 50_000


#: fixed value: how the public byte-level vocabularies split a text before merging
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str):
    """A counter of tokens by the byte-level vocabulary of ranks at ``path`` (a ``tiktoken`` file)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(own.encode_ordinary(text))


def token_counts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents as (doc, source, tokens), counted by the public vocabulary file at ``vocabulary``.

    Null texts count 0 tokens.  Special tokens' strings in a text are ordinary text.
    """
    kept: dict = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not kept:
            kept["count"] = encoder(vocabulary)
        for pdf in slices(batches):
            yield pd.DataFrame({"doc": pdf["doc"], "source": pdf["source"], "tokens": [kept["count"](t) for t in pdf["text"]]})

    given = docs.select(F.col(doc_id).alias("doc"), "source", F.coalesce(F.col(text), F.lit("")).alias("text"))
    return spread(given).mapInPandas(run, f"doc {dict(docs.dtypes)[doc_id]}, source string, tokens long")


def source_name(column):
    """A source as the targets write it: trimmed, lower case, ``_`` for ``-``."""
    return F.lower(F.replace(F.trim(column), F.lit("-"), F.lit("_")))


def mixture(counted: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 11) -> DataFrame:
    """(doc, source, pass, tokens, finish): the mixture, to be read in order of ``finish``.

    counted: doc, source, tokens; targets: source, target_share, max_repeats.  Sources are compared
    by ``source_name``; documents without a source or of one that has no target are left out, and so are those of no
    tokens.  The shares of sources without any document are spread over the others in proportion.
    ``budget`` is the total of tokens; by default the most for which every source reaches its share within
    its cap.  With a larger budget a source stops at its cap, the others go on in proportion until the total is reached, and
    the shares drift, which ``shares`` reports.
    """
    want = targets.where("target_share > 0").select(source_name(F.col("source")).alias("source"), "target_share", F.greatest("max_repeats", F.lit(1)).alias("repeats"))
    docs = cut(counted.where("tokens > 0").withColumn("source", source_name(F.col("source"))).join(F.broadcast(want), "source"))
    held = docs.groupBy("source", "target_share", "repeats").agg(F.sum("tokens").alias("held"), F.count(F.lit(1)).alias("docs"))  # one row a target
    over = Window.partitionBy(F.lit(0))  # over one row a target
    most = F.min(F.col("held") * F.col("repeats") / F.col("target_share")).over(over)
    whole = F.sum("target_share").over(over)
    plan = held.select("source", (F.col("target_share") / whole).alias("share"), (most * whole).alias("budget"), F.ceil(F.col("docs") / PER_SLOT).alias("slots"))
    queued = docs.join(F.broadcast(plan), "source").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    queued = queued.withColumn("order", F.xxhash64("doc", "pass", F.lit(seed)))
    # the order as a share of its range, 31 bits of it, times the number of slots
    queued = queued.withColumn("order", F.col("order").bitwiseXOR(F.lit(-(1 << 63)))).withColumn("slot", F.shiftright(F.shiftrightunsigned(F.col("order").bitwiseXOR(F.lit(-(1 << 63))), 33) * F.col("slots"), 31))
    queued = queued.select("doc", "source", "pass", "tokens", "share", "budget", "order", "slot")
    sums = queued.groupBy("source", "pass", "slot").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("pass", "slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "pass", "slot", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "pass", "slot").orderBy(F.col("order"), "doc").rowsBetween(Window.unboundedPreceding, 0)
    placed = queued.join(offsets, ["source", "pass", "slot"]).withColumn("finish", (F.col("before") + F.sum("tokens").over(inside)) / F.col("share"))
    kept = placed.where("finish <= budget") if budget is None else _truncated(cut(placed), budget)
    return kept.select("doc", "source", "pass", "tokens", "finish").orderBy("finish", "source", "doc")


def _truncated(placed: DataFrame, budget: int) -> DataFrame:
    """The rows in order of ``finish`` (ties by source, document and pass) whose running total of tokens is at most ``budget``."""
    size = placed.agg(F.count(F.lit(1)).alias("n"), F.max("finish").alias("last")).first()
    slots = max(1, ceil(size.n / PER_SLOT))
    rows = placed.withColumn("slot", F.least(F.floor(F.col("finish") / F.lit(size.last or 1.0) * slots), F.lit(slots - 1)))
    sums = rows.groupBy("slot").agg(F.sum("tokens").alias("sum"))
    # one row for PER_SLOT documents: summed up in one task
    before = Window.partitionBy(F.lit(0)).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("slot", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("total"))
    inside = Window.partitionBy("slot").orderBy("finish", "source", "doc", "pass").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, "slot").withColumn("total", F.col("total") + F.sum("tokens").over(inside)).where(F.col("total") <= budget)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, docs, passes) of every target; a source without documents has 0."""
    per = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.max("pass").alias("passes"))
    want = targets.select(source_name(F.col("source")).alias("source"), "target_share")
    out = want.join(per, "source", "left").withColumn("all", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # over one row a target
    zero = F.lit(0)
    return out.select("source", "target_share", (F.coalesce("tokens", zero) / F.col("all")).alias("actual_share"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("docs", zero).alias("docs"), F.coalesce("passes", zero).alias("passes"))
