"""Candidate pairs of names, links of records over time, and printed numbers that agree."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.text import acronym, match_key, ngrams, ratio_of, token_set_ratio
from sedge.operators.vectors import top_k
from sedge.session import cut, spread

#: Keys a block of the fuzzy comparison.
BLOCK = 1000

# fixed values: how much one printed unit is
UNITS = {"usd": "1", "thousand": "1000", "million": "1000000", "billion": "1000000000", "percent": "0.01", "ratio": "1"}


def factor(unit: Column) -> Column:
    """The size of a unit as a decimal; null for an unknown one."""
    table = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v)])
    return F.try_element_at(table, F.lower(unit)).cast("decimal(20,2)")


def resolution(printed: Column, unit: Column) -> Column:
    """What one step of the last printed digit is worth: ``12.5`` million has a step of 100,000."""
    places = F.length(F.regexp_extract(printed, r"\.([0-9]+)$", 1))
    return (F.lit(1).cast("decimal(10,0)") * factor(unit)).cast("decimal(28,8)") / F.pow(F.lit(10.0), places).cast("decimal(10,0)")


def agree(a: Column, unit_a: Column, b: Column, unit_b: Column) -> Column:
    """Whether two printed numbers may be the same: they differ by at most half a step of the coarser one; null for unknown units or no numbers."""
    x = F.replace(a, F.lit(",")).try_cast("decimal(20,6)") * factor(unit_a)
    y = F.replace(b, F.lit(",")).try_cast("decimal(20,6)") * factor(unit_b)
    step = F.greatest(resolution(F.replace(a, F.lit(",")), unit_a), resolution(F.replace(b, F.lit(",")), unit_b))
    return F.abs(x - y) * 2 <= step


def _alike(cutoff: float):
    """Pairs of two blocks of keys with a token set ratio of ``cutoff`` or more.

    The ratio is taken only where one of its three terms can reach the cutoff: the length of the common words tells it for two of them,
    the letters in common bound the third.
    """
    letters = {c: k for k, c in enumerate(" abcdefghijklmnopqrstuvwxyz0123456789")}
    other = len(letters)  # all letters of other scripts together: the bound only gets wider

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = (pdf.loc[pdf["block"] == b, "k"].to_numpy() for b in key)
        both = [*one, *two]
        words = [sorted(set(k.split())) for k in both]
        vocabulary = {w: n for n, w in enumerate({w for ws in words for w in ws})}
        bag, has = np.zeros((len(both), other + 1), dtype=np.int16), np.zeros((len(both), len(vocabulary)), dtype=np.float32)
        for n, ws in enumerate(words):
            has[n, [vocabulary[w] for w in ws]] = 1
            for c in " ".join(ws):
                bag[n, letters.get(c, other)] += 1
        size, m = bag.sum(axis=1).astype(np.float32), len(one)
        weight = np.array([len(w) + 1 for w in vocabulary], dtype=np.float32)
        common = np.maximum((has[:m] * weight) @ has[m:].T - 1, 0)  # characters of the common words
        shared = np.zeros(common.shape, dtype=np.int16)
        for c in range(other + 1):
            shared += np.minimum(bag[:m, None, c], bag[None, m:, c])
        x, y, least = size[:m, None], size[None, m:], cutoff / 100 - 1e-6
        may = (2 * shared >= least * (x + y)) | (common > 0) & (2 * common >= least * (common + np.minimum(x, y)))
        pairs = [(one[i], two[j]) for i, j in zip(*np.nonzero(may)) if (key[0] < key[1] or one[i] < two[j]) and token_set_ratio(one[i], two[j]) >= cutoff]
        return pd.DataFrame([sorted(p) for p in pairs], columns=["key_a", "key_b"]).astype("object")

    return run


def fuzzy_pairs(keys: DataFrame, cutoff: float) -> DataFrame:
    """(key_a, key_b), a < b: all pairs of the distinct match keys ``k`` with a token set ratio of ``cutoff`` or more, block by block."""
    blocks = ceil(max(keys.count(), 1) / BLOCK)
    own = keys.select("k", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    to = own.select("k", "block", other.alias("other")).select("k", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    return to.repartition(max(1, blocks * (blocks + 1) // 2), "lo", "hi").groupBy("lo", "hi").applyInPandas(_alike(cutoff), "key_a string, key_b string")


def candidate_pairs(nodes: DataFrame, rare: int = 3, fuzzy: float | None = None, vectors: DataFrame | None = None, top: int = 3) -> DataFrame:
    """(key_a, key_b, rules), a < b: pairs of distinct match keys that share a rare word or of which one is the other's acronym.

    nodes: name.  Equal keys are one class already (rule ``equal``), so no pairs are formed within it.  A word is rare when at most ``rare`` keys have it: the
    pairs of a word are bounded.  With ``fuzzy`` also all pairs of that token set ratio or more (rule ``fuzzy``), with ``vectors`` (k, vec; one a match key) those
    of which one is among the ``top`` nearest of the other (rule ``embedding``).  ``rules`` are sorted.
    """
    keys = nodes.select(match_key(F.col("name")).alias("k")).where("k <> ''").distinct()
    words = keys.select("k", F.explode(F.array_distinct(F.split("k", " "))).alias("word")).where("word <> ''")
    few = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, rare)).select("word")
    own = words.join(few, "word")
    shared = own.select("word", F.col("k").alias("key_a")).join(own.select("word", F.col("k").alias("key_b")), "word").where("key_a < key_b").select("key_a", "key_b", F.lit("rare_word").alias("rule"))
    long = keys.where("k like '% %'").select(F.col("k").alias("long"), acronym(F.col("k")).alias("short"))
    short = keys.where("k not like '% %'").select(F.col("k").alias("short"))
    named = long.join(short, "short").select(F.least("long", "short").alias("key_a"), F.greatest("long", "short").alias("key_b"), F.lit("acronym").alias("rule"))
    pairs = shared.unionByName(named)
    if fuzzy is not None:
        pairs = pairs.unionByName(fuzzy_pairs(cut(keys), fuzzy).withColumn("rule", F.lit("fuzzy")))
    if vectors is not None:
        held = vectors.join(keys, "k", "left_semi")
        near = top_k(held, held, top, "k", "vec").where("query <> k").select(F.least("query", "k").alias("key_a"), F.greatest("query", "k").alias("key_b"), F.lit("embedding").alias("rule"))
        pairs = pairs.unionByName(near)
    return pairs.groupBy("key_a", "key_b").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))


def title_key(c: Column) -> Column:
    """A title for comparison over time: case and blanks do not count, punctuation does."""
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\r\n]+", " "))


def exact_links(later: DataFrame, earlier: DataFrame, pairs: DataFrame) -> DataFrame:
    """(later_key, earlier_key): items of a filing and of the filing before with the same title.

    later and earlier: accession, key, title; pairs: later, earlier.  A title that the earlier filing has twice links nothing,
    as there is no telling which is meant.
    """
    old = earlier.select(F.col("accession").alias("earlier"), F.col("key").alias("earlier_key"), title_key(F.col("title")).alias("t"))
    one = old.groupBy("earlier", "t").agg(F.min("earlier_key").alias("earlier_key"), F.count_distinct("earlier_key").alias("n")).where("n = 1")
    new = later.select(F.col("accession").alias("later"), F.col("key").alias("later_key"), title_key(F.col("title")).alias("t")).distinct()
    return new.join(pairs, "later").join(one, ["earlier", "t"]).select("later_key", "earlier_key")


def choose_links(exact: DataFrame, decided: DataFrame) -> DataFrame:
    """(later_key, earlier_key, method): one predecessor an item, the exact one if any, else the ``same`` decision of lowest rank.

    decided: later_key, earlier_key, rank, answer.
    """
    both = exact.select("later_key", "earlier_key", F.lit("exact").alias("method"), F.lit(0).alias("rank")).unionByName(
        decided.where("answer = 'same'").select("later_key", "earlier_key", F.lit("decided").alias("method"), F.col("rank").cast("int").alias("rank"))
    )
    return both.groupBy("later_key").agg(F.min_by(F.struct("earlier_key", "method"), F.struct("rank", "earlier_key")).alias("x")).select("later_key", "x.earlier_key", "x.method")


def named_in(questions: DataFrame, names: DataFrame, cutoff: float = 90) -> DataFrame:
    """(question, key, score): names a question holds, by the best ratio of the name to a run of as many words of the question.

    questions: question, text; names: key, name.  Both are compared as match keys.  A run that cannot reach ``cutoff`` by its length is not scored.
    """
    asked = questions.where("text is not null").select("question", match_key(F.col("text")).alias("t")).distinct()
    known = names.select("key", match_key(F.col("name")).alias("name")).where("name <> ''").distinct().withColumn("words", F.size(F.split("name", " ")))
    lengths = [r[0] for r in known.select("words").distinct().collect()]
    each = [F.struct(F.lit(n).alias("words"), ngrams(F.col("t"), n).alias("runs")) for n in sorted(lengths)]
    runs = asked.select("question", F.explode(F.array(*each)).alias("x")).select("question", "x.words", F.explode("x.runs").alias("run")).where("run <> ''") if each else None
    if runs is None:
        return known.select(F.lit(None).cast(dict(questions.dtypes)["question"]).alias("question"), "key", F.lit(0.0).alias("score")).where("false")
    texts = spread(runs.select("words", "run").distinct())
    a, b = F.length("run"), F.length("name")
    near = texts.join(known.select("words", "name").distinct(), "words").where(200 * F.least(a, b) >= cutoff * (a + b))
    # insertions and deletions alone are no fewer than edits, so most pairs end here, without leaving the JVM
    near = near.where(100 * F.levenshtein("run", "name") <= (100 - cutoff) * (a + b))
    scored = near.select("words", "run", "name", F.round(ratio_of("run", "name"), 6).alias("score")).where(F.col("score") >= cutoff)
    hits = scored.join(runs.distinct(), ["words", "run"]).join(known.select("key", "name"), "name")
    return hits.groupBy("question", "key").agg(F.max("score").alias("score"))


def anchors(names: DataFrame, cosines: DataFrame, limit: int) -> DataFrame:
    """(question, key, similarity, how, place): nodes named in a question first (similarity 1), then by cosine; ties by key.

    names: question, key, score; cosines: question, key, cosine.
    """
    rows = names.select("question", "key", F.lit(True).alias("named"), "score", F.lit(1.0).alias("similarity")).unionByName(
        cosines.select("question", "key", F.lit(False).alias("named"), F.lit(0.0).alias("score"), F.col("cosine").alias("similarity"))
    )
    best = rows.groupBy("question", "key").agg(F.max(F.struct("named", "score", "similarity")).alias("x")).select("question", "key", "x.*")
    order = Window.partitionBy("question").orderBy(F.desc("named"), F.desc("score"), F.desc("similarity"), "key")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("question", "key", "similarity", F.when(F.col("named"), "name").otherwise("embedding").alias("how"), "place")


def shown_chunks(held: DataFrame, scores: DataFrame, per: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(shown, handoff): the ``per`` best chunks of every community, and the ``k`` best chunks over all of them by their highest score; ties by chunk.

    held: community, chunk; scores: chunk, score.
    """
    order = Window.partitionBy("community").orderBy(F.desc("score"), "chunk")
    shown = held.distinct().join(scores, "chunk").withColumn("place", F.row_number().over(order)).where(F.col("place") <= per)
    handoff = shown.groupBy("chunk").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "chunk").limit(k)
    return shown, handoff


def gate(baseline: DataFrame, current: DataFrame, by: list[str], metric: str) -> DataFrame:
    """(by..., before, after, verdict) cell by cell after rounding to 9 places: same, better, worse, added or lost."""
    a = baseline.select(*by, F.round(metric, 9).alias("before"), F.lit(True).alias("__a"))
    b = current.select(*by, F.round(metric, 9).alias("after"), F.lit(True).alias("__b"))
    verdict = (
        F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "lost").when(F.col("before").eqNullSafe(F.col("after")), "same").when(F.col("after") > F.coalesce("before", F.lit(float("-inf"))), "better").otherwise("worse")
    )
    return a.join(b, by, "full").select(*by, "before", "after", verdict.alias("verdict"))
