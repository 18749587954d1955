"""Long exact spans shared between records (problem 10).

A span of at least ``min_words`` words that two documents share is a node of depth ``min_words``
or more in the suffix tree over the words of all documents, with leaves from two documents.  The
suffixes are split by prefixes of varying length into groups that fit in memory, and a subtree is
built for each, so that no tree ever has to be held as a whole:

1. Every suffix is represented by the short prefix (``PREFIX`` words) of least fingerprint inside
   its first ``min_words`` words.  Suffixes that agree on ``min_words`` words agree on that short
   prefix, and one short prefix serves about thirteen neighbouring suffixes, so this first
   partition is small.  Groups with leaves from one document only are dropped: no node of the
   wanted depth lies below them.
2. A group of at most ``GROUP`` runs of suffixes is gathered with the words of its suffixes, and its subtree is
   built as a sorted array of suffixes with the lengths of common prefixes of neighbours.  Stretches of
   the array that agree on ``min_words`` words are the subtree's deep internal nodes; words are compared one
   by one (64-bit codes of words).
3. A greater group (a passage with a third of all documents below it) is split further, by the
   longest prefix that still matters, ``min_words`` words.  A node at that depth needs no subtree: its
   smallest and largest document tell whether it is shared, and are aggregated on the map side, so that no
   such group is gathered.  Here prefixes are compared by 128-bit fingerprints.

Runs of words below shared nodes, joined where they touch, are the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.operators.skew import salted_join
from sedge.session import cut, slices, spread

#: Words of a short prefix.
PREFIX = 25
#: Runs of suffixes (each about 13 suffixes, 63 words) of a group whose subtree is built in memory; and words worked on at once.
GROUP, WORDS = 20_000, 1_000_000
WORD = re.compile(r"[^ \t\r\n]+")
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the words of all ``texts``, one after the other, and each text's first index (and the end)."""
    lists = [WORD.findall(t) for t in texts]
    starts = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    words = np.empty(starts[-1], dtype=object)
    for k, x in enumerate(lists):
        words[starts[k] : starts[k + 1]] = x
    if not len(words):
        return np.zeros(0, dtype=np.uint64), starts
    codes, distinct = pd.factorize(words)
    return pd.util.hash_array(distinct, categorize=False)[codes], starts


def windows(h: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Polynomial fingerprints of all runs of ``length`` hashes, by doubling."""
    out, done, power, size, scale = None, 0, h, 1, base
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    bits = length
    with np.errstate(over="ignore"):
        while bits:
            if bits & 1:
                part = power[done : done + n]
                out = part.copy() if out is None else out * scale + part
                done += size
            bits >>= 1
            if bits:
                power = power[:-size] * scale + power[size:]
                scale = scale * scale
                size *= 2
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n, size = len(x) - width + 1, 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def _suffixes(texts: list[str], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every suffix with ``min_words`` words left in its text: text number, first word and short prefix; all word hashes and each text's first."""
    h, starts = word_hashes(texts)
    n = len(h) - min_words + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), h, starts
    prefix = min(PREFIX, min_words)
    short = _least(_mixed(windows(h, prefix, _B1)), min_words - prefix + 1)
    lengths = np.diff(starts)
    text = np.repeat(np.arange(len(texts)), lengths)[:n]
    first = np.arange(n) - starts[text]
    inside = first + min_words <= lengths[text]
    return text[inside], first[inside], short[inside], h, starts


def _short_prefixes(min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            text, _, short, _, _ = _suffixes(pdf["text"].tolist(), min_words)
            new = np.ones(len(text), dtype=bool)
            new[1:] = (text[1:] != text[:-1]) | (short[1:] != short[:-1])
            yield pd.DataFrame({"doc": pdf["doc"].to_numpy()[text[new]], "part": short[new].view(np.int64)})

    return run


def _extended(min_words: int):
    """Of every run of suffixes of an open group: its words, or in great groups each suffix with the fingerprint of its first ``min_words`` words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            texts = pdf["text"].tolist()
            text, first, short, h, starts = _suffixes(texts, min_words)
            if not len(text):
                continue
            kind = np.zeros(len(text), dtype=np.int8)  # 1: gathered, 2: great
            for k in range(len(texts)):
                at = slice(*np.searchsorted(text, [k, k + 1]))
                own = short[at].view(np.int64)
                for flag, column in ((1, "few"), (2, "many")):
                    kind[at][np.isin(own, np.asarray(pdf[column].iloc[k], dtype=np.int64))] = flag
            docs = pdf["doc"].to_numpy()
            head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (short[1:] != short[:-1]) | (first[1:] != first[:-1] + 1)]))
            tail = np.append(head[1:], len(text)) - 1
            head, tail = head[kind[head] == 1], tail[kind[head] == 1]
            begin, end = starts[text[head]] + first[head], starts[text[tail]] + first[tail] + min_words
            words = [h[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())]
            gathered = pd.DataFrame({"doc": docs[text[head]], "first": first[head].astype(np.int32), "part": short[head].view(np.int64), "words": pd.Series(words, dtype="object"), "k1": np.int64(0), "k2": np.int64(0)})
            great = kind == 2
            at = starts[text[great]] + first[great]
            one, two = windows(h, min_words, _B1), windows(_mixed(h), min_words, _B2)
            deep = pd.DataFrame({"doc": docs[text[great]], "first": first[great].astype(np.int32), "part": np.int64(0), "words": pd.Series([None] * len(at), dtype="object"), "k1": one[at].view(np.int64), "k2": two[at].view(np.int64)})
            yield pd.concat([gathered, deep], ignore_index=True)

    return run


def shared_leaves(owner: np.ndarray, words: list[np.ndarray], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, offset) of the suffixes below deep nodes of two documents, of the subtree over the suffixes of ``words``.

    owner is the document of each run of words; suffixes with fewer than ``min_words`` words left in their run are no leaves.
    """
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(lengths + 1)
    begins = ends - lengths - 1
    codes = np.zeros(int(ends[-1]), dtype=np.int64)
    flat = np.concatenate(words)
    inside = np.ones(len(codes), dtype=bool)
    inside[ends - 1] = False
    codes[inside] = np.unique(flat, return_inverse=True)[1] + len(words)
    codes[ends - 1] = np.arange(len(words))  # an end of its own for each run: no common prefix reaches over it
    ranks, size = [codes], 1
    while size < min_words:  # prefix doubling
        last = ranks[-1]
        after = np.concatenate([last[size:], np.full(min(size, len(last)), -1, dtype=np.int64)])
        ranks.append(np.unique(last * (len(codes) + len(words) + 2) + after + 1, return_inverse=True)[1])
        size *= 2
    run = np.repeat(np.arange(len(words)), np.maximum(lengths - min_words + 1, 0))
    leaf = np.arange(len(run)) - np.repeat(np.cumsum(np.maximum(lengths - min_words + 1, 0)) - np.maximum(lengths - min_words + 1, 0), np.maximum(lengths - min_words + 1, 0))
    at = begins[run] + leaf
    order = np.argsort(ranks[-1][at], kind="stable")
    run, leaf, at = run[order], leaf[order], at[order]
    # length of the common prefix of neighbours in the array, from the longest power of two down
    common, live = np.zeros(max(len(at) - 1, 0), dtype=np.int64), np.ones(max(len(at) - 1, 0), dtype=bool)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = np.minimum(at[:-1] + common, len(codes) - 1), np.minimum(at[1:] + common, len(codes) - 1)
        common += np.where(live & (ranks[k][a] == ranks[k][b]), 1 << k, 0)
        live &= common < min_words
    node = np.concatenate([[True], common < min_words]) if len(at) else np.zeros(0, dtype=bool)
    heads = np.flatnonzero(node)
    if not len(heads):
        return run, leaf
    low, high = np.minimum.reduceat(owner[run], heads), np.maximum.reduceat(owner[run], heads)
    shared = np.repeat(low != high, np.diff(np.append(heads, len(at))))
    return run[shared], leaf[shared]


def _subtrees(min_words: int):
    """(doc, lo, hi): stretches of first words of shared leaves; the rows come sorted by group, and a group is never divided."""

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [np.frombuffer(w, dtype=np.uint64) for w in pdf["words"]]
        docs, first = pdf["doc"].to_numpy(), pdf["first"].to_numpy()
        # runs of several groups in one array: suffixes of different groups differ within min_words words by themselves
        run, leaf = shared_leaves(docs, words, min_words)
        order = np.lexsort((leaf, run))
        run, leaf = run[order], leaf[order]
        head = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (leaf[1:] != leaf[:-1] + 1)])) if len(run) else np.zeros(0, dtype=np.int64)
        tail = np.append(head[1:], len(run)) - 1 if len(head) else head
        return pd.DataFrame({"doc": docs[run[head]], "lo": (first[run[head]] + leaf[head]).astype(np.int32), "hi": (first[run[head]] + leaf[tail]).astype(np.int32)})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            size += int(pdf["words"].str.len().sum()) // 8
            if size >= WORDS:
                rows = pd.concat(held, ignore_index=True)
                whole = int(np.searchsorted(rows["part"].to_numpy(), rows["part"].iloc[-1], "left"))  # the last group may go on
                if whole:
                    yield built(rows.iloc[:whole])
                held = [rows.iloc[whole:]]
                size = int(held[0]["words"].str.len().sum()) // 8
        if held:
            yield built(pd.concat(held, ignore_index=True))

    return work


def shared_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, group: int = GROUP) -> DataFrame:
    """(doc_id, first_word, last_word): the maximal runs of words that each lie in a shared span.

    A shared span is a run of at least ``min_words`` words that another document holds word for
    word; a word is a maximal run of characters other than space, tab, CR and LF.  Positions count
    from 0, both inclusive.  Null ids, null texts and texts of fewer words give no rows; a text
    that repeats itself shares nothing unless another document holds it too; rows of one id are
    one document.  An empty table gives no rows.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    base = spread(base)
    parts = cut(base.mapInPandas(_short_prefixes(min_words), "doc long, part long").distinct())
    open_parts = cut(parts.groupBy("part").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("part", (F.col("n") > group).alias("great")))
    listed = salted_join(parts, open_parts, "part")
    of_doc = listed.groupBy("doc").agg(F.collect_list(F.when(~F.col("great"), F.col("part"))).alias("few"), F.collect_list(F.when(F.col("great"), F.col("part"))).alias("many"))
    schema = "doc long, first int, part long, words binary, k1 long, k2 long"
    extended = cut(base.join(of_doc, "doc").mapInPandas(_extended(min_words), schema))
    gathered = extended.where("words is not null").select("part", "doc", "first", "words").repartition("part").sortWithinPartitions("part")
    low = gathered.mapInPandas(_subtrees(min_words), "doc long, lo int, hi int")
    suffixes = extended.where("words is null").select("doc", "first", F.struct("k1", "k2").alias("node"))
    deep = suffixes.groupBy("node").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("node")
    under = low.unionByName(salted_join(suffixes, deep, "node", "left_semi").select("doc", F.col("first").alias("lo"), F.col("first").alias("hi")))
    order = Window.partitionBy("doc").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = under.withColumn("new", F.when(F.col("lo") - before <= min_words, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc", "run").agg(F.min("lo").alias("first_word"), (F.max("hi") + (min_words - 1)).cast("int").alias("last_word")).select(
        F.col("doc").alias(doc_id), "first_word", "last_word"
    )


def shared_shares(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, shared_words, share) of every document with a text; share is 0 where nothing is shared, null for texts without words."""
    held = spans.groupBy(doc_id).agg(F.sum(F.col("last_word") - F.col("first_word") + 1).alias("shared_words"))
    words = docs.where(F.col(text).isNotNull()).select(doc_id, F.regexp_count(F.col(text), F.lit(r"[^ \t\r\n]+")).cast("long").alias("n_words"))
    out = words.join(held, doc_id, "left").withColumn("shared_words", F.coalesce("shared_words", F.lit(0)))
    return out.withColumn("share", F.expr("shared_words / nullif(n_words, 0)"))
