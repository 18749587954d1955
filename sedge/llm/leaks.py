"""Evaluation texts that leaked into training text (problem 8).

The held-out passages travel to every task, where an index of their character q-grams is kept; the
corpus is scanned and never shuffled.  Passages of more than ``ITEM_CHARS`` characters in all go out in several
blocks, each with a scan of its own.

Filter (q-gram lemma): a text window of ``w`` characters within ``edits`` edits of a window of a
passage shares at least ``w - q + 1 - q * edits`` q-grams with it, all on neighbouring diagonals
(text position minus passage position).  Shared q-grams are counted in diagonal bands that overlap
by half, so any true match lies wholly within one band; a band keeps its candidates only if it
reaches the bound for the shortest window of ``min_tokens`` tokens that the passage has, within
the length of that window.

Verification: a local alignment inside the band, and the longest run of equal consecutive tokens
within the stretches of text between the first and the last counted q-gram of a band: a run of ``min_tokens``
tokens reaches the bound by itself, so it lies within such a stretch whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.spans import windows
from sedge.session import slices, spread

TOKEN = re.compile(r"[^\W_]+")
Q = 12
_B = np.uint64(0x9E3779B97F4A7C15)
#: Characters of passages that travel to every task at once.
ITEM_CHARS = 20_000_000
TABLE_BITS = 22


def tokens(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return [t.lower() for t in TOKEN.findall(text)]


def _codes(joined: str) -> np.ndarray:
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Fingerprint of every run of ``q`` characters."""
    out = windows(codes + np.uint64(1), q, _B)
    with np.errstate(over="ignore"):
        out ^= out >> np.uint64(31)
        out *= _B
    return out


class Passages:
    """Index of the passages: sorted q-gram fingerprints with passage and position, and the bound of each passage."""

    def __init__(self, items: list[tuple[str, str]], min_tokens: int, edits: int, q: int = Q):
        self.ids = [i for i, _ in items]
        self.tokens = [tokens(p) for _, p in items]
        self.joined = [" ".join(t) for t in self.tokens]
        self.codes = [_codes(j) for j in self.joined]
        self.q, self.edits, self.min_tokens = q, edits, min_tokens
        self.bound = np.ones(len(items), dtype=np.int64)
        self.span = np.zeros(len(items), dtype=np.int64)
        grams, owner, at = [], [], []
        for k, t in enumerate(self.tokens):
            ends = np.cumsum([len(x) + 1 for x in t]) if t else np.zeros(0, dtype=np.int64)
            if len(t) >= min_tokens:
                begins = np.concatenate([[0], ends[:-1]])
                window = int((ends[min_tokens - 1 :] - 1 - begins[: len(t) - min_tokens + 1]).min())
                self.bound[k] = max(1, window - q + 1 - q * edits)
                self.span[k] = window - q + edits
                g = _grams(self.codes[k], q)
                grams.append(g), owner.append(np.full(len(g), k)), at.append(np.arange(len(g)))
        self.grams = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        order = np.argsort(self.grams, kind="stable")
        self.grams = self.grams[order]
        self.owner = (np.concatenate(owner) if grams else np.zeros(0, dtype=np.int64))[order]
        self.at = (np.concatenate(at) if grams else np.zeros(0, dtype=np.int64))[order]
        self.seen = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.seen[self.grams >> np.uint64(64 - TABLE_BITS)] = True
        self.width = 2 * max(1, edits) + 2

    def candidates(self, joined: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, passage, lowest diagonal of the band, first and last text position of its q-grams) of every band that reaches its bound."""
        none = np.zeros(0, dtype=np.int64)
        codes = _codes("\n".join(joined) + "\n")
        starts = np.concatenate([[0], np.cumsum([len(j) + 1 for j in joined])])
        g = _grams(codes, self.q)
        where = np.flatnonzero(self.seen[g >> np.uint64(64 - TABLE_BITS)])
        lo, hi = np.searchsorted(self.grams, g[where], "left"), np.searchsorted(self.grams, g[where], "right")
        n = hi - lo
        where, lo, n = where[n > 0], lo[n > 0], n[n > 0]
        if not len(where):
            return none, none, none, none, none
        which = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        pos = np.repeat(where, n)
        text = np.searchsorted(starts, pos, "right") - 1
        pos = pos - starts[text]
        owner, diagonal = self.owner[which], pos - self.at[which]
        half = self.width // 2
        out = []
        for shift in (0, half):
            band = (diagonal + shift) // self.width
            order = np.lexsort((pos, band, owner, text))
            t, o, b, p = text[order], owner[order], band[order], pos[order]
            # as many q-grams as the bound within the length of the shortest window
            reach = np.arange(len(t)) + self.bound[o] - 1
            far = np.minimum(reach, len(t) - 1)
            ok = (reach < len(t)) & (t[far] == t) & (o[far] == o) & (b[far] == b) & (p[far] - p <= self.span[o])
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            head = np.ones(len(at), dtype=bool)
            head[1:] = (t[at[1:]] != t[at[:-1]]) | (o[at[1:]] != o[at[:-1]]) | (b[at[1:]] != b[at[:-1]])
            first = np.flatnonzero(head)
            last = np.append(first[1:], len(at)) - 1
            h, e = at[first], far[at[last]]
            out.append((t[h], o[h], b[h] * self.width - shift, p[h], p[e]))
        if not out:
            return none, none, none, none, none
        return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]

    def aligned(self, codes: np.ndarray, passage: int, low: int, first: int, last: int) -> tuple[int, int, int]:
        """(score, begin, end) in the text of the best local alignment within the band: +1 a match, -2 an edit."""
        own, w = self.codes[passage], self.width + 1
        best, gap = (0, 0, 0), np.arange(w) * 2
        h, begin = np.zeros(w, dtype=np.int64), np.zeros(w, dtype=np.int64)
        for i in range(max(0, first - low - w), min(len(own), last + self.q - low + w)):
            at = i + low + np.arange(w)  # text position per diagonal
            inside = (at >= 0) & (at < len(codes))
            same = np.zeros(w, dtype=bool)
            same[inside] = codes[at[inside]] == own[i]
            stay = np.where(same, h + 1, h - 2)
            start = np.where(h > 0, begin, at)
            up, up_start = np.append(h[1:] - 2, -9), np.append(begin[1:], 0)
            take = up > stay
            value, start = np.where(take, up, stay), np.where(take, up_start, start)
            lead = value + gap
            top = np.maximum.accumulate(lead)
            source = np.maximum.accumulate(np.where(lead == top, np.arange(w), 0))
            value, start = top - gap, start[source]
            h, begin = np.where(inside, np.maximum(value, 0), 0), start
            k = int(h.argmax())
            if h[k] > best[0]:
                best = (int(h[k]), int(begin[k]), int(at[k]) + 1)
        return best

    def longest_run(self, text_tokens: list[str], passage: int) -> int:
        """The most consecutive tokens that text and passage have in common."""
        own, best = self.tokens[passage], 0
        places: dict[str, list[int]] = {}
        for k, t in enumerate(own):
            places.setdefault(t, []).append(k)
        runs: dict[int, int] = {}
        for t in text_tokens:
            runs = {k: runs.get(k - 1, 0) + 1 for k in places.get(t, ())}
            best = max([best, *runs.values()])
        return best


def _stretch_tokens(joined: str, first: int, last: int) -> list[str]:
    """The whole tokens of ``joined`` that the characters from ``first`` to ``last`` touch."""
    end = joined.find(" ", last)
    return joined[joined.rfind(" ", 0, first + 1) + 1 : len(joined) if end < 0 else end].split(" ")


def _merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _leaks_in(p: Passages, joined: list[str]) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(text, passage) -> (score, begin, end, run) of the verified candidates of some texts."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    stretches, verified = defaultdict(list), defaultdict(list)
    codes: dict[int, np.ndarray] = {}
    for t, o, low, first, last in sorted(zip(*(x.tolist() for x in p.candidates(joined)))):
        band = (low + p.width // 4) // (p.width // 2)
        stretches[t, o].append((first, last + p.q))
        # what was aligned whole in a band need not be aligned again in the one that overlaps it by half
        if any(band - b in (0, 1) and begin <= first and last + p.q <= end for b, begin, end in verified[t, o]):
            continue
        if t not in codes:
            codes = {t: _codes(joined[t])}
        score, begin, end = p.aligned(codes[t], o, low, first, last)
        if score >= p.bound[o]:
            verified[t, o].append((band, begin, end))
            if score > found.get((t, o), (0,))[0]:
                found[t, o] = (score, begin, end)
    return {(t, o): (*v, max(p.longest_run(_stretch_tokens(joined[t], a, b), o) for a, b in _merged(stretches[t, o]))) for (t, o), v in found.items()}


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", min_tokens: int = 12, edits: int = 1, item_chars: int = ITEM_CHARS
) -> DataFrame:
    """(doc_id, item_id, begin, end, score, run): every item whose passage a document holds in part.

    A row says that some window of the document lies within ``edits`` character edits of a window
    of at least ``min_tokens`` tokens of the passage; ``begin`` and ``end`` are offsets of the best
    alignment in the document's tokens joined by single blanks, ``run`` is the length of the longest
    run of equal consecutive tokens in the matching stretches.  Tokens are maximal runs of letters and digits in lower case.
    Passages of fewer tokens, null passages and null or empty texts give no rows; repeated items
    and repeated documents count once.  There is no limit on the items: at most about ``item_chars`` characters of
    passages are held at once, and each such block of items is looked for in a scan of its own.
    """
    held = items.select(F.col(item_id).alias("item"), F.col(passage).alias("passage")).where("item is not null and passage is not null").distinct()
    blocks = max(1, ceil((held.agg(F.sum(F.length("passage"))).first()[0] or 0) / item_chars))
    base = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text <> ''")
    base = spread(base)

    def scan(block: int) -> DataFrame:
        own = held if blocks == 1 else held.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        index = docs.sparkSession.sparkContext.broadcast(sorted((r[0], r[1]) for r in own.collect()))
        kept: dict = {}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if "p" not in kept:
                kept["p"] = Passages(index.value, min_tokens, edits)
            p: Passages = kept["p"]
            for pdf in slices(batches):
                found = _leaks_in(p, [" ".join(TOKEN.findall(t)).lower() for t in pdf["text"]])
                ids = pdf["doc"].to_numpy()
                yield pd.DataFrame([(ids[t], p.ids[o], *v) for (t, o), v in found.items()], columns=["doc", "item_id", "score", "begin", "end", "run"]).astype({"doc": "int64", "item_id": "object"})

        return base.mapInPandas(run, "doc long, item_id string, score long, begin long, end long, run long")

    rows = reduce(DataFrame.unionByName, (scan(b) for b in range(blocks)))
    # an id or an item that occurs again counts once
    best = rows.groupBy("doc", "item_id").agg(F.max_by(F.struct("begin", "end", "score"), "score").alias("best"), F.max("run").alias("run"))
    return best.select(F.col("doc").alias(doc_id), "item_id", "best.begin", "best.end", "best.score", "run")
