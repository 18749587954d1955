"""Splitting oversized items at natural boundaries (problem 3).

The word offsets of an item are a sorted array, so the number of words up to any offset is a
binary search, and so is the last natural boundary (the end of a sentence unit, a line of a list
or table, a paragraph) within the limit.  A piece ends there, or after ``limit`` words where the
item offers none; the next begins ``overlap`` words before that end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.sentences import Model
from sedge.operators.skew import salted_join
from sedge.session import slices

WORD = re.compile(r"[^ \t\r\n]+")
LIMIT, OVERLAP = 160, 20


def cuts(n: int, boundaries: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(first word, end word, at a natural boundary) of the pieces of ``n`` words; ``boundaries`` are sorted word numbers that a piece may end before."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    out, start = [], 0
    while n - start > limit:
        k = int(np.searchsorted(boundaries, start + limit, "right")) - 1
        natural = k >= 0 and boundaries[k] > start + overlap
        end = int(boundaries[k]) if natural else start + limit
        out.append((start, end, bool(natural)))
        start = end - overlap
    if n:
        out.append((start, n, True))
    return out


def split_text(text: str, model: Model, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, bool]]:
    """(char_start, char_end, words, at a natural boundary) of the pieces of a text; offsets within the text, end exclusive."""
    spans = np.array([m.span() for m in WORD.finditer(text)], dtype=np.int64).reshape(-1, 2)
    n = len(spans)
    boundaries = np.zeros(0, dtype=np.int64)
    if n > limit:
        ends = np.array([b for _, b in model.units(text)], dtype=np.int64)
        k = np.searchsorted(spans[:, 0], ends, "left")  # words that begin before the boundary
        whole = (k > 0) & (spans[np.maximum(k, 1) - 1, 1] <= ends)  # not inside a word
        boundaries = np.unique(k[whole])
    return [(int(spans[a, 0]), int(spans[b - 1, 1]), b - a, natural) for a, b, natural in cuts(n, boundaries, limit, overlap)]


def chunk_stretches(chunks: DataFrame, filings: DataFrame) -> DataFrame:
    """(chunk_id, char_start, stretch, n_words) of each chunk whose filing exists.

    ``accession_no`` is trimmed.  Chunks without a filing or with a null id or offset give no rows; offsets
    outside the text are clipped.  Texts are moved once, to their chunks: a filing that was loaded again gives its stretches
    again (``oversized_pieces`` makes them distinct), one with several texts those of each.
    """
    asked = chunks.select(F.btrim("accession_no", F.lit(" \t")).alias("acc"), "chunk_id", "char_start", "char_end").where(
        "chunk_id is not null and char_start is not null and char_end is not null"
    )
    texts = filings.where("parsed_text is not null").select(F.col("accession_no").alias("acc"), "parsed_text")
    begin = F.greatest(F.col("char_start"), F.lit(0))
    stretch = F.substring(F.col("parsed_text"), begin + 1, F.greatest(F.col("char_end") - begin, F.lit(0)))
    joined = salted_join(asked.distinct(), texts, "acc").select("chunk_id", begin.alias("char_start"), stretch.alias("stretch"))
    return joined.withColumn("n_words", F.regexp_count("stretch", F.lit(r"[^ \t\r\n]+")))


def oversized_pieces(stretches: DataFrame, model: Model, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, piece, char_start, char_end, n_words, natural) of every stretch of more than ``limit`` words.

    Offsets count in the filing's text.  Consecutive pieces share exactly ``overlap`` words; no piece has
    more than ``limit``; ``natural`` is false where it had to be cut within a sentence.  Stretches within the limit,
    and empty ones, give no rows.
    """
    shared = stretches.sparkSession.sparkContext.broadcast(model.weights)
    kept: dict = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if "m" not in kept:
            kept["m"] = Model(shared.value)
        for pdf in slices(batches, "stretch"):
            rows = [
                (c, k, base + a, base + b, words, natural)
                for c, base, s in zip(pdf["chunk_id"], pdf["char_start"], pdf["stretch"])
                for k, (a, b, words, natural) in enumerate(split_text(s, kept["m"], limit, overlap))
            ]
            yield pd.DataFrame(rows, columns=["chunk_id", "piece", "char_start", "char_end", "n_words", "natural"])

    big = stretches.where(F.col("n_words") > limit).select("chunk_id", "char_start", "stretch")
    return big.mapInPandas(run, "chunk_id string, piece int, char_start int, char_end int, n_words int, natural boolean").distinct()
