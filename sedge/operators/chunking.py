"""Cutting filings into chunks: whole tables, paragraphs, and long ones by sentences, words or characters; and checks of tables against sections."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.session import slices, spread

LIMIT, OVERLAP = 800, 100
_TOKEN = re.compile(r"\w+|[^\w\s]")
_GAP = re.compile(r"\n[ \t\r]*\n\s*")
_TABLE = re.compile(r"(?:^[ \t]*\|.*(?:\n|\Z))+", re.M)
_SENTENCE = re.compile(r"(?<=[.?!])[\"'”’)\]]*\s+")
_WORD = re.compile(r"\S+")


def word_tokens(text: str) -> list[int]:
    """Offsets at which tokens begin: words and single marks.  A tokenizer of one's own gives the same kind of list."""
    return [m.start() for m in _TOKEN.finditer(text)]


class Text:
    """A text with its token offsets: the number of tokens of a stretch is a binary search."""

    def __init__(self, text: str, tokens: Callable[[str], list[int]] = word_tokens):
        self.text, self.at = text, tokens(text)

    def count(self, start: int, end: int) -> int:
        return bisect_left(self.at, end) - bisect_left(self.at, start)

    def after(self, start: int, n: int) -> int:
        """The first offset behind ``start`` that has ``n`` tokens before it (or the end of the text)."""
        k = bisect_left(self.at, start) + n
        return self.at[k] if k < len(self.at) else len(self.text)

    def trimmed(self, start: int, end: int) -> tuple[int, int]:
        part = self.text[start:end]
        return start + len(part) - len(part.lstrip()), start + len(part.rstrip())

    def units(self) -> list[tuple[int, int, bool]]:
        """(start, end, is a table) of tables and paragraphs in order, trimmed, none empty."""
        out, at = [], 0
        for table in [*_TABLE.finditer(self.text), None]:
            end = table.start() if table else len(self.text)
            for gap in [*_GAP.finditer(self.text, at, end), None]:
                a, b = self.trimmed(at, gap.start() if gap else end)
                if a < b:
                    out.append((a, b, False))
                at = gap.end() if gap else end
            if table:
                out.append((*self.trimmed(table.start(), table.end()), True))
                at = table.end()
        return out

    def sentences(self, start: int, end: int) -> list[int]:
        """Offsets at which the sentences of a stretch begin."""
        return [start, *(m.end() for m in _SENTENCE.finditer(self.text, start, end) if m.end() < end)]

    def short(self, start: int, end: int, limit: int) -> Iterator[tuple[int, int]]:
        """A stretch in parts of at most ``limit`` tokens: at sentences, long ones at words, long ones after a number of tokens."""
        if self.count(start, end) <= limit:
            yield start, end
            return
        begins = self.sentences(start, end)
        if len(begins) == 1:
            begins = [m.start() for m in _WORD.finditer(self.text, start, end)]
        if len(begins) == 1:
            while self.count(start, end) > limit:
                stop = self.after(start, limit)
                yield start, stop
                start = stop
            yield start, end
            return
        first, stops = 0, [*begins[1:], end]
        while first < len(begins):
            # the last stop within the limit; a single part over it is cut further
            last = bisect_right(stops, self.after(begins[first], limit), first) - 1
            if last < first:
                yield from self.short(*self.trimmed(begins[first], stops[first]), limit)
                last = first
            else:
                yield self.trimmed(begins[first], stops[last])
            first = last + 1

    def chunks(self, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, bool]]:
        """(start, end, tokens, holds a table) of the chunks in order.

        Units are packed greedily up to ``limit`` tokens; a table is never cut and may be over it.  A chunk begins with the earliest sentence of
        the one before that leaves at most ``overlap`` tokens of it and room for the next unit, and never before the end of a table.
        """
        if not 0 <= overlap < limit:
            raise ValueError("the overlap must be at least 0 and less than the limit")
        parts = [(a, b, True) if table else (a, b, False) for x, y, table in self.units() for a, b in ([(x, y)] if table else self.short(x, y, limit))]
        out: list[tuple[int, int, int, bool]] = []
        k = 0
        while k < len(parts):
            start, end, has = parts[k]
            if out:
                start = self._overlap(out[-1], parts, k, limit, overlap)
            k += 1
            while k < len(parts) and self.count(start, parts[k][1]) <= limit:
                end, has = parts[k][1], has or parts[k][2]
                k += 1
            out.append((start, end, self.count(start, end), has))
        return out

    def _overlap(self, before: tuple, parts: list, k: int, limit: int, overlap: int) -> int:
        begin, end = parts[k][0], parts[k][1]
        floor = max(before[0] + 1, max((b for a, b, table in parts[:k] if table and b > before[0]), default=0))
        starts = [s for a, b, table in parts[max(0, k - 64) : k] if not table and b > floor for s in self.sentences(a, b) if s >= floor]
        for s in sorted(starts):
            if self.count(s, begin) <= overlap and self.count(s, end) <= limit:
                return s
        return begin


def chunked(texts: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, tokens: Callable[[str], list[int]] = word_tokens) -> DataFrame:
    """(key, ordinal, char_start, char_end, tokens, contains_table) of every chunk of every text; null, empty and blank texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, text, 2_000_000):
            rows = [(k, n, *c) for k, t in zip(pdf[key], pdf[text]) for n, c in enumerate(Text(t, tokens).chunks(limit, overlap))]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "char_start", "char_end", "tokens", "contains_table"])

    return spread(texts.where(F.col(text).isNotNull()).select(key, text)).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, ordinal int, char_start int, char_end int, tokens int, contains_table boolean")


def contained(spans: DataFrame, holders: DataFrame, group: str) -> DataFrame:
    """``spans`` (group, lo, hi, ...) with ``inside``: whether a holder (group, lo, hi) of its group begins no later and ends no earlier.

    One pass in order of beginnings with the furthest end of the holders so far; no pairs are formed.
    """
    rest = [c for c in spans.columns if c not in (group, "lo", "hi")]
    rows = spans.select(group, "lo", "hi", *rest, F.lit(1).alias("__kind")).unionByName(holders.select(group, "lo", "hi", F.lit(0).alias("__kind")), allowMissingColumns=True)
    so_far = Window.partitionBy(group).orderBy("lo", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = F.max(F.when(F.col("__kind") == 0, F.col("hi"))).over(so_far)
    return rows.withColumn("inside", F.coalesce(far >= F.col("hi"), F.lit(False))).where("__kind = 1").drop("__kind")


def table_reconciliation(tables: DataFrame, chunks: DataFrame, group: str) -> DataFrame:
    """(group, tables, whole, cut, flagged, flagged_empty, unflagged): of each group's tables how many lie in one chunk, and how its chunks' flags agree with them.

    tables: group, lo, hi; chunks: group, lo, hi, contains_table.  Chunks and tables meet by their places: a chunk is taken to hold a table when one begins in it.
    """
    t = contained(tables, chunks, group).groupBy(group).agg(F.count(F.lit(1)).alias("tables"), F.count_if("inside").alias("whole"))
    rows = chunks.select(group, "lo", "hi", "contains_table", F.lit(0).alias("__kind")).unionByName(tables.select(group, "lo", "hi", F.lit(1).alias("__kind")), allowMissingColumns=True)
    following = Window.partitionBy(group).orderBy("lo", "__kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    next_table = F.min(F.when(F.col("__kind") == 1, F.col("lo"))).over(following)
    c = rows.withColumn("__holds", F.coalesce(next_table < F.col("hi"), F.lit(False))).where("__kind = 0")
    flags = c.groupBy(group).agg(F.count_if("contains_table").alias("flagged"), F.count_if(F.col("contains_table") & ~F.col("__holds")).alias("flagged_empty"), F.count_if(~F.col("contains_table") & F.col("__holds")).alias("unflagged"))
    zero = F.lit(0)
    both = flags.join(t, group, "full")
    whole, tables_ = F.coalesce("whole", zero), F.coalesce("tables", zero)
    return both.select(group, tables_.alias("tables"), whole.alias("whole"), (tables_ - whole).alias("cut"), F.coalesce("flagged", zero).alias("flagged"), F.coalesce("flagged_empty", zero).alias("flagged_empty"), F.coalesce("unflagged", zero).alias("unflagged"))


def statements_section(form: Column, item_8: Column, has_item_15: Column, least: int = 2000, phrase: str = "item 15") -> Column:
    """Where the financial statements of a filing are: Item 1 of a quarterly report, else Item 8, or Item 15 if Item 8 only points there."""
    pointer = (F.length(item_8) < least) & F.contains(F.lower(item_8), F.lit(phrase)) & has_item_15
    return F.when(form != "10-K", "Item 1").when(F.coalesce(pointer, F.lit(False)), "Item 15").otherwise("Item 8")


def cross_references(texts: DataFrame, key: str, text: str, share: float = 0.12) -> DataFrame:
    """(key, item, heading): the index of items in the last ``share`` of a text, a line ``Item N ... heading`` each; of several of an item the first counts."""
    tail = F.substring(F.col(text), F.length(text) - F.floor(F.length(text) * share).cast("int") + 1, F.length(text))
    lines = F.regexp_extract_all(tail, F.lit(r"(?im)^[|\s]*item[ \t]+[0-9]{1,2}[a-c]?[.:|\s-]+[^\n|]+"), F.lit(0))
    rows = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(lines).alias("pos", "line"))
    item = F.concat(F.lit("Item "), F.upper(F.regexp_extract("line", r"(?i)item[ \t]+([0-9]{1,2}[a-c]?)", 1)))
    heading = F.trim(F.regexp_replace("line", r"(?i)^[|\s]*item[ \t]+[0-9]{1,2}[a-c]?[.:|\s-]+", ""))
    return rows.groupBy(key, item.alias("item")).agg(F.min_by(heading, F.col("pos")).alias("heading"))


def heading_bodies(texts: DataFrame, headings: DataFrame, key: str, text: str) -> DataFrame:
    """(key, heading, start, end): the last line of a text that begins with each heading, and the stretch from there to the next such heading's line.

    headings: key, heading.  Headings that begin no line, and those within another's line, give no rows.
    """
    listed = headings.where(F.trim("heading") != "").groupBy(key).agg(F.sort_array(F.collect_set("heading")).alias("__headings"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t, names in zip(pdf[key], pdf[text], pdf["__headings"]):
                lines = f"\n{t}"
                found = sorted((at, -len(h), h) for h in names if (at := lines.rfind(f"\n{h}")) >= 0)
                kept: list[tuple[int, str]] = []
                for at, n, h in found:
                    if not kept or at >= kept[-1][0] + len(kept[-1][1]):
                        kept.append((at, h))
                rows += [(k, h, at, kept[i + 1][0] if i + 1 < len(kept) else len(t)) for i, (at, h) in enumerate(kept)]
            yield pd.DataFrame(rows, columns=[key, "heading", "start", "end"])

    joined = texts.where(F.col(text).isNotNull()).select(key, text).join(listed, key)
    return joined.mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, heading string, start int, end int")
