"""Text functions.  Those that SQL expressions cover are Column functions; Unicode folding and fuzzy ratios are Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# fixed values: legal forms that end a company's name
LEGAL_FORMS = "inc|incorporated|corp|corporation|co|company|ltd|limited|llc|lp|llp|plc|sa|ag|nv|se|gmbh|group|holdings"
#: fixed values: statuses an answer may declare
STATUSES = ("answered", "not_found", "declined")


@F.pandas_udf(StringType())
def norm(s: pd.Series) -> pd.Series:
    """Compatibility form, case folded, runs of blanks as one, trimmed; null stays null."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def norm_ascii(c: Column) -> Column:
    """``norm`` for ASCII text, without leaving the JVM."""
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\r\n]+", " "))


def escaped(c: Column) -> Column:
    """``%``, ``:`` and ``|`` percent-escaped, so that parts of a key can be joined by them."""
    out = F.replace(c, F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(out, F.lit(":"), F.lit("%3A")), F.lit("|"), F.lit("%7C"))


def node_key(label: Column, *parts: Column) -> Column:
    """``label:part:...`` with escaped parts."""
    return F.concat_ws(":", label, *[escaped(p) for p in parts])


def match_key(c: Column) -> Column:
    """A name without dots and apostrophes, ``&`` as ``and``, marks as blanks, and without legal forms at its end; its first word always stays."""
    s = F.regexp_replace(F.lower(unescape_markdown(c)), r"[.'’]", "")
    s = F.regexp_replace(F.replace(s, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " ")
    return F.regexp_replace(F.trim(s), rf"^([^ ]+(?: [^ ]+)*?)(?: (?:{LEGAL_FORMS}))+$", "$1")


def unescape_markdown(c: Column) -> Column:
    """Backslash escapes of ASCII marks taken off."""
    return F.regexp_replace(c, r"\\([!-/:-@\[-`{-~])", "$1")


def acronym(c: Column) -> Column:
    """First letters of the words of a match key."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.substring(w, 1, 1)), "")


def cited_ids(c: Column) -> Column:
    """Distinct ids in square brackets in order; several in one bracket are separated by commas or semicolons."""
    inner = F.regexp_extract_all(c, F.lit(r"\[([^\[\]\n]*)\]"), F.lit(1))
    ids = F.flatten(F.transform(inner, lambda x: F.transform(F.split(x, "[,;]"), lambda y: F.trim(y))))
    return F.array_distinct(F.filter(ids, lambda x: x != ""))


def strip_citations(c: Column) -> Column:
    """The text without citations and the blanks before them."""
    return F.trim(F.regexp_replace(c, r" *\[[^\[\]\n]*\]", ""))


def status_of(c: Column) -> Column:
    """The declared status of a raw answer in lower case, or ``no_status``."""
    s = F.lower(F.regexp_extract(c, r"^[ \t\r\n]*[Ss][Tt][Aa][Tt][Uu][Ss]:[ \t]*([A-Za-z_]+)", 1))
    return F.when(s.isin(*STATUSES), s).otherwise(F.lit("no_status"))


def accession_of(c: Column) -> Column:
    """The part of a chunk id before its last colon."""
    return F.regexp_replace(c, ":[^:]*$", "")


def chunk_id(accession: Column, ordinal: Column) -> Column:
    """``accession:0007``: the ordinal in at least four digits."""
    n = ordinal.cast("string")
    return F.concat(accession, F.lit(":"), F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n))


def snippet(text: Column, word: str, before: int = 30, after: int = 60) -> Column:
    """The text around the first hit of ``word``, the hit in ``**``; null where it is not found."""
    at = F.instr(F.lower(text), word.lower())
    low = F.greatest(at - before, F.lit(1))
    hit = F.concat(F.substring(text, low, at - low), F.lit("**"), F.substring(text, at, F.lit(len(word))), F.lit("**"), F.substring(text, at + len(word), F.lit(after)))
    return F.when(at > 0, hit)


def question_key(c: Column) -> Column:
    """A question for comparison: lower case, one blank between words, trimmed."""
    return norm_ascii(c)


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_{}\[\]()#+!|<>-])", r"\\$1")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ngrams(c: Column, n: int) -> Column:
    """All runs of ``n`` words of a blank-separated text."""
    words = F.filter(F.split(c, " "), lambda w: w != "")
    count = F.size(words) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def ratio(a: str, b: str) -> float:
    """Similarity 0-100 by insertions and deletions: twice the common subsequence over both lengths; two empty texts are 100."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs_length(a, b) / total


def token_set_ratio(a: str, b: str) -> float:
    """Similarity 0-100 of the sets of words: the common words alone count as a full match when one side has no other."""
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    both, left, right = " ".join(sorted(one & two)), " ".join(sorted(one - two)), " ".join(sorted(two - one))
    if both and (not left or not right):
        return 100.0
    with_left, with_right = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = ratio(with_left, with_right)
    return max(best, ratio(both, with_left), ratio(both, with_right)) if both else best


@F.pandas_udf(DoubleType())
def token_set_ratio_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def ratio_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


# fixed values: quotes, dashes and blanks that read alike
ALIKE = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "‑": "-", "\u00a0": " "}
_PIECE = re.compile(r"(?P<blank>\s+)|\\(?P<mark>[!-/:-@\[-`{-~])|(?P<plain>[!-\[\]-~]+)|(?P<other>.)", re.S)


class Readable:
    """A text as it reads: blanks as one, quotes, dashes and widths alike, marks without their markdown escapes.

    The text is cut into pieces (a run of blanks, an escaped mark, a run of plain ASCII, any other character), each with its reading; places in the
    reading are brought back to the text by a binary search among the pieces' ends.
    """

    def __init__(self, text: str):
        starts, sizes, stops, readings = [], [], [], []
        for m in _PIECE.finditer(text):
            kind = m.lastgroup
            own = " " if kind == "blank" else m.group(kind)
            if kind == "other":
                own = "".join(ALIKE.get(c, c) for c in unicodedata.normalize("NFKC", ALIKE.get(own, own)))
            starts.append(m.start()), stops.append(m.end()), sizes.append(len(own)), readings.append(own)
        self.reading = "".join(readings)
        self.ends = np.cumsum(sizes) if sizes else np.zeros(0, dtype=np.int64)
        self.sizes, self.starts, self.stops = sizes, starts, stops

    def _place(self, k: int) -> tuple[int, int]:
        """(start, end) in the text of the character ``k`` of the reading."""
        piece = int(np.searchsorted(self.ends, k, "right"))
        inner = k - (int(self.ends[piece]) - self.sizes[piece])
        whole = self.stops[piece] - self.starts[piece] == self.sizes[piece]
        return (self.starts[piece] + inner, self.starts[piece] + inner + 1) if whole else (self.starts[piece], self.stops[piece])

    def find(self, span: str, last: bool = False) -> tuple[int, int] | None:
        """Offsets in the text of the first (last) place that reads as ``span``; null for a blank span and where there is none."""
        want = Readable(span).reading.strip()
        at = (self.reading.rfind(want) if last else self.reading.find(want)) if want else -1
        return None if at < 0 else (self._place(at)[0], self._place(at + len(want) - 1)[1])


def find_span(span: str, text: str, last: bool = False) -> tuple[int, int] | None:
    """Offsets in ``text`` of the first (last) place that reads as ``span``."""
    return Readable(text).find(span, last)


def _span_udf(last: bool):
    @F.pandas_udf(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
    def find(span: pd.Series, text: pd.Series) -> pd.DataFrame:
        held: dict[str, Readable] = {}

        def one(s, t):
            if s is None or t is None:
                return None
            if t not in held:  # the spans of one text mostly stand together
                held.clear()
                held[t] = Readable(t)
            return held[t].find(s, last)

        return pd.DataFrame([one(s, t) or (None, None) for s, t in zip(span, text)], columns=["start", "end"]).astype("Int32")

    return find


find_span_in, find_last_span_in = _span_udf(False), _span_udf(True)


_NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?")


def changed_number(text: str) -> str | None:
    """The text with its first number made half as large again, in the same format; null without one."""
    m = _NUMBER.search(text)
    if not m:
        return None
    raw = m.group()
    places = len(raw.split(".")[1]) if "." in raw else 0
    value = float(raw.replace(",", "")) * 1.5
    return text[: m.start()] + (f"{value:,.{places}f}" if "," in raw else f"{value:.{places}f}") + text[m.end() :]


@F.pandas_udf(StringType())
def changed_number_in(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else changed_number(t))
