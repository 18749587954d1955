"""Sentence boundaries across languages and scripts (problem 2).

Candidates are runs of closing marks of any script with the closing quotes, brackets and citations
after them, and in Thai text single blanks.  A maximum-entropy (logistic) classifier decides each
from its neighbouring tokens, their case, length, digits and script.  It is trained without any
annotation, on boundaries that are reliable by themselves:

* positive: the mark that ends a paragraph, shown with the first token of the next paragraph;
* negative: a mark that a word in lower case or a further mark of punctuation follows; a mark on a
  token that ends no paragraph although it is frequent (``Dr.``, ``Nos.``), or before a token that
  begins none although it is frequent;
* positive too: marks inside a paragraph on tokens that end paragraphs, before tokens that begin them.

Blank lines end a unit, and a line that starts with ``|`` or ``- `` is one unit.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.session import slices, spread

#: Texts of the training sample, per source and language: the classifier is fitted on at most so many rows.
TRAIN_FILINGS = 250
TRAIN_ANSWERS_PER_LANG = 600
#: Characters of one training text that are used.
TRAIN_CHARS = 60_000
BUCKETS = 1 << 16
#: Occurrences after which a token that ends (begins) no paragraph is taken never to do so.
NEVER = 20

# fixed values: closing marks, closing quotes and brackets, opening quotes and brackets
MARKS = ".!?…。！？．।॥؟۔"
CLOSERS = "\"'”’»›」』】）》)]}“"
OPENERS = "\"'“‘«‹„「『【（《([{¿¡"

_CANDIDATE = re.compile(
    rf"[{re.escape(MARKS)}]+(?:[   ]?[»›]|[{re.escape(CLOSERS)}])*(?P<cite>(?:\s*\[[^\[\]\n]*\])*)"
    r"|(?<=[ก-ฺเ-๛0-9%])(?P<thai>(?: *\[[^\[\]\n]*\])* )(?=[ก-ฮเ-ไ])"
)
_BLANK = re.compile(r"\n[ \t\r\f\v]*\n\s*")
_ITEM_LINE = re.compile(r"^[ \t]*(?:\||- ).*$", re.M)
_CITED = re.compile(r"(?:\s*\[[^\[\]\n]*\])+$")
_LAST = re.compile(r"\S*$")
_NEXT = re.compile(r"\s*(\S*)")
_DIGITS = re.compile(r"\d+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")


def _kind(c: str) -> str:
    """Script and case of a character, as one word."""
    if not c:
        return "end"
    o = ord(c)
    if c.isdigit():
        return "digit"
    if c in OPENERS:
        return "open"
    if 0x3040 <= o <= 0x309F:
        return "hiragana"
    if 0x30A0 <= o <= 0x30FF:
        return "katakana"
    if 0x3400 <= o <= 0x9FFF:
        return "han"
    if 0x0E00 <= o <= 0x0E7F:
        return "thai"
    if 0x0900 <= o <= 0x097F:
        return "deva"
    if 0x0600 <= o <= 0x06FF:
        return "arab"
    if c.islower():
        return "lower"
    if c.isupper():
        return "upper"
    return "letter" if c.isalpha() else "sign"


class Candidate:
    """One candidate: where the unit before it ends, where the next begins, and what the classifier sees."""

    __slots__ = ("end", "begin", "token", "after", "features", "plain")

    def __init__(self, text: str, m: re.Match, start: int, next_text: str | None = None):
        self.end = m.end()
        mark = m.start()
        thai = m.group("thai")
        if thai is not None:
            self.end -= 1
            mark = m.start("thai")
        lead = text[max(start, mark - 160) : mark]
        cited = False
        if lead.endswith("]") and (own := _CITED.search(lead)):  # a citation before the mark: the token is the one before it
            cited, lead = True, lead[: own.start()]
        last = _LAST.search(lead[-40:]).group()
        before = lead[: len(lead) - len(last)].split()
        marks = "" if thai is not None else text[mark : m.start("cite")]
        if last and _CJK.match(last[-1]):  # no blanks between words: the last character stands for the word
            last = last[-1]
        cited = cited or (thai.strip() != "" if thai is not None else m.group("cite") != "")
        if next_text is None:
            after = _NEXT.match(text, self.end)
            sep = text[self.end : after.start(1)]
            following = after.group(1)[:40]
            self.begin = after.start(1)
        else:
            sep, following = " ", (next_text.split(None, 1) or [""])[0][:40]
            self.begin = self.end
        if following and _CJK.match(following):
            following = following[:2]
        word = _DIGITS.sub("9", last.lower().lstrip(OPENERS))
        self.token = f"{word}{marks}"
        kind = _kind(following[:1])
        if kind == "open":
            kind = "open-" + _kind(following[1:2])
        if kind == "lower" and any(c.isupper() for c in following[1:]):
            kind = "camel"
        self.after = _DIGITS.sub("9", following.lower().rstrip(".,;:!?"))
        self.plain = (kind, sep, cited, marks)
        shape = f"{_kind(last[:1])}{min(len(last), 5)}{'.' in last}{last[-1:].isdigit()}{last.isupper()}"
        prev = before[-1].lower() if before else "^"
        gap = "none" if not sep else "thai" if thai is not None else "blank"
        inside = "open" if _inside(text, start, mark + len(marks)) else "even"
        f = [
            "bias", f"t={self.token}", f"s={shape}", f"m={marks}", f"n={self.after}", f"k={kind}", f"g={gap}", f"c={cited}", f"i={inside}", f"p={_DIGITS.sub('9', prev)}",
            f"mk={marks}|{kind}", f"tk={self.token}|{kind}", f"sk={shape}|{kind}", f"gk={gap}|{kind}|{marks}", f"ck={cited}|{kind}", f"pt={prev}|{self.token}", f"tn={self.token}|{self.after}", f"ik={inside}|{kind}|{marks[-1:]}",
        ]
        self.features = [hash_of(x) for x in f]


_cache: dict[str, int] = {}


def hash_of(feature: str) -> int:
    """Bucket of a feature; the same in every process."""
    if (h := _cache.get(feature)) is None:
        h = 2166136261
        for b in feature.encode("utf-8", "surrogatepass"):
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        h = (h ^ h >> 15) % BUCKETS
        if len(_cache) < 500_000:
            _cache[feature] = h
    return h


_PAIRS = (("(", ")"), ("“", "”"), ("„", "“"), ("«", "»"), ("「", "」"), ("（", "）"))


def _inside(text: str, start: int, end: int) -> bool:
    """Whether a bracket or quotation that opened in the last 600 characters is still open."""
    part = text[max(start, end - 600) : end]
    if part.count('"') % 2:
        return True
    return any((n := part.count(a)) and n > part.count(b) for a, b in _PAIRS)


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, is a list or table line) of the stretches that no sentence crosses."""
    out = []
    at = 0
    for m in [*_BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        inner = at
        for line in _ITEM_LINE.finditer(text, at, end):
            if line.start() > inner:
                out.append((inner, line.start(), False))
            out.append((line.start(), line.end(), True))
            inner = line.end()
        if inner < end:
            out.append((inner, end, False))
        at = m.end() if m else end
    kept = []
    for a, b, item in out:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            kept.append((a, b, item))
    return kept


def candidates(text: str, start: int, end: int) -> list[Candidate]:
    """The candidates strictly inside a block."""
    out = []
    begin = start
    for m in _CANDIDATE.finditer(text, start, end):
        if m.end() < end and not (m.group("thai") is None and m.group("cite") == "" and text[m.end()].islower() and not _camel(text, m.end())):
            if not (text[m.end()].isdigit() and m.group() == "." and m.start() > start and text[m.start() - 1].isdigit()):  # a decimal
                out.append(Candidate(text, m, begin))
    return out


def _camel(text: str, at: int) -> bool:
    return any(c.isupper() for c in text[at + 1 : at + 3])


class Model:
    """The classifier: one weight a bucket."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def boundaries(self, cands: list[Candidate]) -> np.ndarray:
        if not cands:
            return np.zeros(0, dtype=bool)
        return self.weights[np.array([c.features for c in cands])].sum(axis=1) > 0

    def units(self, text: str) -> list[tuple[int, int]]:
        """The sentence units of a text, as (start, end), without surrounding blanks."""
        out = []
        for a, b, item in blocks(text):
            if not item:
                cands = candidates(text, a, b)
                for c, cut_here in zip(cands, self.boundaries(cands)):
                    if cut_here and a < c.end < b:
                        out.append((a, c.end))
                        a = c.begin
            if a < b:
                out.append((a, b))
        return out


def train(texts: list[str], epochs: int = 4) -> Model:
    """Fit the classifier on the reliable boundaries of ``texts``; no texts give one that cuts at every mark before a capital."""
    ends: list[Candidate] = []
    inner: list[Candidate] = []
    first = Counter()
    for text in texts:
        text = text[:TRAIN_CHARS]
        parts = [(a, b) for a, b, item in blocks(text) if not item]
        for k, (a, b) in enumerate(parts):
            found = list(_CANDIDATE.finditer(text, a, b))
            ended = bool(found) and found[-1].end() == b and found[-1].group("thai") is None and b < len(text)
            if not ended and not found:
                continue
            own = candidates(text, a, b)
            if ended or b == len(text) and len(own) > 0:
                first[_DIGITS.sub("9", _opening(text[a:b]).lower().rstrip(".,;:!?"))] += 1
            inner += own
            if ended:
                nxt = next((text[x:y] for x, y in parts[k + 1 :] if y - x > 60), text[parts[0][0] :])
                ends.append(Candidate(text, found[-1], a, nxt))
    ended_by = Counter(c.token for c in ends)
    pair = Counter((c.token, c.features[15]) for c in ends)
    seen = Counter(c.token for c in inner) + ended_by
    seen_pair = Counter((c.token, c.features[15]) for c in inner)
    seen_next = Counter(c.after for c in inner)
    rate = len(ends) / max(1, len(ends) + len(inner))
    rows, labels = [], []
    for c in ends:
        rows.append(c.features), labels.append(1.0)
    for c in inner:
        kind, sep, cited, marks = c.plain
        if kind == "thai" and not marks:
            label = 1.0
        elif kind == "lower" or kind == "sign" or kind == "end" and not cited:
            label = 0.0
        elif cited and kind != "lower":
            label = 1.0
        elif seen[c.token] >= NEVER and ended_by[c.token] == 0:
            label = 0.0
        elif seen_pair[c.token, c.features[15]] >= NEVER and pair[c.token, c.features[15]] == 0:
            label = 0.0
        elif seen_next[c.after] >= NEVER and first[c.after] == 0 and kind in ("upper", "hiragana", "deva", "arab"):
            label = 0.0
        elif ended_by[c.token] >= max(3, 0.4 * rate * seen[c.token]):
            label = 1.0
        else:
            continue
        rows.append(c.features), labels.append(label)
    return Model(_fit(np.array(rows, dtype=np.int64), np.array(labels), epochs))


def _opening(text: str) -> str:
    word = (text.split(None, 1) or [""])[0][:40]
    return word[:2] if word and _CJK.match(word) else word


def _fit(x: np.ndarray, y: np.ndarray, epochs: int) -> np.ndarray:
    """Logistic regression on active buckets, by AdaGrad over shuffled small batches."""
    w = np.zeros(BUCKETS)
    w[hash_of("k=upper")], w[hash_of("k=lower")], w[hash_of("g=thai")] = 0.5, -0.5, 2.0
    if not len(y):
        return w
    g2 = np.full(BUCKETS, 1e-2)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
            xb = x[part]
            p = 1 / (1 + np.exp(-w[xb].sum(axis=1)))
            grad = np.bincount(xb.ravel(), np.repeat(p - y[part], x.shape[1]), BUCKETS)
            hit = np.flatnonzero(grad)
            gh = grad[hit] / 16 + 1e-4 * w[hit]
            g2[hit] += gh * gh
            w[hit] -= 0.2 * gh / np.sqrt(g2[hit])
    return w


def training_texts(filings: DataFrame, answers: DataFrame) -> list[str]:
    """The bounded training sample: filings with the least hash, and answers with the least hash of each language."""
    hashed = filings.where("parsed_text is not null").select("parsed_text", F.xxhash64("parsed_text").alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(TRAIN_FILINGS).agg(F.max("h")).first()[0]  # hashes alone, so that no task sends texts it need not
    long = hashed.where(F.col("h") <= last).select("parsed_text").distinct() if last is not None else hashed.select("parsed_text").where("false")
    lang = F.lower(F.substring(F.coalesce("lang", F.lit("")), 1, 2)).alias("lang")
    given = answers.where("text is not null").select("text", lang).where("lang in ('en','de','fr','es','zh','ja','hi','ar','th')")
    hashes = given.select("lang", F.xxhash64("text").alias("h")).distinct().withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    most = hashes.where(F.col("n") <= TRAIN_ANSWERS_PER_LANG).groupBy("lang").agg(F.max("h").alias("most"))  # one row a language
    short = given.join(F.broadcast(most), "lang").where(F.xxhash64("text") <= F.col("most")).select("text").distinct()
    texts = [r[0] for r in long.select(F.substring("parsed_text", 1, TRAIN_CHARS)).collect()]
    return sorted(texts) + sorted(r[0] for r in short.select(F.substring("text", 1, TRAIN_CHARS)).collect())


def fitted(filings: DataFrame, answers: DataFrame) -> Model:
    """The classifier trained on the bounded sample of both tables."""
    return train(training_texts(filings, answers))


def sentence_units(texts: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """(keys..., sent_start, sent_end) of every sentence unit of every text.

    Offsets are code points, end exclusive, without surrounding blanks.  Null, empty and blank
    texts give no rows; equal texts under one key give their units once if the input is distinct.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model.weights)
    kept: dict = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if "m" not in kept:
            kept["m"] = Model(shared.value)
        for pdf in slices(batches, "__text", 2_000_000):
            units = [kept["m"].units(t) for t in pdf["__text"]]
            rows = np.repeat(np.arange(len(pdf)), [len(u) for u in units])
            flat = np.array([x for u in units for x in u], dtype=np.int32).reshape(-1, 2)
            yield pdf[keys].iloc[rows].assign(sent_start=flat[:, 0], sent_end=flat[:, 1])

    kinds = dict(texts.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", sent_start int, sent_end int"
    given = texts.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__text"))
    return spread(given).mapInPandas(run, schema)


def found_units(filings: DataFrame, answers: DataFrame) -> DataFrame:
    """(source_table, row_key, sent_start, sent_end): the units of filings.parsed_text and answers.text, each distinct unit of a key once.

    Repeated rows are segmented again rather than found by a shuffle of whole texts; their units come out once.
    """
    both = filings.select(F.lit("filings").alias("source_table"), F.col("accession_no").alias("row_key"), F.col("parsed_text").alias("text")).unionByName(
        answers.select(F.lit("answers").alias("source_table"), F.col("answer_id").cast("string").alias("row_key"), "text")
    )
    return sentence_units(both, fitted(filings, answers), ["source_table", "row_key"]).distinct()
