"""Broken prompt and response pairs (problem 5).

A multi-label linear classifier on hashed n-grams of the reply and on features of the pair.  Its
training rows are made from a bounded sample of replies: complete sentence units cut off at random
places (truncated), questions given back in several ways (question_copy), blank and placeholder
replies (empty), replies swapped with those of another language, whole and in part (wrong_language), and replies that
the log itself marks as refused or declined, paired with other questions (refusal).  A language
classifier of the same kind, trained on the labelled questions and their replies, gives the languages of
the sentences.  Each label's threshold is calibrated on rows held out of the training.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.sentences import BUCKETS, Model, _inside, hash_of, train
from sedge.session import slices, spread

#: Distinct answers per language and kind of the training sample.
TRAIN_PER_LANG = 900
#: Sound answers expected per defective one of a kind, for the calibration.
SOUND_PER_DEFECT = 12
#: The threshold is, of those whose F1 is as good but for so much, the nearest to even odds.
SLACK = 0.01
LABELS = ("empty", "refusal", "question_copy", "truncated", "wrong_language")
LANGS = ("en", "de", "fr", "es", "zh", "ja", "hi", "ar", "th")
WIDTH = 96

# fixed values: names of the languages in questions that ask for one, and placeholders
ASKED = {
    "english": "en", "german": "de", "french": "fr", "spanish": "es", "chinese": "zh", "japanese": "ja", "hindi": "hi", "arabic": "ar", "thai": "th",
    "englisch": "en", "deutsch": "de", "französisch": "fr", "spanisch": "es", "anglais": "en", "allemand": "de", "français": "fr", "espagnol": "es", "inglés": "en", "alemán": "de", "francés": "fr", "español": "es",
}
PLACEHOLDERS = ("", " ", "\n", "\n\n", "...", "…", "-", "--", "—", ".", "?", "*", "[]", "{}", "()", "```\n```", "​", "﻿", "N/A", "n/a", "NA", "None", "none", "null", "NULL", "nil", "TBD", "[empty]", "(none)", '""', "|", "_", "•")

_STATUS = re.compile(r"\A\s*status\s*:[^\n]*(?:\n|\Z)", re.I)
_CITE = re.compile(r"\[[^\[\]\n]*\]")
_CITED = re.compile(r"\s*\[[^\[\]\n]*\]")
_NUM = re.compile(r"\d+")
_ASK = re.compile(r"\b(?:in|auf|en|in)\s+(" + "|".join(ASKED) + r")\b\W*\Z", re.I)
_WORD = re.compile(r"[^\W_]+")
_PART = re.compile(r"[^\W_]{1,15}")  # of scripts that set no blanks
_UNIT = re.compile(r"[^\W_\u0E00-\u0E7F\u3040-\u30FF\u3400-\u9FFF]+|[\u0E00-\u0E7F\u3040-\u30FF\u3400-\u9FFF]")


def body(raw: str) -> str:
    """A raw reply without its status line."""
    return _STATUS.sub("", raw, count=1)


def lang_code(lang: str | None) -> str | None:
    """One of LANGS, or null where the value names none of them."""
    code = (lang or "").strip().lower()[:2]
    return code if code in LANGS else None


class Linear:
    """Logistic regression over active buckets; bucket 0 stands for nothing."""

    def __init__(self, weights: np.ndarray | None = None, threshold: float = 0.0):
        self.weights = np.zeros(BUCKETS) if weights is None else weights
        self.threshold = threshold

    @staticmethod
    def rows(features: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(features), WIDTH), dtype=np.int64)
        for k, f in enumerate(features):
            h = [hash_of(s) or 1 for s in dict.fromkeys(f)][:WIDTH]
            x[k, : len(h)] = h
        return x

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.weights[x].sum(axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6) -> Linear:
        """Fit on most rows; calibrate the threshold on every fifth for the best F1 (but for SLACK) at the expected share of defects."""
        held = np.arange(len(y)) % 5 == 4
        self._descend(x, y, np.flatnonzero(~held), epochs)
        s, t = self.score(x[held]), y[held]
        if t.sum() and (1 - t).sum():
            weight = np.where(t > 0, 1.0, SOUND_PER_DEFECT * t.sum() / (1 - t).sum())
            order = np.argsort(-s)
            hits, wrong = np.cumsum(weight[order] * t[order]), np.cumsum(weight[order] * (1 - t[order]))
            f1 = 2 * hits / (hits + wrong + t.sum())
            good = np.flatnonzero(f1 >= f1.max() - SLACK)
            self.threshold = float(np.clip(0.0, s[order][min(good[-1] + 1, len(s) - 1)] + 1e-9, s[order][good[0]]))
        self._descend(x, y, np.arange(len(y)), 2)  # with the threshold known, the held-out rows are learned too
        return self

    def _descend(self, x: np.ndarray, y: np.ndarray, own: np.ndarray, epochs: int) -> None:
        w, g2, rng = self.weights, np.full(BUCKETS, 1e-2), np.random.default_rng(5)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
                xb = x[part]
                p = 1 / (1 + np.exp(-np.clip(w[xb].sum(axis=1), -30, 30)))
                grad = np.bincount(xb.ravel(), np.repeat(p - y[part], WIDTH), BUCKETS)
                grad[0] = 0
                hit = np.flatnonzero(grad)
                gh = grad[hit] / 8 + 2e-5 * w[hit]
                g2[hit] += gh * gh
                w[hit] -= 0.2 * gh / np.sqrt(g2[hit])


def language_features(sentence: str) -> list[str]:
    s = _NUM.sub("9", _CITE.sub("", sentence.lower()))[:240]
    words = _WORD.findall(s)[:24]
    f = ["b"] + [f"w{w}" for w in words if len(w) < 14 and w.isascii()] + [f"x{w[-3:]}" for w in words[:12]]
    odd = [c for c in s if ord(c) > 127]
    return f + [f"c{ord(c) >> 5}" for c in odd[:20]] + [f"o{c}" for c in odd[:20]]


class Languages:
    """One classifier a language; the best score names the language."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def fit(cls, sentences: list[str], langs: list[str]) -> Languages:
        x = Linear.rows([language_features(s) for s in sentences])
        y = np.array([LANGS.index(c) for c in langs], dtype=np.int64)
        return cls(np.stack([Linear().fit(x, (y == k).astype(float), 3).weights for k in range(len(LANGS))]))

    def of(self, sentences: list[str]) -> list[str]:
        x = Linear.rows([language_features(s) for s in sentences])
        return [LANGS[k] for k in np.stack([w[x].sum(axis=1) for w in self.weights]).argmax(axis=0)]


def _shape(s: str) -> str:
    return _NUM.sub(lambda m: "9" * min(3, len(m.group())), _CITED.sub("", s))


def end_features(unit: str) -> list[str]:
    """What the end of a reply's last unit tells about its being complete."""
    s = " ".join(_shape(unit).split())
    words = s.split()
    tail, low = s[-8:], [w.lower() for w in words[-4:]]
    item = unit.startswith(("- ", "|"))
    n = min(6, len(_NUM.findall(s)))
    inside = _inside(s, 0, len(s))
    head = " ".join(words[:2]).lower() if len(words) > 1 and s.isascii() else s[:4]
    return [
        "b", f"item{item}", *(f"e{k}{tail[-k:]}" for k in (1, 2, 3, 4, 6, 8)), f"1{low[-1:]}", f"2{low[-2:]}", f"3{low[-3:]}", f"n{n}|{tail[-3:]}", f"h{head}|{tail[-4:]}", f"h{head}|{low[-1:]}", f"hn{head}|{n}|{tail[-2:]}",
        f"in{inside}", f"in{inside}|{tail[-1:]}", f"i{item}|{low[-1:]}", f"i{item}|{tail[-3:]}", f"len{min(12, len(words))}|{tail[-1:]}",
    ]


def reply_features(reply: str) -> list[str]:
    """Word and character n-grams of a reply's beginning, and its length and form."""
    s = _NUM.sub("9", _CITE.sub("§", reply))
    words = [w.lower() if not k or w.islower() or not w.isascii() or len(w) == 1 else "N" for k, w in enumerate(_WORD.findall(s[:400]))]  # names say nothing here
    grams = [f"1{w}" for w in words[:22]] + [f"2{a} {b}" for a, b in zip(words[:20], words[1:])]
    flat = "".join(words)[:30] if not s.isascii() else ""
    grams += [f"4{flat[k : k + 3]}" for k in range(len(flat) - 2)]
    return ["b", f"cite{'§' in s}", f"len{min(9, len(s) // 60)}", *grams]


def windows(unit: str, words: int = 22, chars: int = 400) -> list[str]:
    """The unit, and if it is longer than ``reply_features`` sees, its later parts, each half over the one before."""
    if len(unit) <= 30:
        return [unit]
    at = [m.span() for m in (_WORD if unit.isascii() else _PART).finditer(unit)]
    starts, ends = [a for a, _ in at], [b for _, b in at]
    out, k = [unit], 0
    while k < len(ends):
        seen = k
        while seen < len(ends) and seen - k < words and ends[seen] - starts[k] <= chars and (unit.isascii() or ends[seen] - starts[k] <= 30 or seen == k):
            seen += 1
        if seen >= len(ends):
            break
        k += max(1, (seen - k) // 2)
        out.append(unit[starts[k] :])
    return out


def blank_features(reply: str) -> list[str]:
    letters = sum(c.isalnum() for c in reply)
    return ["b", f"n{min(8, letters)}", f"full{reply.strip().lower()}" if len(reply) < 16 else "long", f"size{min(6, len(reply.strip()) // 4)}"]


def _bag(s: str) -> list[str]:
    """Words, and single characters of scripts that set no blanks."""
    return _UNIT.findall(s.lower())


def copy_features(question: str, reply: str) -> list[str]:
    """How much of each side the other holds."""
    q, r = _bag(question), _bag(reply)
    qs, rs = set(q), set(r)
    out = sum(w not in qs for w in r) / len(r) if r else 1.0
    back = len(qs & rs) / len(qs) if qs else 0.0
    a, b = min(5, int(out * 20)), min(10, int(back * 10))
    return ["b", f"out{a}", f"back{b}", f"both{a}|{b}", f"len{min(5, len(r) // max(1, len(q)))}", f"none{not r}"]


def language_pair_features(want: str, told: list[str], asked: bool) -> list[str]:
    """How the languages of a reply's sentences go with the one that is wanted."""
    share = sum(c != want for c in told) / len(told) if told else 0.0
    first = told[0] != want if told else False
    other = len(set(told) - {want})
    return ["b", f"share{int(share * 10)}", f"most{share > 0.5}", f"n{min(4, len(told))}|{share > 0.5}", f"first{first}|{share > 0.5}", f"other{min(3, other)}", f"asked{asked}|{share > 0.5}"]


class Defects:
    """The trained parts; picklable."""

    def __init__(self, sentences: Model, languages: Languages, parts: dict[str, Linear]):
        self.sentences, self.languages, self.parts = sentences, languages, parts

    def language_pair(self, question: str, lang: str | None, units: list[str]) -> list[str] | None:
        """The features of a reply's languages; null where no language is wanted, or nothing is said."""
        asked = _ASK.search(question or "")
        want = ASKED[asked.group(1).lower()] if asked else lang_code(lang) or (self.languages.of([question])[0] if question else None)
        told = [u for u in units if sum(c.isalpha() for c in _CITE.sub("", u)) >= 4]
        return language_pair_features(want, self.languages.of(told), asked is not None) if want and told else None

    def wrong_language(self, question: str, lang: str | None, units: list[str]) -> bool:
        part, features = self.parts["wrong_language"], self.language_pair(question, lang, units)
        return features is not None and bool(part.score(Linear.rows([features]))[0] > part.threshold)

    def defects(self, pdf: pd.DataFrame) -> list[str | None]:
        """One defect or none for each row of question, lang, class_name, stop_reason, raw_text."""
        replies = [body(r or "") for r in pdf["raw_text"]]
        questions = [q or "" for q in pdf["question"]]
        units = [[r[a:b] for a, b in self.sentences.units(r)] for r in replies]
        x = {
            "empty": [blank_features(r) for r in replies],
            "question_copy": [copy_features(q, r) for q, r in zip(questions, replies)],
            "truncated": [end_features(u[-1] if u else "") for u in units],
        }
        is_ = {k: self.parts[k].score(Linear.rows(v)) > self.parts[k].threshold for k, v in x.items()}
        # a refusal may stand beside polite sentences, never beside a citation
        own = [[r, *(w for x in u for w in windows(x))] if not _CITE.search(r) and r.strip() else [] for u, r in zip(units, replies)]
        scores = iter(self.parts["refusal"].score(Linear.rows([reply_features(x) for u in own for x in u])))
        is_["refusal"] = [any([next(scores) > self.parts["refusal"].threshold for _ in u]) for u in own]
        out: list[str | None] = []
        for k, (cls, stop, lang) in enumerate(zip(pdf["class_name"], pdf["stop_reason"], pdf["lang"])):
            if stop == "refusal":
                out.append("refusal")
            elif is_["empty"][k] or not replies[k].strip():
                out.append("empty")
            elif is_["question_copy"][k]:
                out.append("question_copy")
            elif is_["refusal"][k] and cls not in ("decline", "unanswerable"):
                out.append("refusal")
            elif self.wrong_language(questions[k], lang, units[k]):
                out.append("wrong_language")
            elif is_["truncated"][k]:
                out.append("truncated")
            else:
                out.append(None)
        return out


def sample(answers: DataFrame) -> pd.DataFrame:
    """The bounded training sample: distinct answers of least hash, TRAIN_PER_LANG a language and kind (marked as refused or declined, or not)."""
    lang = F.lower(F.substring(F.coalesce(F.trim("lang"), F.lit("")), 1, 2))
    rows = answers.where("raw_text is not null and question is not null").select(lang.alias("code"), "question", "class_name", "status", "stop_reason", "refusal_category", "raw_text").distinct()
    marked = F.coalesce(F.col("status").isin("refused", "declined"), F.lit(False)) | F.col("refusal_category").isNotNull()
    rows = rows.withColumn("kind", F.when(~marked, 0).when(F.col("class_name") == "decline", 1).otherwise(2))
    rank = Window.partitionBy("code", "kind").orderBy(F.xxhash64("question", "raw_text"), "raw_text", "question")
    kept = rows.where(F.col("code").isin(*LANGS)).withColumn("n", F.row_number().over(rank)).where(F.col("n") <= TRAIN_PER_LANG)
    return kept.toPandas().sort_values(["code", "kind", "n"], ignore_index=True)


def fit(rows: pd.DataFrame) -> Defects:
    """Train on the sample; every random choice is seeded."""
    rng = np.random.default_rng(3)
    replies = [body(r) for r in rows["raw_text"]]
    sentences = train(replies + rows["question"].tolist())
    units = [[r[a:b] for a, b in sentences.units(r)] for r in replies]
    said = [(u, c) for us, c in zip(units, rows["code"]) for u in us[:6] if not u.startswith(("- ", "|"))] + list(zip(rows["question"], rows["code"]))
    languages = Languages.fit([s for s, _ in said], [c for _, c in said]) if said else Languages(np.zeros((len(LANGS), BUCKETS)))
    declined = rows["status"].isin(["refused", "declined"]) | (rows["stop_reason"] == "refusal") | rows["refusal_category"].notna()
    grounded = [bool(_CITE.search(r)) for r in replies]
    refusing = sorted({r for r, d in zip(replies, declined) if d and r.strip() and len(r) < 400 and not _CITE.search(r)})

    parts = {}
    x = [(blank_features(p), 1.0) for p in PLACEHOLDERS for _ in range(20)] + [(blank_features(r), 0.0) for r in replies if len(_WORD.findall(r)) > 1 or sum(map(str.isalnum, r)) > 8]
    parts["empty"] = _part(x, rng)
    plain = [u for us, g, d in zip(units, grounded, declined) if g and not d for u in us[:4]]
    plain += [r for r, t in zip(replies, rows["status"]) if t == "not_found"]
    plain += [r for r, g, d in zip(replies, grounded, declined) if g and not d]
    refused = [r[a:b] for r in refusing for a, b in sentences.units(r)] + refusing
    x = [(reply_features(r), 1.0) for r in refused for _ in range(max(1, len(plain) // max(1, 8 * len(refused))))] + [(reply_features(r), 0.0) for r in plain]
    parts["refusal"] = _part(x, rng)
    x = []
    for k, (q, r) in enumerate(zip(rows["question"], replies)):
        own = q.strip()
        x.append((copy_features(q, [own, f"Q: {own}", f"“{own}”", f"{own} {own}", own.rstrip(".?？؟") + " ??", own.upper()][k % 6]), 1.0))
        if grounded[k]:
            x.append((copy_features(q, r), 0.0))
        x += [(copy_features(q, f"{u}"), 0.0) for u in units[k][:1] if grounded[k]]
        x.append((copy_features(q, PLACEHOLDERS[k % len(PLACEHOLDERS)]), 0.0))
        if refusing:
            x.append((copy_features(q, refusing[k % len(refusing)]), 0.0))
    parts["question_copy"] = _part(x, rng)
    x = []
    # a last unit that several replies end in was not cut off at random
    last = Counter(us[-1] for us in units if us)
    often = [u for u, n in last.items() if n > 1 and len(u) > 12]
    whole = [u for u in often for _ in range(6)] + [u for us, d in zip(units, declined) for u in us[:-1] if len(u) > 12] + [r for r in refusing for _ in range(3)]
    for u in whole:
        x.append((end_features(u), 1.0))
        marks = [m.end() for m in re.finditer(r"[.!?。](?=.)", u[:-2])]
        cuts = {int(rng.integers(4, len(u) - 1)), int(rng.integers(max(4, len(u) // 2), len(u) - 1)), *([int(rng.choice(marks))] if marks and rng.random() < 0.5 else [])}
        x += [(end_features(u[:c].rstrip()), 0.0) for c in cuts if c >= 4]
    # here 1 is sound, so that unseen ends count as broken off
    parts["truncated"] = _part([(f, 1.0 - y) for f, y in x], rng)
    langs = rows["code"].tolist()
    by_lang = {c: [k for k, x in enumerate(langs) if x == c and units[k]] for c in dict.fromkeys(langs)}
    pairs = []
    for c, own in by_lang.items():
        others = [k for o, ks in by_lang.items() if o != c for k in ks]
        for n, k in enumerate(own):
            pairs.append((language_pair_features(c, [c] * len(units[k]), False), 0.0))
            if others:  # a reply swapped with one of another language; in part, less and more than half
                told = [langs[others[(7 * n + 3) % len(others)]]] * len(units[k])
                pairs.append((language_pair_features(c, told, n % 5 == 0), 1.0))
                m = max(1, len(told) // 2)
                mixed = [c] * m + told[:1] * m
                pairs.append((language_pair_features(c, mixed if n % 2 else mixed[::-1], n % 5 == 1), 0.0))
                mixed = [c] * m + told[:1] * (m + 1)
                pairs.append((language_pair_features(c, mixed if n % 2 else mixed[::-1], n % 5 == 1), 1.0))
    parts["wrong_language"] = _part(pairs, rng)
    return Defects(sentences, languages, parts)


def _part(rows: list[tuple[list[str], float]], rng: np.random.Generator) -> Linear:
    if not rows:
        return Linear(threshold=0.0)
    order = rng.permutation(len(rows))
    return Linear().fit(Linear.rows([rows[k][0] for k in order]), np.array([rows[k][1] for k in order]))


def defective(answers: DataFrame, model: Defects | None = None) -> DataFrame:
    """(answer_id, defect) of every defective answer, one defect each.

    Null questions count as empty ones, null replies as empty replies; an answer that occurs again counts once, and one id with several
    replies gets the defect of each.  An empty table gives no rows.
    """
    model = model or fit(sample(answers))
    shared = answers.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "raw_text", 1_000_000):
            yield pd.DataFrame({"answer_id": pdf["answer_id"], "defect": shared.value.defects(pdf)}).dropna()

    columns = ["answer_id", "question", "lang", "class_name", "stop_reason", F.coalesce("raw_text", F.lit("")).alias("raw_text")]
    return spread(answers.select(*columns)).mapInPandas(run, f"answer_id {dict(answers.dtypes)['answer_id']}, defect string").distinct()
