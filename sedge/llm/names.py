"""Variant spellings of names typed by people (problem 4).

1. Names are folded (width, case, accents, marks) and split into tokens; distinct names only, so
   equal names on many records are worked on once.
2. Tokens that stand beside several different others, and beside more of them than another token of
   most names they are in (first names, lines of business), are common, the rest is rare: each rare token
   (a family name, the proper part of a firm's name) decides which records are compared.  Where all
   tokens are common, the one beside the fewest others does.
3. Rare tokens that differ by a typing error are found by a set-similarity join on their positional
   q-grams: an error changes at most ``q + 1`` grams, so similar tokens share one of the ``q + 2`` rarest
   (prefix filter); the join is verified by edit distance with transpositions.
4. Short forms of given names (nicknames) are learned from the table itself: a token that stands before
   a rare family name mostly where one certain other, more frequent token does too, far more often than by chance, is
   a form of that one.
5. Names below one rare token (with its misspellings) are verified by soft weighted similarity: tokens that
   are equal, misspelt, shortened, joined or initials match to a degree, a token counts the more the fewer others it
   stands beside, tokens on both sides without a match contradict, and a name too short to decide is linked
   only if one candidate is left.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.operators.components import components
from sedge.operators.skew import salted_join
from sedge.session import cut, spread

Q = 3
#: A token that stands beside fewer different tokens is never common.
COMPANIONS = 4
#: Least similarity of the tokens beside a shared rare one, and how much tokens count that match but for an error, as a shortening, or as an initial.
SOFT, TYPO, SHORT, INITIAL = 0.6, 0.9, 0.8, 0.7
#: A nickname needs so many families with both forms, so large a share of its own families, and so many times as many as by chance.
NICK_FAMILIES, NICK_SHARE, NICK_LIFT = 3, 0.5, 3.0

# fixed values: titles, credentials, legal forms, filler words
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "hon", "sir", "officer", "director", "chair", "president", "rev", "judge"}
CREDENTIALS = {"cpa", "phd", "md", "mba", "cfa", "esq", "jd", "jr", "sr", "ii", "iii", "iv"}
LEGAL = {
    "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "plc", "lp", "llp", "gmbh", "gesellschaft", "mbh", "ag", "sa", "nv", "bv", "holdings", "hldgs", "holding", "group",
}
FILLER = {"the", "of", "and"}
_FORMERLY = re.compile(r"\((?:formerly|fka|f/k/a|previously)[^)]*\)?")


def fold(name: str) -> str:
    """Lower case without accents, width variants, doubled blanks."""
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", name))
    return " ".join("".join(c for c in s if not unicodedata.combining(c)).casefold().split())


def person_tokens(name: str) -> tuple[str, list[str]]:
    """(family name, given names in order) of a folded name; titles and credentials are left out."""
    s = re.sub(r"ph\.\s?d\.?", "phd", name)
    parts = [[t for t in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", p) if t not in CREDENTIALS and t not in TITLES] for p in s.split(",")]
    parts = [p for p in parts if p]
    if not parts:
        return "", []
    if len(parts) > 1:
        return parts[0][-1], parts[1]
    return parts[0][-1], parts[0][:-1]


def firm_tokens(name: str) -> list[str]:
    """Tokens of a firm's folded name in order, without legal forms and filler words unless nothing else is there."""
    s = _FORMERLY.sub(" ", name).replace("l.l.c", "llc").replace("'", "").replace("’", "").replace(" & ", " and ")
    tokens = re.findall(r"[^\W_]+", s)
    kept = [t for t in tokens if t not in LEGAL and t not in FILLER]
    return kept or tokens


def typo(a: str, b: str, most: int = 1) -> bool:
    """Whether the words differ by at most ``most`` insertions, deletions, changes or swaps of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most or min(len(a), len(b)) < 3:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    a, b = a[p:], b[p:]
    if most == 0:
        return a == b
    n = most - 1
    return (
        (bool(a) and _rest(a[1:], b, n)) or (bool(b) and _rest(a, b[1:], n)) or (bool(a and b) and _rest(a[1:], b[1:], n)) or (len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0] and _rest(a[2:], b[2:], n))
    )


def _rest(a: str, b: str, n: int) -> bool:
    if n == 0 or a == b:
        return a == b
    return abs(len(a) - len(b)) <= n and (_rest(a[1:], b[1:], n - (a[:1] != b[:1])) if a and b else len(a) + len(b) <= n)


def shortened(a: str, b: str) -> bool:
    """Whether ``a`` shortens ``b``: same first letter, at least two letters, its letters stand in ``b`` in order."""
    if not 2 <= len(a) < len(b) or a[0] != b[0]:
        return False
    rest = iter(b)
    return all(c in rest for c in a)


class Common:
    """The common tokens, with lookup by spelling, by misspelling and by shortening."""

    def __init__(self, words: list[str]):
        self.words = set(words)
        self.near: dict[str, list[str]] = defaultdict(list)
        self.by_first: dict[str, list[str]] = defaultdict(list)
        for w in sorted(words):
            for key in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
                self.near[key].append(w)
            if len(w) > 4:
                self.by_first[w[:1]].append(w)

    def of(self, token: str, shorten: bool) -> str | None:
        if token in self.words and not shorten:
            return token
        if len(token) >= 4:
            near = sorted({w for key in (token, *(token[:k] + token[k + 1 :] for k in range(len(token)))) for w in self.near.get(key, ()) if len(w) >= 4 and w != token and typo(token, w)})
            if token not in self.words and near:
                return near[0]
        if shorten and len(token) <= 6:
            full = [w for w in self.by_first.get(token[:1], ()) if len(w) >= len(token) + 2 and shortened(token, w)]
            if len(full) == 1 or full and len({f[:4] for f in full}) == 1:
                return full[0]
        return token if token in self.words else None


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for form, person, name in zip(pdf["form"], pdf["person"], pdf["name"]):
            s = fold(name)
            if person:
                last, given = person_tokens(s)
                rows.append((form, person, [last, *given] if last else []))
            else:
                rows.append((form, person, firm_tokens(s)))
        yield pd.DataFrame(rows, columns=["form", "person", "tokens"])


def _keyed(shared):
    """Of every form each rare token with the other tokens, brought to their common spelling."""
    kept: dict = {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not kept:
            kept[True], kept[False] = (Common(sorted(words)) for words in shared.value)
        beside = shared.value[1]
        for pdf in batches:
            rows = []
            for form, person, tokens in zip(pdf["form"], pdf["person"], pdf["tokens"]):
                tokens = list(tokens)
                if not tokens:
                    continue
                common = kept[bool(person)]
                if person:
                    rest = [c if len(t) > 2 and (c := common.of(t, False)) else t for t in tokens[1:]]
                    rows.append((form, person, tokens[0], rest, None))
                else:
                    known = [common.of(t, True) for t in tokens]
                    rare = [k for k, w in enumerate(known) if w is None] or [min(range(len(known)), key=lambda k: (beside[known[k]], known[k]))]
                    spelled = [w or t for t, w in zip(tokens, known)]
                    for key in sorted({spelled[k]: k for k in reversed(rare)}.values()):
                        rest = spelled[:key] + spelled[key + 1 :]
                        rows.append((form, person, spelled[key], rest, [1 / (1 + log2(1 + beside.get(t, 1))) for t in rest]))
            yield pd.DataFrame(rows, columns=["form", "person", "rare", "rest", "weights"])

    return run


def similar_tokens(tokens: DataFrame) -> DataFrame:
    """(a, b), both directions: distinct values of column ``token`` that differ by one typing error, by a prefix-filtered q-gram join."""
    padded = F.concat(F.lit("##"), F.col("token"), F.lit("$$"))
    grams = tokens.where(F.length("token") >= 4).select("token", F.posexplode(F.transform(F.sequence(F.lit(1), F.length(padded) - (Q - 1)), lambda i: F.substring(padded, i, F.lit(Q)))).alias("at", "gram"))
    grams = cut(grams)
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("token").orderBy("often", "gram", "at")
    prefix = salted_join(grams, often, "gram").withColumn("n", F.row_number().over(order)).where(F.col("n") <= Q + 2).select("token", "at", "gram")
    # a gram is compared at its own place and one to either side, as one error moves it
    right = prefix.select(F.col("token").alias("b"), "gram", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)).alias("at"))
    pairs = prefix.withColumnRenamed("token", "a").join(right, ["gram", "at"]).where("a < b and abs(length(a) - length(b)) <= 1").select("a", "b").distinct()
    close = pairs.where(F.levenshtein("a", "b", 2) >= 0)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[typo(a, b) for a, b in zip(pdf["a"], pdf["b"])]]

    ok = close.mapInPandas(verify, "a string, b string")
    return cut(ok.unionByName(ok.select(F.col("b").alias("a"), F.col("a").alias("b"))))


def _families(keyed: DataFrame) -> DataFrame:
    """(rare, family): rare tokens with the most frequent spelling within two typing errors of it, by way of a token of the table.

    A misspelling, its true spelling, and that one's other misspellings; longer chains join different names.
    """
    counts = cut(keyed.groupBy("rare").agg(F.count(F.lit(1)).alias("n")))
    near = similar_tokens(counts.select(F.col("rare").alias("token")))
    best = counts.select(F.col("rare").alias("token"), F.struct((-F.col("n")).alias("n"), F.col("rare").alias("word")).alias("top"))
    for _ in range(2):
        over = near.join(best.select(F.col("token").alias("b"), "top"), "b").select(F.col("a").alias("token"), "top")
        best = best.unionByName(over).groupBy("token").agg(F.min("top").alias("top"))
    return best.select(F.col("token").alias("rare"), F.col("top.word").alias("family"))


def nicknames(given: DataFrame) -> DataFrame:
    """(token, full): short and other forms of given names, learned from rows (family, token) of the given names that stand with a family name.

    Of several candidates the one of most families in common is taken, and a form of a form is none.  Without evidence there are no rows.
    Every family counts, however many given names it has: the more, the likelier a name stands in it by chance.  As a form shares ``needed`` of its families
    with the full name, they meet in one of its ``n - needed + 1`` smallest (prefix filter); so large families are not paired name by name, and none is lost.
    """
    rows = cut(given.where("length(token) > 1").distinct())
    own = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= NICK_FAMILIES)
    size = rows.groupBy("family").agg(F.count(F.lit(1)).alias("given"))
    known = cut(salted_join(salted_join(rows, own, "token"), size, "family"))
    needed = F.greatest(F.lit(NICK_FAMILIES), F.ceil(NICK_SHARE * F.col("n")))
    prefix = known.withColumn("at", F.row_number().over(Window.partitionBy("token").orderBy("given", "family"))).where(F.col("at") <= F.col("n") - needed + 1)
    met = prefix.select("family", F.col("token").alias("a"), F.col("n").alias("na")).join(known.select("family", F.col("token").alias("b"), F.col("n").alias("nb")), "family")
    pairs = met.where("nb > na").select("a", "b", "na", "nb").distinct()
    beside = pairs.join(known.select(F.col("token").alias("a"), "family", "given"), "a").join(known.select(F.col("token").alias("b"), "family", F.lit(1).alias("held")), ["b", "family"], "left")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    chance = 1 - F.exp(-F.col("nb") * (F.col("given") - 1) / F.col("total"))  # that a name of nb families is beside another one in this one
    scored = beside.join(F.broadcast(total)).groupBy("a", "b", "na").agg(F.count("held").alias("both"), F.sum(chance).alias("chance"))
    good = scored.where((F.col("both") >= NICK_FAMILIES) & (F.col("both") >= NICK_SHARE * F.col("na")) & (F.col("both") >= NICK_LIFT * F.col("chance")))
    best = cut(good.groupBy(F.col("a").alias("token")).agg(F.max_by("b", F.struct("both", "b")).alias("full")))
    return best.join(best.select(F.col("token").alias("full")), "full", "left_anti").select("token", "full")


class Spellings:
    """Words with lookup of those that differ by one typing error."""

    def __init__(self) -> None:
        self.of: dict[str, list[str]] = defaultdict(list)

    @staticmethod
    def _keys(word: str) -> set[str]:
        return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}

    def add(self, word: str) -> None:
        for key in self._keys(word):
            self.of[key].append(word)

    def near(self, word: str) -> str | None:
        """The first word added that equals ``word`` but for one error."""
        found = [w for key in sorted(self._keys(word)) for w in self.of.get(key, ()) if typo(w, word)]
        return found[0] if found else None


def _persons(rows: list[tuple]) -> dict[int, int]:
    """form -> entity (a form of it) for the forms of one family name and one initial: (form, rare, given names)."""
    out = {form: form for form, *_ in rows}
    full = defaultdict(list)
    for f, _, rest in rows:
        if len(rest[0]) > 1:
            full[rest[0]].append((f, rest[0], [r[0] for r in rest[1:2]]))
    heads, groups = Spellings(), {}
    for first in sorted(full, key=lambda s: (-len(full[s]), s)):
        owner = heads.near(first)
        if owner is None:
            heads.add(first)
            groups[first] = list(full[first])
        else:
            groups[owner].extend(full[first])
    people: list[tuple[str, set, list]] = []  # first name, middle initials, forms
    for first, members in groups.items():
        middles = sorted({m[0] for _, _, m in members if m})
        own = [(first, {m}, [f for f, _, x in members if x == [m]]) for m in middles] or [(first, set(), [])]
        plain = [f for f, _, x in members if not x]
        if len(own) == 1:
            own[0][2].extend(plain)
        elif plain:
            own.append((first, set(), plain))
        people += own
    by_middle = defaultdict(list)
    for p in people:
        for m in p[1] or {""}:
            by_middle[m].append(p)
    solo: list[tuple[int, str]] = []
    for f, _, rest in rows:
        if len(rest[0]) == 1:
            middle = rest[1][0] if len(rest) > 1 else ""
            fits = by_middle[middle] or by_middle[""] if middle else people
            if len(fits) == 1:
                fits[0][2].append(f)
            elif not fits:
                solo.append((f, middle))
    middles = sorted({m for _, m in solo if m})
    if solo:
        for m in middles if len(middles) > 1 else [None]:
            people.append((rows[0][2][0][0], {m} if m else set(), [f for f, x in solo if m is None or x == m]))
    for _, _, forms in people:
        for f in forms:
            out[f] = min(forms)
    return out


def _sim(a: str, b: str) -> float:
    """How far two tokens say the same: equal, misspelt, shortened, initial, or not at all."""
    if a == b:
        return 1.0
    if typo(a, b):
        return TYPO
    if shortened(a, b) or shortened(b, a):
        return SHORT
    return INITIAL if min(len(a), len(b)) == 1 and a[0] == b[0] else 0.0


def soft(a: list[str], wa: list[float], b: list[str], wb: list[float]) -> float:
    """Soft weighted similarity of two lists of tokens, 0 to 1.

    Each token is matched to the most similar free one of the other list; a match counts the lesser weight by its degree, over half the
    sum of all weights.  Lists that are the same written together count as one misspelt token.  Tokens left on both sides contradict: 0.
    """
    if sorted(a) == sorted(b):
        return 1.0
    one, two = "".join(a), "".join(b)
    if typo(one, two, 2):
        return TYPO
    if min(len(a), len(b)) == 1 and (shortened(one, two) or shortened(two, one)):
        return SHORT
    pairs = sorted(((-_sim(x, y), i, j) for i, x in enumerate(a) for j, y in enumerate(b)))
    left, right, total = set(range(len(a))), set(range(len(b))), 0.0
    for s, i, j in pairs:
        if s < 0 and i in left and j in right:
            left.discard(i), right.discard(j)
            total -= s * min(wa[i], wb[j])
    if left and right:
        return 0.0
    return 2 * total / (sum(wa) + sum(wb))


def _firms(rows: list[tuple]) -> dict[int, int]:
    """form -> entity for the firms of one proper name: (form, rare, other tokens, their weights, is an entry)."""
    out = {form: form for form, *_ in rows}
    counts: dict[tuple, int] = defaultdict(int)
    weight: dict[tuple, list[float]] = {}
    for _, _, rest, weights, entry in rows:
        if rest:
            counts[tuple(rest)] += 1 + 1000 * bool(entry)
            weight[tuple(rest)] = weights
    lines: list[tuple[tuple, list]] = []
    where: dict[tuple, list] = {}
    for rest in sorted(counts, key=lambda r: (-counts[r], -len("".join(r)), r)):
        owner = next((m for head, m in lines if soft(list(head), weight[head], list(rest), weight[rest]) >= SOFT), None)
        if owner is None:
            owner = []
            lines.append((rest, owner))
        where[rest] = owner
    for f, _, rest, _, _ in rows:
        if rest:
            where[tuple(rest)].append(f)
    bare = [f for f, _, rest, _, _ in rows if not rest]
    entries = {f for f, *_, entry in rows if entry}
    held = [m for _, m in lines if entries & set(m)]
    if len(lines) == 1 or len(held) == 1:
        (held or [lines[0][1]])[0].extend(bare)
    elif not lines and bare:
        lines.append(((), bare))
    for _, forms in lines:
        for f in forms:
            out[f] = min(forms)
    return out


def _resolve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    if key[0]:
        entity = _persons([(f, r, list(x)) for f, r, x in zip(pdf["form"], pdf["rare"], pdf["rest"])])
    else:
        entity = _firms([(f, r, list(x), list(w), e) for f, r, x, w, e in zip(pdf["form"], pdf["rare"], pdf["rest"], pdf["weights"], pdf["entry"])])
    return pd.DataFrame({"form": list(entity), "entity": list(entity.values())})


def _common(parsed: DataFrame, beside: DataFrame) -> DataFrame:
    """(person, token, n): tokens beside ``n`` others, at least ``COMPANIONS``, and in most of their names not the one beside the fewest."""
    of = parsed.select("form", F.explode(F.array_distinct("tokens")).alias("token"), "person").select("form", F.struct("person", "token").alias("key"))
    counted = salted_join(of, beside.select(F.struct("person", "token").alias("key"), "n"), "key")
    rarest = counted.groupBy("form").agg(F.min("n").alias("fewest"))
    votes = counted.join(rarest, "form").groupBy("key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("names"), F.count_if(F.col("n") > F.col("fewest")).alias("above"))
    return votes.where((F.col("n") >= COMPANIONS) & (F.col("above") * 2 > F.col("names"))).select("key.person", "key.token", "n")


def linked_names(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """(node_id, is_entry, entity, links): every named record of both tables with its entity, a number that records share when they name the same one.

    ``links`` is the number of other records of the entity.  nodes: node_id, label, name; entries: entry_id, name.  Null and empty names, and names without
    a letter or digit, give no rows; repeated rows count once; equal names always share an entity.
    """
    records = nodes.select(F.col("node_id").alias("id"), F.lit(False).alias("is_entry"), (F.col("label") == "Person").alias("person"), "name").unionByName(
        entries.select(F.col("entry_id").alias("id"), F.lit(True), F.lit(False), "name").toDF("id", "is_entry", "person", "name")
    )
    records = records.where("name is not null and person is not null and trim(name) <> ''").distinct()
    forms = cut(records.groupBy("person", "name").agg(F.max("is_entry").alias("entry")).withColumn("form", F.monotonically_increasing_id()))
    parsed = cut(spread(forms.select("form", "person", "name")).mapInPandas(_parse, "form long, person boolean, tokens array<string>"))
    beside = (
        parsed.select("person", "tokens", F.explode("tokens").alias("token"))
        .select("person", "token", F.explode("tokens").alias("other"))
        .where("token <> other and length(token) > 1 and length(other) > 1")
        .groupBy("person", "token")
        .agg(F.count_distinct("other").alias("n"))
    )
    common = _common(parsed, cut(beside)).collect()
    shared = nodes.sparkSession.sparkContext.broadcast([{r.token: r.n for r in common if r.person == p} for p in (True, False)])
    keyed = cut(spread(parsed).mapInPandas(_keyed(shared), "form long, person boolean, rare string, rest array<string>, weights array<double>"))
    family = cut(_families(keyed))
    grouped = cut(salted_join(keyed, family, "rare").join(forms.select("form", "entry"), "form"))
    first = F.element_at("rest", 1)
    named = grouped.where("person and size(rest) > 0")
    nick = nicknames(named.select("family", first.alias("token")))
    full = named.withColumn("token", first).join(nick, "token", "left").withColumn("rest", F.concat(F.array(F.coalesce("full", "token")), F.slice("rest", 2, F.size("rest")))).drop("token", "full")
    # an initial bears on the people of that initial only, so a family is split by it
    full = full.withColumn("part", F.substring(F.element_at("rest", 1), 1, 1))
    whole = full.unionByName(grouped.where("not person").withColumn("part", F.lit("")))
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    whole = whole.repartition(4 * cores, "person", "family", "part")  # a number of its own, as few bytes are much work here
    entity = cut(whole.groupBy("person", "family", "part").applyInPandas(_resolve, "form long, entity long"))
    # a family name alone is linked if one person has it, or nobody but such names
    bare = grouped.where("person and size(rest) = 0").select("form", "family")
    people = full.select("form", "family").join(entity, "form").groupBy("family").agg(F.min("entity").alias("least"), F.max("entity").alias("most"))
    least = bare.groupBy("family").agg(F.min("form").alias("bare"))
    alone = salted_join(bare, least.join(people, "family", "left"), "family")
    alone = alone.select("form", F.when(F.col("least").isNull(), F.col("bare")).when(F.col("least") == F.col("most"), F.col("least")).otherwise(F.col("form")).alias("entity"))
    entity = cut(entity.unionByName(alone))
    whole = components(entity.select("form", F.col("entity").alias("other")), "form", "other").toDF("form", "entity")  # a form may have several rare tokens
    entity = cut(forms.select("form").join(entity.select("form").distinct(), "form").join(whole, "form", "left").select("form", F.coalesce("entity", "form").alias("entity")))
    of_form = forms.select("form", "person", "name").join(entity, "form").select(F.struct("person", "name").alias("key"), "entity")
    named = cut(salted_join(records.select("id", "is_entry", F.struct("person", "name").alias("key")), of_form, "key").select("id", "is_entry", "entity"))
    sizes = named.groupBy("entity").agg((F.count(F.lit(1)) - 1).alias("links"))
    return salted_join(named, sizes, "entity").select(F.col("id").alias("node_id"), "is_entry", "entity", "links")


def name_pairs(linked: DataFrame) -> DataFrame:
    """(id_a, id_b), a < b: two nodes of one entity; of an entity with an entry, only each entry with each node."""
    linked = cut(linked)
    one = linked.select("entity", F.col("node_id").alias("id_a"), F.col("is_entry").alias("entry_a"))
    with_entry = linked.where("is_entry").select("entity").distinct().withColumn("held", F.lit(True))
    nodes = linked.where("not is_entry").select("entity", F.col("node_id").alias("id_b"))
    free = salted_join(one.where("not entry_a"), with_entry, "entity", "left").where("held is null").select("entity", "id_a")
    pairs = free.join(nodes, "entity").where("id_a < id_b").select("id_a", "id_b")
    held = salted_join(nodes, one.where("entry_a").select("entity", "id_a"), "entity").select("id_a", "id_b")
    return pairs.unionByName(held).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
