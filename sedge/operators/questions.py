"""Question filter, routing and the guard of generated graph queries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.text import match_key, ngrams

# fixed values: words of the query language that write, call out or administer, and are refused
DENIED = ("terminate", "show", "use", "create", "insert", "merge", "set", "delete", "remove", "drop", "foreach", "detach")
ORDINALS = {"first": "1", "second": "2", "third": "3", "fourth": "4"}
_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`[^`]*`|\d+(?:\.\d+)?|\w+|<-|->|[^\s\w]", re.S)
_QUARTER = r"(?:q([1-4])|(first|second|third|fourth) quarter)"


def _quarters(text: Column, pattern: str, quarter: tuple[int, int], year: int) -> Column:
    """``FY2024-Q2`` of every match; the quarter is a digit in one group of the pattern or a word in another."""
    words = F.create_map(*[F.lit(x) for kv in ORDINALS.items() for x in kv])

    def one(m: Column) -> Column:
        digit = F.regexp_extract(m, pattern, quarter[0])
        return F.concat(F.lit("FY"), F.regexp_extract(m, pattern, year), F.lit("-Q"), F.when(digit != "", digit).otherwise(F.try_element_at(words, F.regexp_extract(m, pattern, quarter[1]))))

    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)))


def phrases(questions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words, t, fiscal, calendar, years, forms, latest): what each question says of periods and forms.

    Quarter phrases are read first and blanked, so that their years are not read again: fiscal ones (``FY2024-Q2``, ``Q2 of fiscal 2024``, ``second quarter of
    fiscal year 2024``), then calendar ones (``Q2 2024``).  A range or list of years sets no years.  ``latest`` are the forms of which the newest is asked for.
    """
    q = questions.where(F.col(text).isNotNull()).select(key, F.col(text).alias("__text")).distinct()
    low = F.lower("__text")
    named, spoken, plain = r"fy ?([0-9]{4})[- ]*q([1-4])", rf"{_QUARTER} (?:of )?(?:fy|fiscal(?: year)?) ?([0-9]{{4}})", rf"{_QUARTER} (?:of )?([0-9]{{4}})"
    q = q.select(key, F.col("__text"), low.alias("__a")).withColumn("__b", F.regexp_replace("__a", named, " ")).withColumn("__c", F.regexp_replace("__b", spoken, " ")).withColumn("__d", F.regexp_replace("__c", plain, " "))
    direct = F.transform(F.regexp_extract_all("__a", F.lit(named), F.lit(0)), lambda m: F.concat(F.lit("FY"), F.regexp_extract(m, named, 1), F.lit("-Q"), F.regexp_extract(m, named, 2)))
    years = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("__d", F.lit(r"(?:fy|fiscal(?: years?)?) ?([0-9]{4})"), F.lit(1)), lambda y: F.concat(F.lit("FY"), y))))
    listed = F.col("__d").rlike(r"(?:fy|fiscal(?: years?)?) ?[0-9]{4} ?(?:,|to|through|and|[-\u2013]) ?(?:fy|fiscal(?: years?)?)? ?[0-9]{4}")
    forms = lambda lead: F.array_compact(F.array(F.when(F.col("__a").rlike(lead + r"(?:10-?k\b|annual report)"), F.lit("10-K")), F.when(F.col("__a").rlike(lead + r"(?:10-?q\b|quarterly report)"), F.lit("10-Q"))))
    return q.select(
        key, F.array_distinct(F.regexp_extract_all("__text", F.lit(r"\b([A-Z]{2,5})\b"), F.lit(1))).alias("words"), F.col("__text").alias("t"),
        F.array_sort(F.array_union(direct, _quarters(F.col("__b"), spoken, (1, 2), 3))).alias("fiscal"), _quarters(F.col("__c"), plain, (1, 2), 3).alias("calendar"),
        F.when(listed, F.array().cast("array<string>")).otherwise(years).alias("years"), forms("").alias("forms"), forms(r"(?:latest|newest|most recent) ").alias("latest"),
    )


def named_companies(said: DataFrame, companies: DataFrame, key: str) -> DataFrame:
    """(key, ticker): the companies a question names, by ticker or by a run of words that is a company's name without legal forms.

    companies: ticker, name.  Runs are of as many words as names have, and met by an equi-join.
    """
    names = companies.select("ticker", match_key(F.col("name")).alias("run")).where("run <> ''").distinct()
    longest = names.agg(F.max(F.size(F.split("run", " ")))).first()[0] or 0
    words = match_key(F.col("t"))
    runs = [said.select(key, F.explode(ngrams(words, n)).alias("run")) for n in range(1, longest + 1)]
    by_ticker = said.select(key, F.explode("words").alias("ticker")).join(companies.select("ticker").distinct(), "ticker", "left_semi").select(key, "ticker")
    out = by_ticker
    for r in runs:
        out = out.unionByName(r.join(names, "run").select(key, "ticker"))
    return out.distinct()


def question_filters(questions: DataFrame, filings: DataFrame, key: str, text: str, companies: DataFrame | None = None) -> DataFrame:
    """(key, accessions): the filings that each question's companies, fiscal and calendar quarters, years and forms select, sorted; null where there is no filter.

    filings: ticker, accession_no, form_type, fiscal_period, report_date; companies: ticker, name.  No company named means all.  Calendar quarters hold for companies whose
    annual reports end in December.  Of each company the filings of any period named (or the newest of a form, if the latest is asked for) count, of the forms named; where
    that is none, and where a fourth quarter is asked for (which has no report of its own), all of the forms named.  A filter that selects everything or nothing is null.
    Questions that say the same share one signature, and only signatures are joined to filings, by ticker.
    """
    said = phrases(questions, key, text)
    names = named_companies(said, companies if companies is not None else filings.select("ticker", F.lit("").alias("name")), key).groupBy(key).agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))
    parts = ["fiscal", "calendar", "years", "forms", "latest"]
    signed = said.join(names, key, "left").withColumn("tickers", F.coalesce("tickers", F.array().cast("array<string>")))
    signed = signed.select(key, *parts, "tickers", F.md5(F.to_json(F.struct(*parts, "tickers"))).alias("sign"))
    asking = F.size("fiscal") + F.size("calendar") + F.size("years") + F.size("forms") + F.size("latest") + F.size("tickers") > 0
    signs = signed.where(asking).select("sign", *parts, "tickers").dropDuplicates(["sign"])
    named = signs.where(F.size("tickers") > 0).withColumn("ticker", F.explode("tickers"))
    every = signs.where(F.size("tickers") == 0).crossJoin(filings.select("ticker").distinct())  # a signature that names no company asks for all of them
    own = named.unionByName(every.select(*named.columns)).drop("tickers")
    newest = filings.groupBy("ticker", "form_type").agg(F.max_by("accession_no", F.struct("report_date", "accession_no")).alias("newest"), F.max_by(F.month("report_date"), F.struct("report_date", "accession_no")).alias("ends"))
    december = newest.where("form_type = '10-K'").select("ticker", (F.col("ends") == 12).alias("december"))
    f = filings.join(newest.select("ticker", "form_type", "newest"), ["ticker", "form_type"]).join(december, "ticker", "left")
    rows = own.join(f, "ticker").where((F.size("forms") == 0) | F.array_contains("forms", F.col("form_type")))
    quarters = F.when(F.coalesce("december", F.lit(False)), F.array_union("fiscal", "calendar")).otherwise(F.col("fiscal"))
    fits = F.array_contains(quarters, F.col("fiscal_period")) | F.array_contains("years", F.split_part("fiscal_period", F.lit("-"), F.lit(1))) | (F.array_contains("latest", F.col("form_type")) & (F.col("accession_no") == F.col("newest")))
    fourth = F.exists(quarters, lambda x: x.endswith("-Q4"))
    rows = rows.withColumn("fits", F.coalesce(fits, F.lit(False)) & ~fourth).withColumn("any", F.max("fits").over(Window.partitionBy("sign", "ticker")))
    got = rows.where("fits or not any").groupBy("sign").agg(F.array_sort(F.collect_set("accession_no")).alias("accessions"))
    total = filings.agg(F.count_distinct("accession_no").alias("total"))  # one row
    out = questions.select(key).distinct().join(signed.select(key, "sign"), key, "left").join(got, "sign", "left").crossJoin(F.broadcast(total))
    chosen = F.when((F.size("accessions") > 0) & (F.size("accessions") < F.col("total")), F.col("accessions"))
    return out.groupBy(key).agg(F.max(chosen).alias("accessions"))


def route(questions: DataFrame, routes: DataFrame, key: str, cls: str) -> DataFrame:
    """(key, arm): the arm of each question's class; a class without one, and a null class, goes to ``vector``; declined classes to ``decline``."""
    return questions.select(key, F.col(cls).alias("__c")).distinct().join(F.broadcast(routes.select(F.col("class_name").alias("__c"), "arm")), "__c", "left").select(key, F.coalesce("arm", F.lit("vector")).alias("arm"))


def query_tokens(query: str) -> list[str]:
    """Tokens of a graph query, without comments; strings and quoted names are one token each."""
    return [t for t in _TOKEN.findall(query) if not t.startswith(("//", "/*"))]


def text_problem(tokens: list[str]) -> str | None:
    """The first rule of the text a query breaks: one statement, no word that writes, no CALL but of a subquery, a MATCH and a RETURN."""
    if not tokens:
        return "empty"
    if ";" in tokens[:-1]:
        return "several statements"
    words = []
    for before, t, after in zip(["", *tokens], tokens, [*tokens[1:], ""]):
        low = t.lower()
        is_name = before in (".", ":", "$") or (after == ":" and before in ("{", ","))
        if not re.fullmatch(r"[^\W\d]\w*", t) or is_name:
            continue
        if low in DENIED or (low == "load" and after.lower() == "csv"):
            return f"keyword {low}"
        if low == "call" and after not in ("{", "("):
            return "procedure call"
        words.append(low)
    return None if "return" in words and "match" in words else "no match or return"


def _element(tokens: list[str], k: int) -> tuple[str, str, int]:
    """(variable, name after the colon, index behind) of the node or edge element that the bracket at ``k`` opens."""
    close = {"(": ")", "[": "]"}[tokens[k]]
    depth, end = 1, k + 1
    while end < len(tokens) and depth:
        depth += (tokens[end] == tokens[k]) - (tokens[end] == close)
        end += 1
    inner = tokens[k + 1 : end - 1]
    variable = inner[0] if inner and re.fullmatch(r"[^\W\d]\w*", inner[0]) else ""
    name = next((inner[i + 1].strip("`") for i, t in enumerate(inner[:-1]) if t == ":" and i <= 1), "")
    return variable, name, end


def guard(query: str, labels: set[str], types: dict[str, tuple] | set[str]) -> str | None:
    """Why a generated query may not run, or null.

    After the rules of the text come those of the ontology: every label and edge type has to be known, and, where ``types`` gives the labels an edge may start
    and end at, the labels of both ends of a directed edge have to be among them (a variable keeps the label it was given first; unlabelled ends may be any).
    """
    tokens = query_tokens(query)
    bad = text_problem(tokens)
    if bad:
        return bad
    if any(tokens.count(a) != tokens.count(b) for a, b in ("()", "[]", "{}")):
        return "unbalanced brackets"
    label_of: dict[str, str] = {}
    last, k, edge, pointed = "", 0, None, ""
    while k < len(tokens):
        t = tokens[k]
        if t == "(" and not (k and re.fullmatch(r"\w+", tokens[k - 1]) and tokens[k - 1].lower() not in ("match", "where", "and", "or", "not", "exists", "optional")):
            variable, name, end = _element(tokens, k)
            if name and name not in labels:
                return f"unknown name {name}"
            name = name or label_of.get(variable, "")
            if variable:
                label_of.setdefault(variable, name)
            if edge and isinstance(types, dict) and edge in types:
                arrow = "->" if end and pointed == "->" else pointed
                start, stop = (last, name) if arrow == "->" else (name, last)
                if arrow in ("->", "<-") and ((start and start not in types[edge][0]) or (stop and stop not in types[edge][1])):
                    return f"direction of {edge}"
            last, edge, pointed = name, None, ""
            k = end
        elif t == "[" and k and tokens[k - 1] in ("-", "<-"):
            _, name, end = _element(tokens, k)
            if name and name not in types:
                return f"unknown name {name}"
            edge, pointed = name or None, "<-" if tokens[k - 1] == "<-" else (tokens[end] if end < len(tokens) else "")
            k = end
        else:
            if t in (",", ";") or re.fullmatch(r"(?i)match|where|return|with", t):
                last, edge = "", None
            k += 1
    return None


def bounded_result(rows: DataFrame, most: int = 1000, column: str = "chunk_ids") -> tuple[DataFrame, bool]:
    """(rows, truncated): a query's result under its contract: ``column`` has to be a list of strings, and at most ``most`` rows are kept (with one more asked for to tell)."""
    if dict(rows.dtypes).get(column) != "array<string>":
        raise ValueError(f"{column} has to be a list of strings")
    first = rows.limit(most + 1)
    return first.limit(most), first.count() > most
