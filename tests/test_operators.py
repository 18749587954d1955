"""Operators on small fixtures: nulls, ties, repeats, empty tables, and algorithms against brute force."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from sedge.functions import text as T
from sedge.operators import communities as C
from sedge.operators import extraction as X
from sedge.operators import graph as G
from sedge.operators import html as H
from sedge.operators import linking as LK
from sedge.operators import metrics as M
from sedge.operators import orphans as O
from sedge.operators import questions as Q
from sedge.operators import ranking as R
from sedge.operators import store as S
from sedge.operators import vectors as V
from sedge.operators.components import components
from sedge.operators.skew import heavy_keys, salted_join
from sedge.plans import texts as P
from sedge.sources import cache as K
from sedge.sources import files as FI
from sedge.streaming import log as L

D = dt.datetime


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_salted_join_is_a_join(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(None if k % 50 == 0 else "hot" if k % 3 else f"k{rng.randrange(40)}", k) for k in range(900)], "key string, n int")
    right = spark.createDataFrame([(f"k{k}", k * 2) for k in range(30)] + [("hot", -1)], "key string, m int")
    assert ("hot",) in rows(heavy_keys(left, "key"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(salted_join(left, right, "key", how)) == rows(left.join(right, "key", how))
    assert salted_join(left.where("false"), right, "key").count() == 0


def test_orphans(spark):
    refs = [("a", D(2024, 1, 5)), (" a\t", D(2024, 1, 2)), ("b", D(2024, 2, 1)), ("gone", D(2024, 2, 1)), ("gone", D(2024, 2, 9)), (None, D(2024, 1, 1)), ("c", None), ("zz", None), ("", D(2024, 3, 1))]
    r = spark.createDataFrame([(*x, "x") for x in refs], "chunk_id string, at timestamp, ref_key string")
    t = spark.createDataFrame([("a", D(2024, 1, 3)), ("a", D(2024, 1, 9)), ("b", D(2024, 1, 1)), ("c", D(2024, 9, 1))], "chunk_id string, since timestamp")
    d = spark.createDataFrame([("gone",), ("gone",), ("b",), (None,)], "key_value string")
    got = O.orphan_references(r, "chunk_id", "at", t, "chunk_id", "since", d, "key_value")
    assert rows(got.select("ref_key", "ref_month", "kind", "n_refs")) == sorted([("a", "2024-01", "late", 2), ("gone", "2024-02", "deleted", 2), ("zz", None, "missing", 1), ("", "2024-03", "missing", 1)], key=str)
    assert O.orphan_references(r.where("false"), "chunk_id", "at", t, "chunk_id", "since", d, "key_value").count() == 0
    assert O.orphan_references(r, "chunk_id", "at", t.where("false"), "chunk_id", "since", d.where("false"), "key_value").where("kind <> 'missing'").count() == 0


def test_components_match_brute_force(spark):
    rng = random.Random(7)
    pairs = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(90)] + [(f"p{k:03d}", f"p{k + 1:03d}") for k in range(80)] + [(None, "x"), ("s", "s"), ("p001", "p000")]
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame(pairs, "a string, b string")
    assert dict(map(tuple, components(df, "a", "b").collect())) == {k: find(k) for k in root}
    assert components(df.where("false"), "a", "b").count() == 0


def test_top_k_matches_brute_force(spark):
    rng = random.Random(3)
    data = [(k, [rng.gauss(0, 1) for _ in range(8)], k % 3) for k in range(80)]
    data += [(100, data[5][1], 0), (101, None, 0), (102, [0.0] * 8, 0), (103, [float("nan")] * 8, 0)]
    df = spark.createDataFrame(data, "id long, vec array<double>, label int")
    got = {}
    for r in V.top_k(df, df.where("id % 20 = 0"), 4, "id", "vec").collect():
        got.setdefault(r.query, []).append((r.rank, r.id))
    import numpy as np

    ok = {k: np.array(v) / np.linalg.norm(v) for k, v, _ in data if v is not None and k not in (102, 103)}
    for q in (0, 20, 40, 60, 100):
        want = sorted(((-round(float(ok[q] @ v), 9), k) for k, v in ok.items() if k != q))[:4]
        assert [k for _, k in sorted(got[q])] == [k for _, k in want]
    faceted = V.top_k(df, df.where("id = 0"), 50, "id", "vec", "label").collect()
    assert {r.id for r in faceted} == {k for k, v, lab in data if lab == 0 and k in ok and k != 0}
    assert V.top_k(df.where("false"), df, 3, "id", "vec").count() == 0 and V.top_k(df, df.where("false"), 3, "id", "vec").count() == 0


def test_store(spark):
    f = spark.createDataFrame([("a", "héllo wörld", D(2024, 1, 1)), ("a", "héllo wörld", D(2024, 1, 2)), (None, "x", None)], "accession_no string, parsed_text string, loaded_at timestamp")
    c = spark.createDataFrame([("a:0", " a", 1, 5, 0, D(2024, 1, 1)), ("a:1", "a", -3, 99, 1, None), ("b:0", "b", 0, 1, 0, None), ("a:2", "a", 4, 2, 2, None)], "chunk_id string, accession_no string, char_start int, char_end int, ordinal int, chunked_at timestamp")
    assert {r.chunk_id: r.text for r in S.chunk_texts(c, f).collect()} == {"a:0": "éllo", "a:1": "héllo wörld", "a:2": ""}
    old, new = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string"), spark.createDataFrame([(2, "Y"), (3, "W")], "k int, v string")
    assert rows(S.upsert(old, new, ["k"])) == sorted([(1, "x"), (None, "z"), (2, "Y"), (3, "W")], key=str)


def test_asof_is_strict(spark):
    day = dt.date
    f = spark.createDataFrame(
        [("a", "1", "10-K", day(2020, 1, 1)), ("b", "1", "10-K", day(2021, 1, 1)), ("c", "1", "10-K", day(2021, 1, 1)), ("d", "1", "10-Q", day(2021, 1, 1)), ("e", "1", "10-Q", day(2021, 5, 1)), ("f", "2", "10-Q", day(2021, 5, 1))],
        "accession_no string, cik string, form_type string, report_date date",
    ).withColumns({"loaded_at": F.lit(1), "parsed_text": F.lit("")})
    assert rows(S.previous_annual(f)) == [("b", "a"), ("c", "a"), ("d", "a"), ("e", "c")]


def test_text_functions(spark):
    names = ["Groq, Inc.", "AT&T Corp.", "Inc", "The Company", None, "A.B. Holdings Ltd", "O'Neil Co"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(T.match_key(F.col("n"))).collect()]
    assert got == ["groq", "at and t", "inc", "the", None, "ab", "oneil"]
    one = spark.range(1)
    ask = one.select(
        T.escaped(F.lit("a:b|c%")), T.chunk_id(F.lit("x"), F.lit(7)), T.chunk_id(F.lit("x"), F.lit(12345)), T.accession_of(F.lit("a:b:c")), T.cited_ids(F.lit("x [a; b] y [b, c] []")), T.strip_citations(F.lit("x [a] y.")),
        T.status_of(F.lit("  status: Not_Found\nx")), T.status_of(F.lit("x")), T.unescape_markdown(F.lit(r"a\*b")), T.acronym(F.lit("securities and exchange")), T.snippet(F.lit("the Revenue rose"), "revenue", 4, 3), T.ngrams(F.lit("a b c"), 2), T.norm(F.lit("Ｇroß  X")),
    ).first()
    assert list(ask) == ["a%3Ab%7Cc%25", "x:0007", "x:12345", "a:b", ["a", "b", "c"], "x y.", "not_found", "no_status", "a*b", "sae", "the **Revenue** ro", ["a b", "b c"], "gross x"]
    assert T.ratio("", "") == 100 and round(T.ratio("abcd", "abxd"), 2) == 75 and T.token_set_ratio("a b", "b a c") == 100 and T.token_set_ratio("", "a") == 0
    said = "see the “big” one now, the “big” one"
    assert T.find_span('the  "big" one', said) == (4, 17) and T.find_span('the  "big" one', said, last=True) == (23, 36) and T.find_span("x", "") is None
    assert T.find_span("a*b ﬁn", r"x a\*b" + "\n\n fin") == (2, 12) and T.find_span("ig", said) == (10, 12) and T.find_span(" ", said) is None
    assert T.changed_number("cost $1,000.50 now") == "cost $1,500.75 now" and T.changed_number("none") is None


def test_keys_of_all_rows(spark, tmp_path):
    texts = ["Ｇroß  X:Y", "在庫は？", "Zürich AG", "plain Name", None]
    spark.createDataFrame([(k, "Organization", t) for k, t in enumerate(texts)], "node_id long, label string, name string").write.parquet(str(tmp_path / "resolve_nodes.parquet"))
    spark.createDataFrame([(t,) for t in texts + ["PLAIN  name"]], "question string").write.parquet(str(tmp_path / "answers.parquet"))
    assert rows(P.node_keys_all(spark, str(tmp_path))) == [(0, "Organization:gross x%3Ay"), (1, "Organization:在庫は?"), (2, "Organization:zürich ag"), (3, "Organization:plain name")]
    assert rows(P.question_keys_all(spark, str(tmp_path))) == sorted([("gross x:y",), ("在庫は?",), ("zürich ag",), ("plain name",)], key=str)


def test_fuzzy_names_in_any_order(spark, tmp_path):
    spark.createDataFrame([(1, "Organization", "Data Services Mugirosuck"), (2, "Organization", "Mugirosuck Data Services Inc."), (3, "Organization", "Other Firm"), (4, "Organization", None)], "node_id long, label string, name string").write.parquet(str(tmp_path / "resolve_nodes.parquet"))
    spark.createDataFrame([(9, "Mugirosuck Data Services"), (8, "Kupifizarn Test")], "entry_id long, name string").write.parquet(str(tmp_path / "filer_entries.parquet"))
    assert rows(P.name_ratios(spark, str(tmp_path))) == [(1, 9, 100.0), (2, 9, 100.0)]


def test_evidence_of_padded_chunk_ids(spark, tmp_path):
    spark.createDataFrame([("a", "see the big one", D(2024, 1, 1))], "accession_no string, parsed_text string, loaded_at timestamp").write.parquet(str(tmp_path / "filings.parquet"))
    spark.createDataFrame([("a:0", "a", 4, 15, 0, D(2024, 1, 1))], "chunk_id string, accession_no string, char_start int, char_end int, ordinal int, chunked_at timestamp").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([(1, "a:0", "big"), (2, " a:0\t", "one"), (3, "b", "x"), (4, "a:0", None)], "evidence_id long, chunk_id string, span string").write.parquet(str(tmp_path / "evidence.parquet"))
    assert rows(P.evidence_spans(spark, str(tmp_path))) == [(1, 4, 7), (2, 8, 11)]


def test_names_in_questions(spark):
    q = spark.createDataFrame([(1, "What did Vogekudx Capital report?"), (2, "How much does Freight Lines owe Vogekudux Capital?"), (3, None), (4, "Nothing here")], "question int, text string")
    n = spark.createDataFrame([("v", "Vogekudux Capital, Inc."), ("f", "Freight Lines"), ("x", None)], "key string, name string")
    got = {(r.question, r.key): round(r.score, 1) for r in LK.named_in(q, n).collect()}
    assert got == {(1, "v"): 97.0, (2, "f"): 100.0, (2, "v"): 100.0}
    assert LK.named_in(q, n.where("false")).count() == 0


def test_candidate_pairs_match_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    words = ["capital", "partners", "freight", "lines", "data", "services", "vogekudux", "vogekudx", "tamusuroth", "tamusurth", "mugirosuck", "kupifizarn", "of", "3m"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(160)]
    keys = sorted({r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(T.match_key(F.col("n"))).collect()})
    monkeypatch.setattr(LK, "BLOCK", 40)
    nodes = spark.createDataFrame([(n,) for n in names + [None, ""]], "name string")
    got = {(r.key_a, r.key_b) for r in LK.candidate_pairs(nodes, fuzzy=85).collect() if "fuzzy" in r.rules}
    assert got == {p for p in itertools.combinations(keys, 2) if T.token_set_ratio(*p) >= 85} and got
    two = spark.createDataFrame([("alpha one",), ("beta two",), ("gamma six",)], "name string")
    vectors = spark.createDataFrame([("alpha one", [1.0, 0.0]), ("beta two", [0.9, 0.1]), ("gamma six", [0.0, 1.0])], "k string, vec array<double>")
    assert rows(LK.candidate_pairs(two, vectors=vectors, top=1)) == [("alpha one", "beta two", "embedding"), ("beta two", "gamma six", "embedding")]
    assert LK.candidate_pairs(two.where("false"), fuzzy=85).count() == 0


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        assert T.lcs_length(a, b) == brute_lcs(a, b)


def test_metrics(spark):
    one = spark.range(1)
    low, high = M.wilson(F.lit(8), F.lit(10))
    got = one.select(F.round(low, 4), F.round(high, 4), M.wilson(F.lit(0), F.lit(0))[0], M.kappa(F.lit(5), F.lit(5), F.lit(5), F.lit(10)), M.kappa(F.lit(3), F.lit(3), F.lit(3), F.lit(3)), M.fisher(F.lit(0.5), F.lit(3))[0]).first()
    assert list(got) == [0.4902, 0.9433, None, 1.0, None, None]
    e = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "a"])], "r array<string>, g array<string>")
    assert list(e.select(M.recall_at(F.col("r"), F.col("g"), 2), M.precision_at(F.col("r"), F.col("g"), 5), M.recall_at(F.col("r"), F.array().cast("array<string>"), 2)).first()) == [0.5, 0.2, None]
    got = spark.createDataFrame([("q", "n", 1), ("q", "g", 2), ("q", "m", 3), ("q", "m", 9)], "query string, item string, rank int")
    gold, neg = spark.createDataFrame([("q", "g")], "query string, item string"), spark.createDataFrame([("q", "n"), ("q", "m"), ("q", "far")], "query string, item string")
    assert rows(M.wrong_evidence(got, gold, neg)) == [("q", "n")]
    assert rows(M.wrong_evidence(got, gold.unionByName(spark.createDataFrame([("q", "lost")], "query string, item string")), neg)) == [("q", "m"), ("q", "n")]
    flat = spark.createDataFrame([("a", 1.0, k) for k in range(5)] + [("b", 1.0, 1)], "g string, x double, y int")
    assert rows(M.spearman(flat, ["g"], "x", "y").select("g", "n", "rho")) == [("a", 5, None), ("b", 1, None)]


def test_budgets_against_loops(spark):
    rng = random.Random(2)
    data = [(g, k, rng.randrange(1, 60)) for g in range(12) for k in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(data, "g int, k int, s int")
    prefix, skip = set(), set()
    for g in range(12):
        used, over, taken = 0, False, 0
        for _, k, s in sorted(x for x in data if x[0] == g):
            used += s
            over = over or used > 70
            if not over or k == 0:
                prefix.add((g, k, s))
            if k == 0 or taken + s <= 70:
                skip.add((g, k))
                taken += s
    assert set(map(tuple, R.budget_prefix(df, "g", ["k"], "s", 70).collect())) == prefix
    assert set(map(tuple, R.budget_skip(df, "g", "k", ["k"], "s", 70).collect())) == skip
    q = R.quotas(spark.createDataFrame([("a", 90), ("b", 9), ("c", 1), ("d", 0)], "n string, c long"), "n", "c", 10)
    assert dict(map(tuple, q.collect())) == {"a": 8, "b": 1, "c": 1}


def test_packing(spark):
    units = spark.createDataFrame([("d", k * 10, k * 10 + 9, t) for k, t in enumerate([60, 60, 30, 10, 200, 20, 20])], "doc string, start int, end int, tokens long")
    got = [tuple(r) for r in R.packed(units, "doc", "start", "end", "tokens", 150, 20).orderBy("ordinal").collect()]
    assert [(r[2], r[3], r[4]) for r in got] == [(0, 29, 150), (30, 39, 10), (40, 49, 200), (50, 69, 40)]


def test_graph(spark):
    e = G.undirected(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "x string, y string"), "x", "y")
    got = G.expand(spark.createDataFrame([("a",)], "anchor string"), e, 2)
    assert rows(got) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]
    spans = spark.createDataFrame([("f", "1", 0, 10), ("f", "2", 5, 8), ("f", "3", 9, 20), ("g", "4", 0, 5)], "f string, k string, lo int, hi int")
    assert rows(G.overlapping(spans, "f", "k", "lo", "hi")) == [("2", 3), ("3", 1)]
    ev = spark.createDataFrame([(1, "L", "L:1", "c", "s", "Stated", 1), (2, "L", "L:1", " c", "t", "stated", 2), (3, "L", "L:1", "c", "u", "odd", 3), (4, "L", None, None, None, None, 4)], "evidence_id long, label string, node_key string, chunk_id string, span string, confidence string, extracted_at int")
    assert [tuple(r) for r in G.best_evidence(ev).collect()] == [("L:1", "c", "L", "t", "stated", 3)]


def test_smallest_cut_matches_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        keys = "abcdef"
        pairs = list(itertools.combinations(keys, 2))
        same = rng.sample(pairs, 6)
        against = [p for p in rng.sample(pairs, 3) if p not in same]
        n, parts, ways, tied = C.smallest_cut(same, against)
        where = dict(parts)
        lost = sum(where[a] != where[b] for a, b in same)  # several smallest cuts: their common refinement
        assert all(where[a] != where[b] for a, b in against) and (lost == n if ways == 1 else lost >= n) and (ways > 1 or not tied)

        def apart(gone):
            near = {k: {k} for k in keys}
            for a, b in same:
                if (a, b) not in gone:
                    both = near[a] | near[b]
                    for k in both:
                        near[k] = both
            return all(b not in near[a] for a, b in against)

        assert n == min(size for size in range(7) if any(apart(g) for g in itertools.combinations(same, size)))


def test_extraction(spark):
    reply = '{"nodes":[{"id":"1","label":"Product","name":"X","evidence_span":"X sold","confidence":"stated"},{"id":"2","label":"Nope","name":"Y","evidence_span":"X","confidence":"stated"},{"id":"3","label":"MetricValue","name":"M","value":true,"evidence_span":"sold","confidence":"Implied"},{"id":"4","label":"Segment","name":"S","evidence_span":"absent","confidence":"stated"},{"id":"5","label":"Segment","name":"S","evidence_span":"X","confidence":"stated"}],"triples":[{"start":"5","type":"NEAR","end":"1","evidence_span":"X","confidence":"stated"},{"start":"1","type":"NEAR","end":"2","evidence_span":"X","confidence":"stated"},{"start":"1","type":"ODD","end":"5","evidence_span":"X","confidence":"stated"}]}'
    r = X.parsed(spark.createDataFrame([("c", "X sold well", reply), ("d", "t", "not json"), ("e", "t", None)], "chunk_id string, text string, reply string"))
    n = X.checked_nodes(r, ["Product", "Segment", "MetricValue"])
    assert [x.reason for x in n.orderBy("pos").collect()] == [None, "label", "value", "span", None]
    allowed = spark.createDataFrame([("Segment", "NEAR", "Product")], "start_label string, type string, end_label string")
    t = X.checked_triples(r, n, allowed, ["NEAR"]).orderBy("pos").collect()
    assert [(x.start, x.end, x.reason) for x in t] == [("1", "5", None), ("1", "2", "endpoint"), ("1", "5", "type")]


def test_question_filters(spark):
    day = dt.date
    f = spark.createDataFrame(
        [("a1", "10-K", "FY2023", day(2023, 12, 31), "ABCD"), ("a2", "10-Q", "FY2024-Q1", day(2024, 3, 31), "ABCD"), ("b1", "10-K", "FY2023", day(2023, 12, 31), "WXYZ"), ("b2", "10-Q", "FY2024-Q2", day(2024, 6, 30), "WXYZ")],
        "accession_no string, form_type string, fiscal_period string, report_date date, ticker string",
    )
    ask = {"one": "What did ABCD report in Q1 2024?", "all": "What was reported?", "year": "Compare fiscal 2023 for WXYZ", "latest": "Latest 10-K of ABCD and WXYZ", "lost": "ABCD in FY1999", "list": "ABCD in Q1 2024 and Q2 2024", "q": "reports of FY2024 Q2"}
    got = {r.k: r.accessions for r in Q.question_filters(spark.createDataFrame(list(ask.items()), "k string, q string"), f, "k", "q").collect()}
    assert got == {"one": ["a2"], "all": None, "year": ["b1"], "latest": ["a1", "b1"], "lost": ["a1", "a2"], "list": ["a2"], "q": ["a1", "a2", "b2"]}
    firms = spark.createDataFrame([("ABCD", "Abacus Data Inc."), ("WXYZ", "Wexford, LLC")], "ticker string, name string")
    ask = {"name": "How did Abacus Data do in the second quarter of 2024?", "both": "Wexford and ABCD in fiscal 2023", "range": "WXYZ from fiscal 2023 to fiscal 2025", "q4": "Wexford in Q4 of fiscal 2023", "form": "quarterly report of Wexford", "spoken": "second quarter of fiscal year 2024 at Wexford"}
    got = {r.k: r.accessions for r in Q.question_filters(spark.createDataFrame(list(ask.items()), "k string, q string"), f, "k", "q", firms).collect()}
    assert got == {"name": ["a1", "a2"], "both": ["a1", "b1"], "range": ["b1", "b2"], "q4": ["b1", "b2"], "form": ["b2"], "spoken": ["b2"]}
    assert Q.question_filters(spark.createDataFrame([], "k string, q string"), f, "k", "q", firms).count() == 0


def test_guard():
    labels, types = {"Company", "Filing"}, {"FILED"}
    good = "MATCH (c:Company)-[:FILED]->(f:Filing) // note\nWHERE f.text = 'DELETE; :Nope' RETURN collect(f.id) AS chunk_ids;"
    assert Q.guard(good, labels, types) is None
    assert Q.guard("MATCH (n) DETACH DELETE n RETURN n", labels, types) == "keyword detach"
    assert Q.guard("MATCH (n:Nope) RETURN n", labels, types) == "unknown name Nope" and Q.guard("MATCH (a)-[:ODD]->(b) RETURN a", labels, types) == "unknown name ODD"
    assert Q.guard("", labels, types) == "empty" and Q.guard("MATCH (n) RETURN n; MATCH (m) RETURN m", labels, types) == "several statements" and Q.guard("RETURN 1", labels, types) == "no match or return"
    assert Q.guard("MATCH (n RETURN n", labels, types) == "unbalanced brackets"
    ends = {"MEASURES": (("MetricValue",), ("Segment", "Product")), "AFFECTS": (("RiskFactor",), ("Product",))}
    known = {"MetricValue", "Segment", "Product", "RiskFactor"}
    assert Q.guard("MATCH (m:MetricValue)-[:MEASURES]->(s:Segment) RETURN m.set AS chunk_ids", known, ends) is None
    assert Q.guard("MATCH (m:MetricValue)<-[:MEASURES]-(s:Segment) RETURN m", known, ends) == "direction of MEASURES"
    assert Q.guard("MATCH (s:Segment)-[r:MEASURES]->(m) RETURN m", known, ends) == "direction of MEASURES"
    assert Q.guard("MATCH (m:MetricValue) MATCH (p:Product)-[:AFFECTS]-(r:RiskFactor), (m)-[:MEASURES]->(p) RETURN p", known, ends) is None
    assert Q.guard("MATCH (p:Product) MATCH (p)-[:AFFECTS]->(r:RiskFactor) RETURN p", known, ends) == "direction of AFFECTS"
    assert Q.guard("MATCH (n) CALL db.labels() RETURN n", known, ends) == "procedure call" and Q.guard("MATCH (n) CALL { MATCH (m) RETURN m } RETURN n", known, ends) is None
    assert Q.guard("LOAD CSV FROM 'x' AS y MATCH (n) RETURN n", known, ends) == "keyword load"


def test_bounded_result(spark):
    df = spark.range(5).selectExpr("array(cast(id as string)) as chunk_ids")
    rows, cut = Q.bounded_result(df, 3)
    assert rows.count() == 3 and cut and not Q.bounded_result(df, 5)[1]
    with pytest.raises(ValueError):
        Q.bounded_result(spark.range(2))


def test_pages(spark):
    html = "<html><head><title>t</title></head><body><nav>menu</nav><p>Intro &amp; more</p><h2>Item 1. Business</h2><p>We sell\n things.</p><table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table><script>x</script><h2>Item 1A. Risk</h2><p>Bad.</p></body></html>"
    text = H.page_text(html)
    assert "menu" not in text and "| a | b |\n| 1 | 2 |" in text and "Intro & more" in text and "We sell things." in text
    s = H.sections(text)
    assert [x[0] for x in s] == ["preamble", "Item 1", "Item 1A"] and s[0][1] == 0 and s[-1][2] == len(text) and all(a[2] == b[1] for a, b in zip(s, s[1:]))
    got = H.parsed_pages(spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string"), "id", "html")
    assert {r.id for r in got.collect()} == {1, 3}


def test_files(spark, tmp_path):
    f = spark.createDataFrame([("a", "text one"), ("b", "text ü")], "accession_no string, text string")
    FI.write_parsed(f, str(tmp_path / "p"))
    assert FI.read_parsed(spark, str(tmp_path / "p")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\nnope\n')
    with pytest.raises(FI.CorruptInput):
        FI.read_lines(spark, str(tmp_path / "bad.jsonl"), "id int")
    (tmp_path / "twice.jsonl").write_text('{"id": 1}\n{"id": 1}\n')
    with pytest.raises(FI.CorruptInput):
        FI.read_lines(spark, str(tmp_path / "twice.jsonl"), "id int", "id")
    FI.write_snapshot({"f": (f, ["accession_no"])}, str(tmp_path / "snap"))
    back = FI.read_snapshot(spark, str(tmp_path / "snap"), {"f": "accession_no string, text string"})
    assert rows(back["f"]) == rows(f)
    runs = tmp_path / "runs"
    runs.mkdir()
    for name, v in (("a-run1", 1), ("a-run10", 10), ("a-run9", 9), ("b-run1", 1)):
        (runs / f"{name}.jsonl").write_text(f'{{"v": {v}}}\n')
    assert rows(FI.latest_runs(spark, str(runs), "v int").select("accession", "v")) == [("a", 10), ("b", 1)]


def test_cache_calls_only_misses(spark):
    req = K.request_key(spark.createDataFrame([("x",), ("y",), ("x",)], "q string"), ["q"])
    held = req.where("q = 'x'").select("request_key", F.lit("old").alias("reply"))
    out, new = K.answered(req, held, lambda texts: [t.upper() for t in texts], "q")
    assert rows(out.select("q", "reply", "cached")) == [("x", "old", True), ("x", "old", True), ("y", "Y", False)] and new.count() == 1


def test_log(spark, tmp_path):
    log = [(1, "merge", "m1", "a", "A", 2), (2, "merge", "m1", "b", "A", 1), (3, "merge", "m2", "c", "C2", 1), (4, "split", "m2", None, None, None), (5, "merge", "m3", "a", "Z", 1)]
    df = spark.createDataFrame(log, L.LOG)
    assert rows(L.aliases(df)) == [("a", "Z"), ("b", "A")]
    assert rows(L.new_events(df.where("seq < 3"), df).select("seq")) == [(3,), (4,), (5,)]
    with pytest.raises(L.BrokenLog):
        L.active_merges(spark.createDataFrame([(1, "split", "zz", None, None, None)], L.LOG))
    src = tmp_path / "in"
    df.where("seq < 3").coalesce(1).write.json(str(src))
    stream = spark.readStream.schema(L.LOG).json(str(src))

    def run():
        q = L.keep_current(stream, str(tmp_path / "log"), str(tmp_path / "alias"), str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return rows(spark.read.parquet(str(tmp_path / "alias")))

    assert run() == [("a", "A"), ("b", "A")]
    df.where("seq in (2, 5)").coalesce(1).write.mode("append").json(str(src))
    assert run() == [("a", "Z"), ("b", "A")] and spark.read.parquet(str(tmp_path / "log")).count() == 3
