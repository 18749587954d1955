"""Chunking, graph building, evaluation, resolution and replies on small fixtures and against brute force."""

import itertools
import random
import time

from pyspark.sql import functions as F

from sedge.operators import build as B
from sedge.operators import chunking as C
from sedge.operators import evaluate as V
from sedge.operators import replies as R
from sedge.operators import resolving as S


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_chunks_keep_their_limits():
    rng = random.Random(2)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma.", "delta", "“eta.”"]) for _ in range(n))
    for _ in range(60):
        parts = [rng.choice([words(rng.randrange(1, 90)), "| a | b |\n" * rng.randrange(1, 12), "x" * 50, "!" * rng.randrange(1, 80)]) for _ in range(rng.randrange(0, 9))]
        text = "\n\n".join(parts)
        t = C.Text(text)
        got = t.chunks(40, 8)
        covered = set()
        tables = [(a, b) for a, b, table in t.units() if table]
        for k, (a, b, n, has) in enumerate(got):
            covered |= set(range(a, b))
            assert n == t.count(a, b) == len(C.word_tokens(text[a:b])) and text[a:b].strip() == text[a:b]
            assert n <= 40 or any(x >= a and y <= b for x, y in tables)
            assert has == any(x >= a and y <= b for x, y in tables) and all(not (x < a < y or x < b < y) for x, y in tables)
            if k:
                assert a > got[k - 1][0] and t.count(a, got[k - 1][1]) <= 8
        assert all(text[k].isspace() for k in range(len(text)) if k not in covered)
    assert C.Text("").chunks() == [] and C.Text(" \n ").chunks() == []


def test_long_units_are_cut_at_sentences_words_and_tokens(spark):
    sentences = " ".join(f"Number {k} is here." for k in range(30))
    got = C.Text(sentences).chunks(20, 0)
    assert all(sentences[a:b].endswith(".") for a, b, _, _ in got)
    assert [n for *_, n, _ in C.Text("a " * 50).chunks(20, 0)] == [20, 20, 10] and [n for *_, n, _ in C.Text("!" * 50).chunks(20, 0)] == [20, 20, 10]
    df = spark.createDataFrame([("a", sentences, 1), ("b", None, 2), ("c", "", 3)], "id string, text string, ordinal int")
    assert {r.id for r in C.chunked(df, "id", "text", 20, 5).collect()} == {"a"} and C.chunked(df.where("false"), "id", "text").count() == 0


def test_contained_matches_brute_force(spark):
    rng = random.Random(4)
    draw = lambda n: [(rng.choice("ab"), lo, lo + rng.randrange(0, 12), k) for k in range(n) for lo in [rng.randrange(30)]]
    spans, holders = draw(60), draw(25)
    got = {r.k: r.inside for r in C.contained(spark.createDataFrame(spans, "g string, lo int, hi int, k int"), spark.createDataFrame(holders, "g string, lo int, hi int, k int").drop("k"), "g").collect()}
    assert got == {k: any(h[0] == g and h[1] <= lo and h[2] >= hi for h in holders) for g, lo, hi, k in spans}


def test_headings_and_references(spark):
    text = "Risk one\nsee Risk two\nRisk one\nbody of one\nRisk two\nbody\n\nItem 1. Business\nItem 1A: Risks | page 4\nItem 1. Again"
    df = spark.createDataFrame([("x", text), ("y", None)], "id string, text string")
    h = spark.createDataFrame([("x", "Risk one"), ("x", "Risk two"), ("x", "absent"), ("x", " ")], "id string, heading string")
    assert rows(C.heading_bodies(df, h, "id", "text")) == [("x", "Risk one", text.rindex("Risk one"), text.rindex("Risk two")), ("x", "Risk two", text.rindex("Risk two"), len(text))]
    assert rows(C.cross_references(df, "id", "text", 0.6)) == [("x", "Item 1", "Business"), ("x", "Item 1A", "Risks")]


def test_drop_reasons_and_records(spark):
    e = spark.createDataFrame(
        [("f", "MEASURES", "MetricValue:a", "Product:p", "c1", "stated", 0.5, 1, 1, None), ("f", "AFFECTS", "RiskFactor:r", "RiskFactor:r2", "c1", "implied", None, 2, 2, None), ("f", "AFFECTS", "RiskFactor:r", "Product:p", "c2", "implied", 0.1, 3, 3, None),
         ("f", "AFFECTS", "RiskFactor:r", "Product:p", "c3", "stated", 0.2, 1, 4, None), ("f", "MEASURES", "MetricValue:lost", "Product:p", "c3", "stated", None, 1, 5, None), ("f", "COMPETES_WITH", "Organization:z", "Organization:a", "c3", "stated", None, 1, 6, None)],
        "file string, type string, start string, end string, chunk string, confidence string, stake double, at int, id int, role string",
    )
    alias = spark.createDataFrame([("RiskFactor:r2", "RiskFactor:r")], "key string, canonical string")
    d = B.with_drop_reason(e, alias, spark.createDataFrame([("MetricValue:lost",)], "key string"))
    assert {r.id: r.reason for r in d.collect()} == {1: None, 2: "self_loop", 3: None, 4: None, 5: "skipped_metric", 6: None}
    kept = d.where("reason is null")
    got = {(r.type, r.start, r.end): (r.chunks, r.stake) for r in B.edge_records(kept).collect()}
    assert got == {("MEASURES", "MetricValue:a", "Product:p"): (1, 0.5), ("AFFECTS", "RiskFactor:r", "Product:p"): (2, 0.2), ("COMPETES_WITH", "Organization:a", "Organization:z"): (1, None)}
    assert [(r.kept, r.other) for r in B.stake_conflicts(kept).collect()] == [(0.2, 0.1)]
    assert B.with_drop_reason(e.where("false"), alias, alias).count() == 0


def test_batch_rules(spark):
    n = "key string, label string, props map<string,string>, chunks array<string>, spans array<string>, confidences array<string>"
    ok = {"name": "x", "title": "t"}
    nodes = spark.createDataFrame(
        [("RiskFactor:a", "RiskFactor", ok, ["c1"], ["s"], ["stated"]), ("x", "Nope", ok, ["c1"], ["s"], ["stated"]), ("Segment:name", "Segment", {"name": "n"}, ["c1", "c1"], ["s", " "], ["stated", "odd"]), (None, "Product", {"key": "k", "odd": "1"}, [], [], []),
         ("Filing:1", "Filing", {}, ["c1"], ["s"], ["stated"]), ("MetricValue:m", "MetricValue", {"value": "many", "concept": "c", "unit": "u", "period": "p"}, ["c9"], ["s", "t"], ["stated"]), ("RiskFactor:a", "RiskFactor", {"name": "x"}, ["c1"], ["s"], ["stated"])], n
    )
    edges = spark.createDataFrame(
        [("e1", "AFFECTS", "RiskFactor", "RiskFactor:a", "Product", "Product:q", {}, ["c1"], ["s"], ["stated"]), ("e2", "ODD", "RiskFactor", "RiskFactor:a", "RiskFactor", "RiskFactor:a", {}, [], [], []), ("e3", "HOLDS_ROLE_AT", "Person", "", "Filing", "Filing:1", {}, [], [], []),
         ("e4", "OWNS", "Company", "Company:1", "Facility", "Facility:1", {"stake": "2"}, ["c1"], ["s"], ["stated"])],
        "item string, type string, start_label string, start string, end_label string, end string, props map<string,string>, chunks array<string>, spans array<string>, confidences array<string>",
    )
    got = set(rows(B.batch_violations(nodes, edges, spark.createDataFrame([("c1",)], "chunk string"), spark.createDataFrame([("Company", "Company:1"), ("Facility", "Facility:1")], "label string, key string"))))
    want = {
        ("RiskFactor/RiskFactor:a", "duplicate_item"), ("RiskFactor/RiskFactor:a", "missing_property"), ("Nope/x", "unknown_label"), ("Segment/Segment:name", "bad_key"), ("Segment/Segment:name", "duplicate_chunk"), ("Segment/Segment:name", "missing_property"),
        ("Segment/Segment:name", "disallowed_value"), ("Product/?", "missing_property"), ("Product/?", "missing_evidence"), ("Product/?", "reserved_property"), ("Product/?", "unknown_property"), ("Filing/Filing:1", "unexpected_evidence"),
        ("MetricValue/MetricValue:m", "wrong_type"), ("MetricValue/MetricValue:m", "evidence_length_mismatch"), ("MetricValue/MetricValue:m", "unknown_chunk"), ("e1", "unknown_endpoint"), ("e2", "unknown_edge_type"),
        ("e3", "bad_reference"), ("e3", "missing_evidence"), ("e3", "missing_property"), ("e3", "disallowed_endpoint"), ("e3", "unknown_endpoint"), ("e4", "disallowed_value"),
    }
    assert got == want


def test_bootstrap_of_any_statistic(spark):
    rng = random.Random(8)
    data = [("a", f"u{k % 40}", rng.random() < 0.6, rng.random() < 0.6) for k in range(400)] + [("b", None, True, True), ("c", "u1", True, True)]
    df = spark.createDataFrame(data, "g string, unit string, x boolean, y boolean")
    n = lambda c: F.col(c).cast("int")
    sums = {"n": F.lit(1), "both": n("x") * n("y"), "a": n("x"), "b": n("y")}
    got = {r.g: r for r in V.bootstrap_of(df, ["g"], "unit", sums, V.kappa_of, resamples=400).collect()}
    assert set(got) == {"a", "c"} and got["a"].n == 40 and got["a"].low < got["a"].estimate < got["a"].high and got["a"].kept == 400
    assert got["c"].estimate is None and got["c"].kept == 0 and V.bootstrap_of(df.where("false"), ["g"], "unit", sums, V.kappa_of).count() == 0
    mean = V.bootstrap_of(spark.range(500).selectExpr("id", "id % 10 as v"), [], "id", {"top": F.col("v"), "bottom": F.lit(1)}, V.ratio, resamples=1000).first()
    assert abs(mean.estimate - 4.5) < 1e-9 and abs((mean.high - mean.low) / (2 * 1.96 * 2.872 / 500**0.5) - 1) < 0.15  # the width of a normal interval


def test_paired_counts_unpaired_questions(spark):
    s = [("v", "x", f"q{k}", 0.0) for k in range(12)] + [("g", "x", f"q{k}", 1.0) for k in range(2, 14)]
    got = {(r.arm, r.class_name): r for r in V.paired(spark.createDataFrame(s, "arm string, class_name string, question string, score double"), "v").collect()}
    assert set(got) == {("g", "x"), ("g", "all")} and got["g", "x"].n == 10 and got["g", "x"].unpaired == 4 and got["g", "all"].difference == 1.0 and got["g", "all"].counts


def test_relations_and_absent_companies(spark):
    gold = F.array(F.struct(F.lit("a").alias("company"), F.lit("p").alias("period"), F.lit("s").alias("section")))
    ask = lambda rel, c, p, s: V.relation_holds(F.lit(rel), gold, F.lit(c), F.lit(p), F.lit(s))
    got = spark.range(1).select(ask("other_company", "b", "p", "s"), ask("other_company", "a", "p", "s"), ask("other_period", "a", "q", "s"), ask("other_period", "b", "q", "s"), ask("other_section", "a", "p", "t"), ask("odd", "a", "p", "t")).first()
    assert list(got) == [True, False, True, False, True, None]
    one = spark.range(1).select(V.named_but_absent(F.array(F.lit("A"), F.lit("B")), F.array(F.lit("A"))), V.named_but_absent(F.array(F.lit("B")), F.array(F.lit("A")))).first()
    assert list(one) == [["B"], []]


def test_smallest_cuts_and_their_number():
    def brute(same, against):
        nodes = sorted({x for p in same + against for x in p})
        links = sorted(set(same))
        best, found = None, set()
        for mask in range(1 << len(links)):
            cost = sum(same.count(x) for k, x in enumerate(links) if mask >> k & 1)
            root = {n: n for n in nodes}
            for k, (a, b) in enumerate(links):
                if not mask >> k & 1:
                    old, new = max(root[a], root[b]), min(root[a], root[b])
                    root = {n: new if r == old else r for n, r in root.items()}
            if all(root[a] != root[b] for a, b in against) and (best is None or cost <= best):
                found = found if cost == best else set()
                best = cost
                found.add(tuple(root.values()))
        return best, len(found)

    rng = random.Random(1)
    for _ in range(120):
        pairs = list(itertools.combinations(range(rng.randrange(3, 7)), 2))
        against = rng.sample(pairs, rng.randrange(1, min(4, len(pairs))))
        same = [p for p in (rng.choice(pairs) for _ in range(rng.randrange(1, 9))) if p not in against]
        n, _, ways, _ = S.smallest_cut(same, against)
        assert (n, ways) == brute(same, against)
    n, parts, ways, tied = S.smallest_cut([("a", "b"), ("b", "c")], [("a", "c")])
    assert (n, ways, tied) == (1, 2, ["a", "b", "c"]) and len({p for _, p in parts}) == 3
    pairs = list(itertools.combinations(range(12), 2))
    began = time.time()
    S.smallest_cut([p for p in pairs if sum(p) % 3], [p for p in pairs if not sum(p) % 3][:8])
    assert time.time() - began < 20


def test_draws(spark):
    pool = spark.createDataFrame([(k, "abc"[k % 3], f"q{k // 2}") for k in range(30)], "id int, g string, q string")
    got = S.round_robin(pool, "g", "q", "id", 9, "1").collect()
    assert len(got) == 9 and len({r.id // 2 for r in got}) == 9 and [r.g for r in sorted(got, key=lambda r: r.place)][:3] == ["a", "b", "c"]
    taken = S.slots(pool, "g", "id", {"a": 20, "b": 2}, "1").collect()
    assert len(taken) == 22 and sum(r.g == "a" and not r.fallback for r in taken) == 10 and sum(r.fallback for r in taken) == 10
    facts = spark.createDataFrame([("k1", "f", 1), ("k2", "f", 1), ("k3", "f", 2), ("k4", None, 1), ("k2", "f", 1)], "key string, filing string, v int")
    assert rows(S.same_facts(facts, "key", ["filing", "v"])) == [("k1", "k1", 1), ("k2", "k1", 1)]
    shown = spark.range(1).select(S.stratum(F.array(F.lit("x")), F.lit(0.0), F.lit(None), 85, 3), S.stratum(F.array(), F.lit(76.0), F.lit(None), 85, 3), S.stratum(F.array(), F.lit(10.0), F.lit(9), 85, 3), S.stratum(F.array(), F.lit(None), F.lit(None), 85, 3)).first()
    assert list(shown) == ["candidate", "near", "near", "rest"]


def test_merged_figures(spark):
    f = spark.createDataFrame(
        [("m", "12.5", "million", "stated", "c1", 1, 1), ("m", "12.48", "million", "implied", "c2", 2, 2), ("m", "13.0", "million", "implied", "c3", 3, 3), ("m", "99.9", "million", "uncertain", "c4", 4, 4), ("n", "7", "usd", "stated", "c1", 1, 5), ("n", "8", "usd", "stated", "c1", 2, 6), ("o", None, "usd", "stated", "c1", 1, 7)],
        "key string, value string, unit string, confidence string, chunk string, at int, id int",
    )
    assert rows(R.merged_figures(f)) == [("m", "13.0", "million", "c3", 2), ("n", "8", "usd", "c1", 0)]


def test_replies_and_corruptions(spark):
    replies = spark.createDataFrame([("a", '{"points":[{"text":"t","score":"101","chunk_ids":["c"]},{"text":"t","score":5,"chunk_ids":["c"]},{"text":"t","score":5,"chunk_ids":[]},{"text":" ","score":5}]}'), ("b", "no json")], "community string, reply string")
    got = {(r.community, r.pos): r.reason for r in R.map_points(replies, spark.createDataFrame([("a", "c")], "community string, chunk string")).collect()}
    assert got == {("a", 0): "score", ("a", 1): None, ("a", 2): "uncited", ("a", 3): "text", ("b", 0): "reply"}
    made = R.corruptions("Revenue was $1,000 in the year [a:1].", ["a:1", "b:2"])
    assert made == {"number": "Revenue was $1,500 in the year [a:1].", "negation": "Revenue was not $1,000 in the year [a:1].", "citation": "Revenue was $1,000 in the year [b:2].", "half": "Revenue was $1,000"}
    assert set(R.corruptions("Hm.", []).values()) == {None}
    s = spark.createDataFrame([(1, None, None), (2, "It is 5.", None)], "id int, text string, others array<string>")
    assert {(r.id, r.kind) for r in R.corrupted(s, "id", "text", "others").collect() if r.text} == {(2, "number"), (2, "negation")}


def test_report_problems(spark):
    reports = spark.createDataFrame(
        [("a", 1, ["x"]), ("a", 2, ["x", "q", "q", "r"]), ("a", 2, ["x", "q", "q", "r"]), ("a", 3, []), ("a", 4, None), ("a", 5, ["x", None]), ("b", 6, ["x"]), ("b", 7, ["y", "y"]), (None, 8, ["x"]), ("c", 9, ["y"])],
        "community string, finding int, chunks array<string>",
    )
    evidence = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", "y"), (None, "x")], "community string, chunk string")
    out = R.report_problems(reports, evidence)
    assert sorted((r.finding, r.reason) for r in out.collect()) == [(2, "foreign"), (2, "foreign"), (3, "uncited"), (4, "uncited"), (5, "foreign"), (6, "foreign"), (8, "foreign"), (9, "foreign")]
    # no list of all chunks of a community is held beside each of its findings
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_two_levels_of_communities(spark):
    from sedge.operators import communities as CM

    cliques = [[f"n{c}{k}" for k in range(6)] for c in range(4)]
    pairs = [(a, b, 5) for c in cliques for a, b in itertools.combinations(c, 2)] + [("n00", "n10", 1)]
    levels = CM.two_level(spark.createDataFrame(pairs, "a string, b string, weight int"), spark.createDataFrame([(x,) for c in cliques for x in c] + [("alone",)], "node string"), split=3)
    got = {r.node: (r.top, r.lower) for r in levels.collect()}
    assert set(got) == {x for c in cliques for x in c} | {"alone"} and got["alone"] == ("alone", "alone")
    assert all(len({got[x] for x in c}) == 1 and got[c[0]][0] == c[0] for c in cliques)
    tree = CM.tree(levels).collect()
    assert sorted((r.level, r.members, r.reportable) for r in tree) == [("top", 1, False)] + [("top", 6, True)] * 4


def test_files(spark, tmp_path):
    import json

    import pytest

    from sedge.sources import files as I

    (tmp_path / "e.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert [(r.line, r.id) for r in I.read_numbered(spark, str(tmp_path / "e.jsonl"), "id int", "id").orderBy("line").collect()] == [(1, 1), (3, 2)]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(I.CorruptInput, match="b.jsonl:2"):
        I.read_numbered(spark, str(tmp_path / "b.jsonl"), "id int")
    (tmp_path / "t.jsonl").write_text('{"id": 1}\n{"id": 1}\n')
    with pytest.raises(I.CorruptInput, match="t.jsonl:1.*t.jsonl:2"):
        I.read_numbered(spark, str(tmp_path / "t.jsonl"), "id int", "id")
    (tmp_path / "c.jsonl").write_text('{"kind": "odd"}\n')
    with pytest.raises(I.CorruptInput):
        I.read_candidates(spark, str(tmp_path / "c.jsonl"))
    import hashlib

    own = {"community_id": "top-1", "level": "top", "members": ["b", "a"], "member_hash": hashlib.sha256(b'["a","b"]').hexdigest()}
    (tmp_path / "com.json").write_text(json.dumps({"input_hash": "h", "communities": [own]}, indent=1))
    com = I.read_communities(spark, str(tmp_path / "com.json"))
    assert com.first().community_id == "top-1"
    (tmp_path / "bad.json").write_text(json.dumps({"input_hash": "h", "communities": [own | {"member_hash": "x"}]}))
    with pytest.raises(I.CorruptInput):
        I.read_communities(spark, str(tmp_path / "bad.json"))
    report = {"community_id": "top-1", "title": "t", "summary": "s", "findings": [{"text": "f", "chunk_ids": ["c"]}]}
    (tmp_path / "rep.json").write_text(json.dumps({"input_hash": "h", "reports": [report]}))
    assert I.read_reports(spark, str(tmp_path / "rep.json"), com).first().title == "t"
    (tmp_path / "rep2.json").write_text(json.dumps({"input_hash": "other", "reports": [report]}))
    with pytest.raises(I.CorruptInput):
        I.read_reports(spark, str(tmp_path / "rep2.json"), com)
    (tmp_path / "res.json").write_text(json.dumps({"format": 2, "rows": [{"q": "x", "v": 1.5}]}))
    assert I.read_results(spark, str(tmp_path / "res.json"), "q:string,v:double", 2).first().v == 1.5
    with pytest.raises(I.CorruptInput, match="res.json"):
        I.read_results(spark, str(tmp_path / "res.json"), "q:string,v:double", 3)
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    for name in ("one", "two"):
        I.write_snapshot({"t": (df, ["k"])}, str(tmp_path / name), single=True)
    one, two = ([p.read_bytes() for p in (tmp_path / n / "t").glob("*.gz")] for n in ("one", "two"))
    assert one == two and len(one) == 1
    I.import_snapshot(spark, str(tmp_path / "one"), {"t": "k int, v string"}, str(tmp_path / "store"))
    with pytest.raises(I.CorruptInput):
        I.import_snapshot(spark, str(tmp_path / "one"), {"t": "k int, v string"}, str(tmp_path / "store"))
    I.rebuild_graph(df, df, str(tmp_path / "graph"))
    with pytest.raises(I.CorruptInput):
        I.upsert_graph(df, df, df, str(tmp_path / "graph"), ["k"], ["k"])
    I.upsert_graph(spark.createDataFrame([(1, "new")], df.schema), df.where("false"), df.where("false"), str(tmp_path / "graph"), ["k"], ["k"])
    assert rows(spark.read.parquet(str(tmp_path / "graph/nodes"))) == [(1, "new"), (2, "b")] and rows(spark.read.parquet(str(tmp_path / "graph/edges"))) == [(1, "a"), (2, "b")]


def test_components_in_one_partition_and_over_all(spark, monkeypatch):
    from sedge.operators import components as K

    rng = random.Random(6)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 100 + k) for k in range(1, 40)] + [(200 + k, 201 + k) for k in range(30)] + [(None, 1), (5, 5)]
    df = spark.createDataFrame(pairs, "a int, b int")
    root = {x: x for p in pairs if None not in p for x in p}
    for _ in range(70):
        for a, b in pairs:
            if a is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    linked = {x for p in pairs if None not in p and p[0] != p[1] for x in p}
    for few in (500_000, 0):
        monkeypatch.setattr(K, "FEW", few)
        assert {r.key: r.root for r in K.components(df, "a", "b").collect()} == {x: root[x] for x in linked}
    assert K.components(df.where("false"), "a", "b").count() == 0
