"""Small tests of the training-data operators against brute force, with nulls, ties, repeats, empty tables and extra columns."""

import random
import re

import numpy as np
import pandas as pd
import pytest

from sedge.llm import defects, groups, leaks, mixing, names, neighbours, pieces, sentences, spans

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    f = pd.read_parquet(f"{DATA}/filings.parquet", columns=["parsed_text"]).parsed_text.tolist()
    a = pd.read_parquet(f"{DATA}/answers.parquet", columns=["text"]).text.dropna().tolist()
    return sentences.train(f + a)


# --- problem 1
def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((40, 16))
    x = np.concatenate([centers[k % 40] + 0.15 * rng.standard_normal(16) for k in range(400)]).reshape(400, 16).astype(np.float32)
    df = spark.createDataFrame([(f"c{k:03d}", x[k].tolist(), 1) for k in range(400)], "chunk_id string, embedding array<float>, id int")
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, "chunk_id", "embedding", 5, 0.8).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {tuple(sorted((f"c{i:03d}", f"c{j:03d}"))) for i in range(400) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.8}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


def test_nearest_small_leaves_keep_recall(spark):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((150, 24)), 4, axis=0) + 0.1 * rng.standard_normal((600, 24))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<float>")
    got = neighbours.nearest(df, "id", "vec", 3, 0.8, leaf=64).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(i, j) for i in range(600) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.8}
    assert len(want & set(zip(got.id_a, got.id_b))) / len(want) > 0.9


def test_nearest_searches_until_no_vector_is_open(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.standard_normal((1500, 32)), 4, axis=0) + 0.42 * rng.standard_normal((6000, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<float>")
    got = neighbours.nearest(df, "id", "vec", 3, 0.8, leaf=16).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(i, j) for i in range(6000) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.8}
    assert len(want & set(zip(got.id_a, got.id_b))) / len(want) > 0.95


def test_visits_hold_the_wanted_chance():
    rng = np.random.default_rng(7)
    project = rng.standard_normal((24, 7)).astype(np.float32)
    x = rng.standard_normal((300, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = neighbours.Tree(project, x @ project)
    d = np.full(300, 0.5)
    row, leaf = tree.visits(x, d, 0.2)
    own = tree.leaf(x)
    assert not (own[row] == leaf).any() and len(set(zip(row.tolist(), leaf.tolist()))) == len(row)
    hit = total = 0
    for k in range(300):  # neighbours at just that distance lie in the visited leaves as often as promised
        g = rng.standard_normal((40, 24)).astype(np.float32)
        near = tree.leaf(x[k] + 0.5 * g / np.linalg.norm(g, axis=1, keepdims=True))
        held = {own[k], *leaf[row == k].tolist()}
        hit, total = hit + sum(int(n) in held for n in near), total + 40
    assert 0.74 < hit / total < 0.95
    far, _ = tree.visits(x, np.full(300, 1e6), 1e-9)
    assert len(far) == 300 * 127  # as many leaves as the test asks for, up to all


def test_vectors_are_moved_once_a_region_and_visitors_not_compared():
    from types import SimpleNamespace

    rng = np.random.default_rng(9)
    project = rng.standard_normal((24, 8)).astype(np.float32)
    x = rng.standard_normal((2000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = neighbours.Tree(project, x @ project)
    shared = SimpleNamespace(value=tree)
    packed = next(neighbours._pack(iter([pd.DataFrame({"id": np.arange(2000), "vec": list(x)})])))
    homes = next(neighbours._homes(shared, SimpleNamespace(value=np.zeros(0, dtype=np.int64)), 5)(iter([packed]))).sort_values("region", kind="stable")
    met = pd.concat(neighbours._visiting(shared, 5, 5, 0.8, 0.3)(homes.iloc[k : k + 300] for k in range(0, 2000, 300)), ignore_index=True)
    assert not met.duplicated(["id", "region"]).any() and set(met.region) == set(range(8)) and (~met.away).sum() == 2000
    unit = neighbours._unit(homes["code"])
    row, leaf = tree.visits(unit, np.full(2000, np.sqrt(0.4)), 0.3)
    ids, own = homes["id"].to_numpy(), tree.leaf(unit)
    got = {(i, (r << 5) + n) for i, r, at in zip(met.id, met.region, met["at"]) for n in np.frombuffer(at, dtype="<u4").tolist()}
    assert got == set(zip(ids[row].tolist(), leaf.tolist())) | set(zip(ids.tolist(), own.tolist()))  # every leaf of every vector's test
    assert len(met) * 2 < len(got)  # and far fewer vectors moved
    met = met.sort_values(["region", "away"], kind="stable")
    pairs = pd.concat(neighbours._verified(5, -1.0)(met.iloc[k : k + 300] for k in range(0, len(met), 300)))
    home, held = dict(zip(ids.tolist(), own.tolist())), got
    assert all((a, home[b]) in held or (b, home[a]) in held for a, b in zip(pairs.id, pairs.other))
    s = x @ x.T
    exact = {(i, j) for i in range(2000) for j in np.argsort(-s[i])[:6] if i != j and ((i, home[j]) in held or (j, home[i]) in held)}
    assert exact <= set(zip(pairs.id, pairs.other))  # nothing that meets is lost


def test_no_jobs_before_an_action(spark):
    from sedge.operators.skew import salted_join
    from sedge.session import spread

    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("count-jobs", "")
    df = spark.range(1000).selectExpr("id % 7 as k", "id as v")
    wide = df.groupBy("k").count()
    salted_join(spread(wide), df.select("k").distinct().selectExpr("k", "k * 2 as w"), "k")
    assert not status.getJobIdsForGroup("count-jobs")
    assert salted_join(df, wide, "k").count() == 1000
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_nearest_copies_and_bad_vectors(spark, most, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_COPIES", most)
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [1.0, 0.01]), ("z", [0.0, 0.0]), ("n", None), ("e", [float("nan"), 1.0]), ("a", [1.0, 0.0]), (None, [1.0, 1.0]), ("h", [1.0, None])]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    got = {(r.id_a, r.id_b) for r in neighbours.similar_pairs(df, "chunk_id", "embedding", 5, 0.8).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c")}
    assert neighbours.nearest(df.where("false"), "chunk_id", "embedding", 5, 0.8).count() == 0
    assert neighbours.nearest(df.where("chunk_id in ('a', 'c')"), "chunk_id", "embedding", 5).count() == 2


# --- problem 2
def test_units(model):
    text = "The firm paid Dr. Smith $3.5 million. It grew [a:1].\n\nHeading here\n\n- one item\n| a | b |\nThe U.S. unit sold 4\nplants. The end"
    got = [text[a:b] for a, b in model.units(text)]
    assert got == ["The firm paid Dr. Smith $3.5 million.", "It grew [a:1].", "Heading here", "- one item", "| a | b |", "The U.S. unit sold 4\nplants.", "The end"]
    assert model.units("") == [] and model.units(" \n ") == []


def test_units_of_other_scripts(model):
    assert len(sentences.train([]).units("One thing. Two things.")) == 2
    assert len(model.units("在庫は5万円であり、引当金は3万円であった。 [0001399-22-1:0006]取締役は「需要は伸びる。」と述べ、投資額を3万円とした。")) == 2
    assert len(model.units("Der Umsatz betrug 3,5 Mio. Euro, z. B. für Dr. Meier. Zum 14. März waren Bestellungen offen.")) == 2
    assert len(model.units("สินค้าคงเหลือมีมูลค่า86.4ล้านบาท บริษัทได้ลงนามสัญญาฉบับที่80")) == 2


def test_found_units_edge_cases(spark):
    f = spark.createDataFrame([("x", "A b. C d.\n\nE f."), ("x", "A b. C d.\n\nE f."), ("y", None), ("z", ""), ("w", "word " * 20000)], "accession_no string, parsed_text string")
    a = spark.createDataFrame([(1, "Yes. No.", "en", 5), (2, None, None, 5)], "answer_id long, text string, lang string, sent_start int")
    got = sentences.found_units(f, a)
    assert got.columns == ["source_table", "row_key", "sent_start", "sent_end"]
    rows = got.collect()
    assert len(rows) == len(set(rows)) and {r.row_key for r in rows} == {"x", "w", "1"}
    assert sentences.found_units(f.where("false"), a.where("false")).count() == 0


def test_kept_texts_are_segmented(spark):
    from sedge.llm.queries import QUERIES

    got = {(r.answer_id, r.kept_at) for r in QUERIES["p2_kept"](spark, "/root/testdata/sf0.001").collect()}
    a = pd.read_parquet("/root/testdata/sf0.001/answers.parquet")
    assert got == {(i, k) for i, kept in zip(a.answer_id, a.kept) if kept is not None for k, s in enumerate(kept) if s["text"] and s["text"].strip()} and got


# --- problem 3
def test_cuts_cover_with_exact_overlap():
    rng = random.Random(4)
    for _ in range(200):
        n, limit = rng.randrange(0, 900), rng.randrange(5, 200)
        overlap = rng.randrange(0, limit)
        b = np.array(sorted(rng.sample(range(1, n + 1), min(n, rng.randrange(0, 40)))), dtype=np.int64)
        got = pieces.cuts(n, b, limit, overlap)
        assert (not got) == (n == 0)
        if got:
            assert got[0][0] == 0 and got[-1][1] == n and all(0 < e - s <= limit for s, e, _ in got)
            assert all(x[1] - y[0] == overlap for x, y in zip(got, got[1:]))
    with pytest.raises(ValueError):
        pieces.cuts(10, np.zeros(0, dtype=np.int64), 5, 5)


def test_pieces_of_chunks(spark, model):
    text = " ".join(f"Sales rose in {k}." for k in range(100))
    f = spark.createDataFrame([("a-1", text, 1), ("a-1", text, 2)], "accession_no string, parsed_text string, ordinal int")
    c = spark.createDataFrame([("a-1:0", " a-1\t", 0, len(text), None), ("a-1:1", "a-1", 0, 20, 9), ("b", "none", 0, 5, 1), ("a-1:2", "a-1", -5, 10**7, 0), ("n", None, 0, 1, 1), ("q", "a-1", 9, 3, 1)], "chunk_id string, accession_no string, char_start int, char_end int, token_count int")
    s = pieces.chunk_stretches(c, f)
    got = pieces.oversized_pieces(s, model).toPandas().sort_values(["chunk_id", "piece"])
    assert set(got.chunk_id) == {"a-1:0", "a-1:2"} and got.n_words.max() <= 160 and got.natural.all()
    own = got[got.chunk_id == "a-1:0"]
    words = [m.span() for m in re.finditer(r"\S+", text)]
    assert own.char_start.iloc[0] == 0 and own.char_end.iloc[-1] == len(text)
    for (_, x), (_, y) in zip(own.iloc[:-1].iterrows(), own.iloc[1:].iterrows()):
        assert len([w for w in words if y.char_start <= w[0] and w[1] <= x.char_end]) == 20


# --- problem 4
def test_typos():
    assert names.typo("james", "jmaes") and names.typo("susan", "suan") and names.typo("semi", "semji") and not names.typo("susan", "sasam") and names.typo("freight", "freght")
    assert names.shortened("svcs", "services") and not names.shortened("services", "svcs")


def test_names(spark):
    people = ["Deborah T. Mevoletris", "MEVOLETRIS, Debbie", "Deborah Meovletris", "D. T. Mevoletris", "Robert Mevoletris", "Ｒｏｂｅｒｔ Mevoletris", "Susan Nokezanol", None, "", "!!"]
    firms = ["Sofobabarn Robotics, LLC", "Robotics Sofobabarn", "Sofobabarn  Semiconductor, Inc.", "SOFOBABARN SEMICONDUCTOR INC"]
    more = [f"{b} {s} Inc." for b in ("Alphatron", "Betamixor", "Gammavent", "Deltapolis", "Epsilorta") for s in ("Robotics", "Semiconductor")]
    # short forms are learned: Debbie stands before rare family names where Deborah does
    others = [f"{g} {f}" for f in ("Bavokilun", "Cirutapes", "Dovanegik", "Fisopalet") for g in ("Deborah", "Debbie")] + [f"{g} {f}" for f in ("Gunatorev", "Halisemok", "Jopetavir", "Kunelosat") for g in ("Robert", "Susan")] + ["Deborah Lotavires"]
    others += [f"{g} {a}{b}ivor" for a in ("Mup", "Nec", "Pag", "Ris") for b in ("atol", "obek", "udis") for g in ("Susan",)]
    rows = [(100 + k, "Person", n) for k, n in enumerate(people)] + [(300 + k, "Person", n) for k, n in enumerate(others)] + [(200 + k, "Organization", n) for k, n in enumerate(firms + more)] + [(100, "Person", people[0])]
    nodes = spark.createDataFrame(rows, "node_id long, label string, name string")
    entries = spark.createDataFrame([(1, "Sofobabarn Semiconductor Inc.")], "entry_id long, name string")
    linked = names.linked_names(nodes, entries)
    got = {(r.id_a, r.id_b) for r in names.name_pairs(linked).collect()}
    assert {(100, 101), (100, 102), (100, 103), (104, 105), (200, 201), (1, 202), (1, 203)} <= got
    assert (202, 203) not in got and not any(106 in p for p in got) and (103, 104) not in got and (200, 202) not in got
    assert names.linked_names(nodes.where("false"), entries.where("false")).count() == 0


def test_nicknames_of_large_families(spark):
    # families of 15 to 40 given names teach too
    rows = [(f"f{k}", g) for k in range(5) for g in ("deborah", "debbie", *(f"own{k}x{n}" for n in range(13 + 6 * k)))] + [("f9", "deborah")]
    rows += [(f"o{k}", f"else{k}x{n}") for k in range(60) for n in range(15)]
    # three that hold nearly every name: who stands in them only stands beside each of them by chance
    rows += [(f"all{k}", f"common{n}") for k in range(3) for n in range(400)] + [(f"s{n}x{k}", f"common{n}") for n in range(400) for k in range(n % 3)]
    rows += [(f"all{k}", "rare") for k in range(3)]
    # small families teach, even if both forms stand in large ones without the other
    rows += [(f"p{k}", g) for k in range(6) for g in ("robert", "bob")] + [("p9", "robert"), ("p8", "robert"), ("all0", "bob"), ("all1", "robert")]
    got = names.nicknames(spark.createDataFrame(rows, "family string, token string")).collect()
    assert {tuple(r) for r in got if r.token in ("debbie", "deborah", "bob", "robert", "rare")} == {("debbie", "deborah"), ("bob", "robert")}


def test_a_proper_name_beside_many_tokens_decides(spark):
    firms = ["Vogekudux Energy Systems", "Vogekudux Capital Partners LLC", "Capital Partners Vogekudux", "Energy Systems, Vogekudux Inc."]
    more = [f"{b} {s}" for b in ("Alphatron", "Betamixor", "Gammavent", "Deltapolis", "Epsilorta", "Zetaquorn") for s in ("Energy Systems", "Capital Partners")]
    nodes = spark.createDataFrame([(k, "Organization", n) for k, n in enumerate(firms + more)], "node_id long, label string, name string")
    entries = spark.createDataFrame([], "entry_id long, name string")
    assert {(r.id_a, r.id_b) for r in names.name_pairs(names.linked_names(nodes, entries)).collect()} == {(0, 3), (1, 2)}


# --- problem 5
def test_refusals_and_languages_of_whole_replies(model, monkeypatch):
    class Part:
        threshold = 0.5

        def __init__(self, feature=None):
            self.feature = feature

        def score(self, rows):
            return np.array([float(self.feature in r) for r in rows])

    class Languages:
        def of(self, units):
            return ["de" if "der" in u else "en" for u in units]

    monkeypatch.setattr(defects.Linear, "rows", staticmethod(lambda x: x))
    d = defects.Defects(model, Languages(), {k: Part() for k in ("empty", "question_copy", "truncated")} | {"refusal": Part("2no comment"), "wrong_language": Part("mostTrue")})
    late = " ".join(f"Sales rose in part {k}." for k in range(12)) + " We give no comment here."
    long = "The firm sold " + "many more and " * 20 + "so no comment on this."
    listed = "The sales were:\n\n" + "\n".join(f"- der Umsatz {k} stieg" for k in range(5))
    asked = [("What?", "en", "x", "end_turn", t) for t in (late, long, listed, "Sales rose.")]
    assert d.defects(pd.DataFrame(asked, columns=["question", "lang", "class_name", "stop_reason", "raw_text"])) == ["refusal", "refusal", "wrong_language", None]
    thai = "".join(chr(0x0E01 + k % 40) for k in range(200))
    assert all(any(thai[k : k + 3] in w[:30] for w in defects.windows(thai)) for k in range(190))


def _answers(n=240):
    rng = random.Random(3)
    things = ["boards", "wafers", "cards", "units"]
    rows = []
    for k in range(n):
        q = f"How much did the {rng.choice(things)} of plant {k} cost in {2000 + k % 20}?"
        sents = [f"The {rng.choice(things)} cost ${rng.randrange(100, 999)}.{rng.randrange(10)} million in the third quarter of the year. [a:{k}]" for _ in range(4)]
        rows.append((k, q, "en", "lookup", "answered", "end_turn", None, "STATUS: answered\n" + " ".join(sents)))
    for k in range(20):
        rows.append((n + k, f"What about plant {k}?", "en", "lookup", "declined", "end_turn", None, "STATUS: declined\nI am sorry, but I cannot help with that."))
    return rows


def test_defects(spark):
    schema = "answer_id long, question string, lang string, class_name string, status string, stop_reason string, refusal_category string, raw_text string"
    whole = "STATUS: answered\nThe boards cost $123.4 million in the third quarter of the year."
    bad = [
        (1000, "Why?", "en", "lookup", "answered", "refusal", None, ""), (1001, "Why so?", "en", "lookup", "answered", "end_turn", None, "STATUS: answered\n"), (1002, "How much did it cost?", "en", "lookup", "answered", None, None, None),
        (1003, "How much did the cards cost in 2004?", "en", "lookup", "answered", "end_turn", None, "Status: answered\nHow much did the cards cost in 2004??"),
        (1004, "How much did the cards of plant 9 cost?", "en", "lookup", "answered", "end_turn", None, "STATUS: answered\nThe boards cost $123.4 million in the third"),
        (1005, "What about plant 77?", "en", "lookup", "answered", "end_turn", None, "I am sorry, but I cannot help with that."), (1006, "What about plant 78?", "en", "decline", "declined", "end_turn", None, "STATUS: declined\nI am sorry, but I cannot help with that."),
        (1007, None, None, None, None, None, None, whole), (1008, "How much did the cards of plant 9 cost?", "en", "lookup", "answered", "max_tokens", None, whole), (1008, "How much did the cards of plant 9 cost?", "en", "lookup", "answered", "max_tokens", None, whole),
    ]
    got = {(r.answer_id, r.defect) for r in defects.defective(spark.createDataFrame(_answers() + bad, schema)).collect() if r.answer_id >= 1000}
    assert got == {(1000, "refusal"), (1001, "empty"), (1002, "empty"), (1003, "question_copy"), (1004, "truncated"), (1005, "refusal")}
    assert defects.defective(spark.createDataFrame([], schema)).count() == 0


def test_wrong_language():
    de = [f"Der Umsatz der Gesellschaft betrug {k} Mio. Euro und lag damit weit über dem Vorjahr." for k in range(60)]
    en = [f"The revenue of the company was {k} million and was well above the year before." for k in range(60)]
    lang = defects.Languages.fit(de + en, ["de"] * 60 + ["en"] * 60)
    pairs = [(defects.language_pair_features("en", ["en"] * a + ["de"] * b, False), float(b > a)) for a in range(5) for b in range(5) if a + b]
    d = defects.Defects(sentences.train([]), lang, {"wrong_language": defects._part(pairs * 4, np.random.default_rng(1))})
    assert d.wrong_language("What was it?", "en", de[:2]) and not d.wrong_language("What was it?", "en", en[:2] + de[:1])
    assert not d.wrong_language("What was it? Please answer in German.", "en", de[:2]) and d.wrong_language("What was it? Please answer in German.", "en", en[:2])
    assert not d.wrong_language("", None, []) and defects.lang_code("DE-xx") == "de" and defects.lang_code("??") is None


# --- problem 7
def _brute_groups(pairs):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, same in pairs:
        for k in (a, b):
            if k is not None:
                root.setdefault(k, k)
        if same and a is not None and b is not None:
            x, y = sorted((find(a), find(b)), key=lambda s: s.encode())
            root[y] = x
    return {k: find(k) for k in root}


@pytest.mark.parametrize("few", [500_000, 0])
def test_groups(spark, few, monkeypatch):
    monkeypatch.setattr(groups, "FEW", few)  # in one partition, and over all
    rng = random.Random(9)
    pairs = [(f"c{k:04d}", f"c{k + 1:04d}", True) for k in range(150)] + [("hub", f"h{k}", True) for k in range(200)]
    pairs += [(f"r{rng.randrange(300)}", f"r{rng.randrange(300)}", rng.random() < 0.4) for _ in range(300)]
    pairs += [("self", "self", True), (None, "lone", True), ("no", "way", False), ("null", "same", None), ("é", "z", True), ("c0003", "c0002", False), ("c0003", "c0002", True)]
    df = spark.createDataFrame([(a, b, s, "x") for a, b, s in pairs], "key_a string, key_b string, same boolean, node_key string")
    assert {r.node_key: r.group_key for r in groups.group_pairs(df).collect()} == _brute_groups(pairs)
    assert groups.group_pairs(df.where("false")).count() == 0
    assert groups.group_pairs(df.where("not same")).where("node_key <> group_key").count() == 0


# --- problem 8
def test_leaks(spark):
    passage = "Chair Sekapa told the Raruni panel that the 1992 recall touched 34 meters, 55793 of which were traced to one kiln."
    items = spark.createDataFrame([("q1", passage), ("q1", passage), ("q2", "too short"), ("q3", None), (None, passage)], "item_id string, passage string")
    part = "told THE Raruni -- panel that, the 1992 recall; touched 34 meters 55793 of which"
    near = "told the Raruni panel that the 1992 recal touched 34 meters 55793 of which were traced to one"
    docs = [(1, "Noise before. " + passage + " Noise after."), (2, "x " + part + " y"), (3, " ".join(part.split()[:10])), (4, None), (5, ""), (6, near), (7, ("word " * 30000) + passage), (1, "Noise before. " + passage + " Noise after.")]
    got = leaks.leaked_items(spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, passage string"), items)
    rows = {r.doc_id: r for r in got.collect()}
    assert {k for k, r in rows.items() if r.run >= 12} == {1, 2, 7} and set(rows) == {1, 2, 6, 7}
    other = spark.createDataFrame([("q1", passage)] + [(f"n{k}", f"{k} unrelated passage of its own with more than twelve tokens in it as others {k} {k + 1} {k * 7}") for k in range(40)], "item_id string, passage string")
    blocks = leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), other, item_chars=300)
    assert {(r.doc_id, r.item_id) for r in blocks.collect() if r.run >= 12} == {(1, "q1"), (2, "q1"), (7, "q1")}
    assert leaks.leaked_items(spark.createDataFrame([], "doc_id long, text string"), items).count() == 0
    assert leaks.leaked_items(spark.createDataFrame([(1, passage)], "doc_id long, text string"), items.where("false")).count() == 0


def test_longest_run_matches_brute_force():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.choice("abc") for _ in range(20)] for _ in range(2))
        p = leaks.Passages([("x", " ".join(a))], 3, 0)
        best = max((n for n in range(21) for i in range(21 - n) for j in range(21 - n) if a[i : i + n] == b[j : j + n]), default=0)
        assert p.longest_run(b, 0) == best


# --- problem 9
def test_mixture(spark):
    rng = random.Random(5)
    docs = [(k, rng.choice(["big", "Big ", "small"]) if k % 9 else None, rng.randrange(0, 50)) for k in range(3000)]
    counted = spark.createDataFrame(docs, "doc long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mixture(counted, targets)
    s = {r.source: r for r in mixing.shares(m, targets).collect()}
    assert abs(s["big"].actual_share - 0.5 / 0.9) < 0.01 and abs(s["small"].actual_share - 0.4 / 0.9) < 0.01 and s["none"].tokens == 0
    assert m.groupBy("doc", "pass").count().where("count > 1").count() == 0 and m.agg({"pass": "max"}).first()[0] <= 3
    over = mixing.shares(mixing.mixture(counted, targets, budget=10**9), targets).collect()
    assert max(r.passes for r in over) == 3 and {r.source: r.passes for r in over}["big"] == 1
    assert mixing.mixture(counted.where("false"), targets).count() == 0
    few = mixing.mixture(counted, targets, budget=1000).agg({"tokens": "sum"}).first()[0]
    assert 800 <= few <= 1000
    held = {r.source: r.tokens for r in over}
    full = held["big"] + held["small"]
    # big ends at its cap, small goes on until the total is reached
    more = mixing.mixture(counted, targets, budget=full - 2000).agg({"tokens": "sum"}).first()[0]
    assert full - 2050 <= more <= full - 2000


def test_token_counts(spark):
    from tokenizers import Tokenizer

    folder = "/opt/tokenizers/byte_bpe_50k"
    df = spark.createDataFrame([(1, "a", "Hello world <|endoftext|>"), (2, "a", None), (3, None, "")], "doc_id long, source string, text string")
    t = Tokenizer.from_file(folder + ".json")
    t.encode_special_tokens = True
    assert {r.doc: r.tokens for r in mixing.token_counts(df, folder + ".tiktoken").collect()} == {1: len(t.encode("Hello world <|endoftext|>", add_special_tokens=False).ids), 2: 0, 3: 0}


# --- problem 10
def _brute_spans(docs, n):
    words = {}
    for d, t in docs:
        words[d] = re.findall(r"[^ \t\r\n]+", t)
    at = {}
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            at.setdefault(tuple(w[i : i + n]), set()).add(d)
    out = set()
    for d, w in words.items():
        cover = set()
        for i in range(len(w) - n + 1):
            if len(at[tuple(w[i : i + n])]) > 1:
                cover |= set(range(i, i + n))
        for i in sorted(cover):
            if i - 1 not in cover:
                j = i
                while j + 1 in cover:
                    j += 1
                out.add((d, i, j))
    return out


@pytest.mark.parametrize("n", [3, 12, 50])
def test_spans_match_brute_force(spark, n):
    rng = random.Random(n)
    pool = [" ".join(rng.choice(["a", "b", "c", "dd"]) for _ in range(70)) for _ in range(6)]
    docs = [(k, "\t".join([rng.choice(pool)[: rng.randrange(20, 200)], f"u{k} v{k}", rng.choice(pool)])) for k in range(30)] + [(99, "same same " * 60), (100, "one two")]
    rows = [(*d, 1) for d in docs] + [(200, None, 1), (201, "", 1), (None, pool[0], 1), (0, docs[0][1], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, first_word int")
    got = {tuple(r) for r in spans.shared_spans(df, min_words=n).collect()}
    assert got == _brute_spans(docs, n)
    assert {tuple(r) for r in spans.shared_spans(df, min_words=n, group=1).collect()} == got
    assert spans.shared_spans(df.where("false"), min_words=n).count() == 0


def test_subtrees_of_many_groups_in_one_array():
    rng = random.Random(9)
    for _ in range(30):
        words = [np.array([rng.randrange(3) for _ in range(rng.randrange(4, 20))], dtype=np.uint64) for _ in range(6)]
        owner = np.array([k % 4 for k in range(6)])
        run, leaf = spans.shared_leaves(owner, words, 4)
        grams = {}
        for k, w in enumerate(words):
            for i in range(len(w) - 3):
                grams.setdefault(tuple(w[i : i + 4].tolist()), set()).add((k, i))
        want = {x for held in grams.values() if len({owner[k] for k, _ in held}) > 1 for x in held}
        assert set(zip(run.tolist(), leaf.tolist())) == want and len(run) == len(want)


def test_window_fingerprints():
    h = np.arange(1, 40, dtype=np.uint64)
    for length in (1, 2, 7, 10, 39, 40):
        got = spans.windows(h, length, np.uint64(31))
        want = [sum(int(h[i + j]) * 31 ** (length - 1 - j) for j in range(length)) % 2**64 for i in range(len(h) - length + 1)]
        assert [int(x) for x in got] == want
        assert spans._least(h, length).tolist() == [min(h[i : i + length]) for i in range(len(h) - length + 1)]


def test_shares(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c x"), (3, ""), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.shared_words, r.share) for r in spans.shared_shares(df, spans.shared_spans(df, min_words=3)).collect()}
    assert got == {1: (4, 3, 0.75), 2: (4, 3, 0.75), 3: (0, 0, None)}

