"""Queries that build the graph from the evidence table and check it.

The extraction files are the evidence rows of a filing; an edge is proposed from each node of a chunk to the next one by evidence id,
of the type that the first one's label starts, so that every rule for dropping has something to drop.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedge.book import Book
from sedge.operators import build as B
from sedge.operators import communities as CM
from sedge.operators import graph as G
from sedge.operators import ranking as R
from sedge.operators import store as S
from sedge.plans.store import CUR_C, CUR_F
from sedge.session import cut, table

book = Book()
QUERIES, SQL = book.queries, book.sql

_TYPES = {"MetricValue": "MEASURES", "RiskFactor": "AFFECTS", "Segment": "OFFERS", "Product": "SUBJECT_TO"}
_RANK = "case lower(trim(confidence)) when 'stated' then 3 when 'implied' then 2 when 'uncertain' then 1 else 0 end"
_CAND = f"""n as (select distinct evidence_id as id, label, node_key as key, regexp_extract(node_key, '[^:]*$') as name, trim(chunk_id, ' ' || chr(9)) as chunk, span, confidence, extracted_at as ts,
 regexp_replace(trim(chunk_id, ' ' || chr(9)), ':[^:]*$', '') as file, {_RANK} as r from evidence where node_key is not null and chunk_id is not null),
e as (select * from (select id, file, chunk, confidence, r, ts, case label when 'MetricValue' then 'MEASURES' when 'RiskFactor' then 'AFFECTS' when 'Segment' then 'OFFERS' when 'Product' then 'SUBJECT_TO' end as type, key as "start",
 lead(key) over (partition by chunk order by id, key, ts, span) as "end", case when label in ('Segment', 'RiskFactor') then (id % 10) / 10.0::double end as stake from n) where "end" is not null and type is not null),
al as (select key_b as key, min(key_a) as canonical from pair_labels where same and key_a is not null and key_b is not null and key_a <> key_b group by 1),
sk as (select distinct file, key from n where label = 'MetricValue' and (file, key) not in (select (file, "start") from e where type = 'MEASURES'))"""
_PAIRS = "p as (select * from (values " + ", ".join(f"('{t}', '{a}', '{b}')" for t, (x, y) in B.EDGES.items() for a in x for b in y) + ') v(type, sl, el))'
_DROPS = f"""{_CAND}, {_PAIRS}, c as (select e.* replace (coalesce(a.canonical, e."start") as "start", coalesce(b.canonical, e."end") as "end"),
 e."start" in (select key from sk) or e."end" in (select key from sk) as gone from e left join al a on a.key = e."start" left join al b on b.key = e."end"),
d as (select c.*, case when gone then 'skipped_metric' when "start" = "end" then 'self_loop' when p.type is null then 'disallowed_endpoint' end as reason
 from c left join p on p.type = c.type and p.sl = split_part("start", ':', 1) and p.el = split_part("end", ':', 1))"""


def _nodes(spark, d):
    e = table(spark, d, "evidence").where("node_key is not null and chunk_id is not null")
    chunk = F.btrim("chunk_id", F.lit(" \t"))
    return e.select(
        F.col("evidence_id").alias("id"), "label", F.col("node_key").alias("key"), F.regexp_extract("node_key", "([^:]*)$", 1).alias("name"), chunk.alias("chunk"), "span", "confidence", F.col("extracted_at").alias("at"),
        F.regexp_replace(chunk, ":[^:]*$", "").alias("file"),
    ).distinct()


def _edges(nodes):
    types = F.create_map(*[F.lit(x) for kv in _TYPES.items() for x in kv])
    after = Window.partitionBy("chunk").orderBy("id", "key", "at", "span")
    e = nodes.withColumn("end", F.lead("key").over(after)).withColumn("type", F.try_element_at(types, F.col("label"))).withColumn("stake", F.when(F.col("label").isin("Segment", "RiskFactor"), F.col("id") % 10 / 10.0))
    return e.where("end is not null and type is not null").select("id", "file", "chunk", "confidence", "at", "type", F.col("key").alias("start"), "end", "stake", F.lit(None).cast("string").alias("role"))


def _alias(spark, d):
    p = table(spark, d, "pair_labels").where("same and key_a is not null and key_b is not null and key_a <> key_b")
    return p.groupBy(F.col("key_b").alias("key")).agg(F.min("key_a").alias("canonical"))


def _with_reason(spark, d):
    n = _nodes(spark, d)
    e = _edges(n)
    return B.with_drop_reason(e, _alias(spark, d), B.metrics_without_subject(n, e))


@book.query(f"with {_CAND} select file, key from sk")
def skipped_metrics(spark, d):
    n = _nodes(spark, d)
    return B.metrics_without_subject(n, _edges(n))


@book.query(f"""with {_DROPS} select coalesce(reason, 'kept') as reason, type, count(*) as n from d group by 1, 2""")
def edge_drops(spark, d):
    return _with_reason(spark, d).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), "type").agg(F.count(F.lit(1)).alias("n"))


@book.query(
    f"""with {_CAND}, c as (select n.*, n.key as own, coalesce(al.canonical, n.key) as k from n left join al on al.key = n.key)
select k as key, split_part(k, ':', 1) as label, arg_max(name, (ts, id)) as name, array_to_string(list_sort(list_filter(list(distinct own), lambda x: x <> k)), ' ') as aliases, count(distinct chunk) as chunks, max(r) as best from c group by k"""
)
def node_records(spark, d):
    return B.node_records(_nodes(spark, d), _alias(spark, d)).withColumn("aliases", F.array_join("aliases", " "))


@book.query(
    f"""with {_DROPS} select type, "start", "end", count(distinct chunk) as chunks, count(*) as entries, arg_max(stake, (r, ts, id)) as stake from d where reason is null group by 1, 2, 3"""
)
def edge_records(spark, d):
    return B.edge_records(_with_reason(spark, d).where("reason is null")).drop("role")


@book.query(
    f"""with {_DROPS}, k as (select type, "start", "end", arg_max(stake, (r, ts, id)) as kept from d where reason is null and stake is not null group by 1, 2, 3)
select distinct type, "start", "end", kept, d.stake as other from d join k using (type, "start", "end") where reason is null and d.stake is not null and d.stake <> kept"""
)
def stake_conflicts(spark, d):
    return B.stake_conflicts(_with_reason(spark, d).where("reason is null")).drop("role")


@book.query(
    f"""with {_CAND}, l as (select distinct later, earlier, chunk from (select key as later, chunk, lag(key) over (partition by split_part(file, '-', 1), regexp_replace(name, '-[0-9]+$', '') order by file, key, chunk) as earlier
 from (select distinct key, name, chunk, file from n where label = 'RiskFactor')) where earlier <> later),
o as (select *, min(earlier) over (partition by later) <> max(earlier) over (partition by later) as c from l)
select distinct later, earlier, case when c then 'several_predecessors' end as reason from o"""
)
def persistence_edges(spark, d):
    """Each risk linked to the one before it on its topic in its company's filings."""
    n = _nodes(spark, d).where("label = 'RiskFactor'").select("key", "name", "chunk", "file").distinct()
    before = Window.partitionBy(F.split_part("file", F.lit("-"), F.lit(1)), F.regexp_replace("name", "-[0-9]+$", "")).orderBy("file", "key", "chunk")
    links = n.select(F.col("key").alias("later"), F.lag("key").over(before).alias("earlier"), "chunk").where("earlier <> later")
    return B.persistence_edges(links, n, n).distinct()


@book.query(
    f"""with {_DROPS}, {CUR_F}, {CUR_C}, c2 as (select coalesce(al.canonical, n.key) as key from n left join al on al.key = n.key)
select 'node' as kind, split_part(key, ':', 1) as name, count(distinct key) as n from c2 group by 2 union all
select 'edge', type, count(distinct ("start", "end")) from d where reason is null group by 2 union all
select 'node', 'Filing', count(*) from cf union all select 'node', 'Company', count(distinct cik) from cf union all select 'node', 'Period', count(distinct (cik, fiscal_period)) from cf union all
select 'node', 'Chunk', count(*) from cc join cf using (accession_no) union all
select 'edge', 'FILED', count(*) from cf union all select 'edge', 'COVERS_PERIOD', count(*) from cf union all select 'edge', 'PART_OF', count(*) from cc join cf using (accession_no)"""
)
def graph_build(spark, d):
    """Sizes of the whole graph: structure, merged nodes and kept edges."""
    nodes = B.node_records(_nodes(spark, d), _alias(spark, d)).groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    edges = B.edge_records(_with_reason(spark, d).where("reason is null")).groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "name", "n")
    f = S.current_filings(table(spark, d, "filings"), ["cik", "fiscal_period"])
    sizes = f.agg(F.count(F.lit(1)).alias("Filing"), F.count_distinct("cik").alias("Company"), F.count_distinct("cik", "fiscal_period").alias("Period"))
    parts = S.current_chunks(table(spark, d, "chunks")).select("chunk_id", "accession_no").join(f.select("accession_no"), "accession_no").agg(F.count(F.lit(1)).alias("n"))
    rows = F.array(*[F.struct(F.lit("node").alias("kind"), F.lit(x).alias("name"), F.col(x).alias("n")) for x in ("Filing", "Company", "Period")], *[F.struct(F.lit("edge").alias("kind"), F.lit(x).alias("name"), F.col("Filing").alias("n")) for x in ("FILED", "COVERS_PERIOD")])
    fixed = sizes.select(F.explode(rows).alias("x")).select("x.*")
    of_chunks = parts.select(F.explode(F.array(F.struct(F.lit("node").alias("kind"), F.lit("Chunk").alias("name")), F.struct(F.lit("edge").alias("kind"), F.lit("PART_OF").alias("name")))).alias("x"), "n").select("x.*", "n")
    return nodes.unionByName(edges).unionByName(fixed).unionByName(of_chunks)


@book.query(
    f"""with {_DROPS}, g as (select key, label, list(chunk order by id, ts) as chunks, list(span order by id, ts) as spans, list(r) as rs, min(name) as name from n group by 1, 2), gi as (select coalesce(label, '?') || '/' || key as item, * from g),
ge as (select type || ' ' || "start" || ' ' || "end" as item, type, "start", "end", list(chunk) as chunks, list(r) as rs from d where gone is not null group by 1, 2, 3, 4)
select distinct item, rule from (
select item, 'duplicate_chunk' as rule from gi where len(list_distinct(chunks)) < len(chunks) union all
select item, 'missing_property' from gi where len(list_filter(spans, lambda s: s is null or trim(s) = '')) > 0 union all
select item, 'missing_property' from gi where label in ('RiskFactor', 'MetricValue') union all
select item, 'disallowed_value' from gi where list_contains(rs, 0) union all
select item, 'bad_key' from gi where label = 'Segment' and not regexp_matches(key, '^(Segment|MarketPlatform):[0-9]+:\\S.*$') union all
select item, 'unknown_chunk' from (select item, unnest(chunks) as c from gi union all select item, unnest(chunks) from ge) where c not in (select chunk_id from chunks where chunk_id is not null) union all
select item, 'duplicate_chunk' from ge where len(list_distinct(chunks)) < len(chunks) union all
select item, 'disallowed_value' from ge where list_contains(rs, 0) union all
select item, 'disallowed_endpoint' from ge left join p on p.type = ge.type and p.sl = split_part("start", ':', 1) and p.el = split_part("end", ':', 1) where p.type is null union all
select item, 'unknown_endpoint' from ge where ("start") not in (select key from n) or "end" not in (select key from n))"""
)
def batch_checks(spark, d):
    """The rules of a batch on the whole extraction, edges before dropping."""
    n = _nodes(spark, d)
    spans = F.array_sort(F.collect_list(F.struct("id", "at", "chunk", F.coalesce("span", F.lit("")).alias("span"), F.coalesce("confidence", F.lit("")).alias("confidence"))))
    arrays = [F.col("x.chunk").alias("chunks"), F.col("x.span").alias("spans"), F.col("x.confidence").alias("confidences")]
    nodes = n.groupBy("key", "label").agg(spans.alias("x"), F.min("name").alias("name")).select("key", "label", F.create_map(F.lit("name"), F.col("name")).alias("props"), *arrays)
    e = _with_reason(spark, d).withColumn("span", F.lit("edge"))
    edges = e.groupBy("type", "start_label", "start", "end_label", "end").agg(spans.alias("x")).select(
        F.concat_ws(" ", "type", "start", "end").alias("item"), "type", "start_label", "start", "end_label", "end", F.create_map().cast("map<string,string>").alias("props"), *arrays
    )
    known = table(spark, d, "chunks").where("chunk_id is not null").select(F.col("chunk_id").alias("chunk"))
    return B.batch_violations(cut(nodes), cut(edges), known, nodes.select("label", "key").where("false"))


_CHECKS = ["node_labels", "edge_types", "endpoints", "node_properties", "node_evidence", "edge_evidence", "structure", "postgres_chunks"]


def _stored(spark, d):
    """The graph with the faults that the evidence table brings along: all proposed edges, chunks without a filing, nodes of unknown chunks."""
    n = _nodes(spark, d)
    f = S.current_filings(table(spark, d, "filings"), ["cik", "fiscal_period"])
    c = S.current_chunks(table(spark, d, "chunks")).select("chunk_id", "accession_no")
    own = n.groupBy("key").agg(F.min("name").alias("name")).select("key", F.array(B.label_of(F.col("key"))).alias("labels"), "name")
    filing = f.select(F.concat(F.lit("Filing:"), "accession_no").alias("key"), F.array(F.lit("Filing")).alias("labels"), F.lit("").alias("name"))
    chunk = c.select(F.col("chunk_id").alias("key"), F.array(F.lit("Chunk")).alias("labels"), F.lit("").alias("name"))
    none = F.array().cast("array<string>").alias("chunks")
    edge = lambda t, sl, s, el, e, chunks: [F.lit(t).alias("type"), F.lit(sl).alias("start_label") if isinstance(sl, str) else sl.alias("start_label"), s.alias("start"), F.lit(el).alias("end_label") if isinstance(el, str) else el.alias("end_label"), e.alias("end"), chunks]
    filed = f.select(*edge("FILED", "Company", F.concat(F.lit("Company:"), "cik"), "Filing", F.concat(F.lit("Filing:"), "accession_no"), none))
    covers = f.select(*edge("COVERS_PERIOD", "Filing", F.concat(F.lit("Filing:"), "accession_no"), "Period", F.concat(F.lit("Period:"), "cik", F.lit(":"), "fiscal_period"), none))
    part = c.join(f.select("accession_no"), "accession_no").select(*edge("PART_OF", "Chunk", F.col("chunk_id"), "Filing", F.concat(F.lit("Filing:"), "accession_no"), none))
    known = n.join(c.select(F.col("chunk_id").alias("chunk")), "chunk", "left_semi")
    by = known.select("key", "chunk").distinct().select(*edge("EVIDENCED_BY", B.label_of(F.col("key")), F.col("key"), "Chunk", F.col("chunk"), none))
    drawn = _with_reason(spark, d).groupBy("type", "start_label", "start", "end_label", "end").agg(F.array_sort(F.collect_set("chunk")).alias("chunks")).select("type", "start_label", "start", "end_label", "end", "chunks")
    edges = filed.unionByName(covers).unionByName(part).unionByName(by).unionByName(drawn)
    store = c.select(F.col("chunk_id").alias("chunk"), F.concat(F.lit("Filing:"), "accession_no").alias("filing"))
    return cut(own.unionByName(filing).unionByName(chunk)), cut(edges), store


@book.query(
    f"""with {_DROPS}, {CUR_F}, {CUR_C}, h as (select key from n where chunk in (select chunk_id from cc)),
t as (select 'endpoints' as "check", "start" || ' ' || d.type || ' ' || "end" as item from d left join p on p.type = d.type and p.sl = split_part("start", ':', 1) and p.el = split_part("end", ':', 1) where p.type is null union
select 'node_evidence', key from n where key not in (select key from h) union
select 'structure', chunk_id || ' PART_OF' from cc where accession_no is null or accession_no not in (select accession_no from cf) union
select 'postgres_chunks', chunk_id from cc where accession_no is not null and accession_no not in (select accession_no from cf)),
k as (select * from (values {", ".join(f"('{c}')" for c in _CHECKS)}) v("check"))
select k."check", count(item) as findings, array_to_string(list_slice(list_sort(list(item) filter (item is not null)), 1, 3), ' | ') as examples from k left join t using ("check") group by 1"""
)
def graph_validation(spark, d):
    """The checks of a stored graph with counts and the first items."""
    nodes, edges, store = _stored(spark, d)
    return B.validation_report(B.graph_findings(nodes, edges, store), _CHECKS).withColumn("examples", F.when(F.size("examples") > 0, F.array_join("examples", " | ")))


@book.query(f"with {_CAND} select key, min(label) as label, min(name) as name, array_to_string(list_sort(list(distinct file)), ' ') as filings from n group by 1")
def anchor_nodes(spark, d):
    n = _nodes(spark, d)
    nodes = n.groupBy("key").agg(F.min("label").alias("label"), F.min("name").alias("name"))
    return B.anchor_nodes(nodes, n).withColumn("filings", F.array_join("filings", " "))


@book.query(
    f"""with {_DROPS}, r2 as (select chunk, r, null as edge from n union all select chunk, r, type || ' ' || "start" || ' ' || "end" from d where reason is null)
select c.chunk_id as chunk, coalesce(max(r2.r), 0)::int as best, count(distinct r2.edge) as edges from (select distinct chunk_id from chunks where chunk_id is not null) c left join r2 on r2.chunk = c.chunk_id group by 1"""
)
def chunk_confidence(spark, d):
    e = _with_reason(spark, d).where("reason is null").select(F.concat_ws(" ", "type", "start", "end").alias("edge"), "chunk", "confidence")
    c = table(spark, d, "chunks").where("chunk_id is not null").select(F.col("chunk_id").alias("chunk"))
    return B.chunk_confidence(_nodes(spark, d), e, c)


@book.query(
    f"""with {_DROPS}, a as (select key as anchor from n where label = 'Product' group by 1), r2 as (select anchor, chunk, null as edge from a join n on n.key = anchor union select anchor, chunk, type from a join d on d."end" = anchor where reason is null),
l as (select distinct chunk, anchor || ' via ' || coalesce(edge, 'own evidence') as line from r2)
select c.chunk_id as chunk, coalesce(array_to_string(list_sort(list(line) filter (line is not null)), ' | '), '') as support from (select distinct chunk_id from chunks where chunk_id is not null) c left join l on l.chunk = c.chunk_id group by 1"""
)
def support_trace(spark, d):
    n = _nodes(spark, d)
    a = n.where("label = 'Product'").select(F.col("key").alias("anchor"), "chunk", F.lit(None).cast("string").alias("edge"))
    e = _with_reason(spark, d).where("reason is null").join(a.select(F.col("anchor").alias("end")).distinct(), "end").select(F.col("end").alias("anchor"), "chunk", F.col("type").alias("edge"))
    c = table(spark, d, "chunks").where("chunk_id is not null").select(F.col("chunk_id").alias("chunk"))
    return B.support_trace(c, a.unionByName(e).distinct()).withColumn("support", F.array_join("support", " | "))


@book.query(
    f"""with {_DROPS}, o as (select distinct key, chunk from n where label <> 'MetricValue'), w as (select a.key as a, b.key as b, 0 as x from o a join o b on a.chunk = b.chunk and a.key < b.key union all
select least("start", "end"), greatest("start", "end"), 1 from d where reason is null and type <> 'MEASURES')
select a, b, count(*) as weight, sum(x)::bigint as extracted from w group by 1, 2"""
)
def community_weights(spark, d):
    """Undirected weights of the evidence graph: extracted edges and shared chunks."""
    n = _nodes(spark, d).where("label <> 'MetricValue'")
    return B.community_graph(_with_reason(spark, d).where("reason is null"), n)[0]


_WALK = """u as (select distinct a as node, b as other from (select "start" as a, "end" as b from d where reason is null and "start" <> "end" union all select "end", "start" from d where reason is null and "start" <> "end")), an as (select distinct key as anchor from c3 where key like 'Product:%')"""
_CANON = "c3 as (select distinct coalesce(al.canonical, n.key) as key, n.chunk from n left join al on al.key = n.key)"


def _walk(spark, d):
    e = _with_reason(spark, d).where("reason is null")
    nodes = B.canonical(_nodes(spark, d), _alias(spark, d), "key").select("key", "chunk").distinct()
    return nodes, G.undirected(e.select("start", "end"), "start", "end"), nodes.where("key like 'Product:%'").select(F.col("key").alias("anchor")).distinct()


@book.query(
    f"""with {_DROPS}, {_CANON}, {_WALK}, one as (select distinct anchor, other as node from an join u on u.node = anchor where other <> anchor), two as (select distinct one.anchor, u.other as node from one join u on u.node = one.node where u.other <> one.anchor and (one.anchor, u.other) not in (select (anchor, node) from one))
select anchor, anchor as node, 0 as hop from an union all select anchor, node, 1 from one union all select anchor, node, 2 from two"""
)
def evidence_hops(spark, d):
    """Everything within two edges of each product of the evidence graph."""
    _, edges, anchors = _walk(spark, d)
    return G.expand(anchors, edges, 2)


@book.query(
    f"""with {_DROPS}, {_CANON}, {_WALK}, ci as (select an.anchor as node, c3.chunk, null as edge from an join c3 on c3.key = an.anchor union select an.anchor, d.chunk, d.type || ' ' || d."start" || ' ' || d."end" from an join d on (d."start" = an.anchor or d."end" = an.anchor) where d.reason is null),
p2 as (select node, chunk, count(distinct edge) as edges from ci group by 1, 2)
select chunk, round(sum(0.5::double * (1 + edges)), 6) as score, (row_number() over (order by round(sum(0.5::double * (1 + edges)), 9) desc, chunk))::int as rank from p2 group by 1 order by 3 limit 50"""
)
def evidence_rank(spark, d):
    """The fifty chunks that most products and their edges cite, every product at a similarity of 0.5."""
    nodes, _, anchors = _walk(spark, d)
    own = nodes.join(anchors.select(F.col("anchor").alias("key")), "key").select(F.col("key").alias("node"), "chunk", F.lit(None).cast("string").alias("edge"))
    e = _with_reason(spark, d).where("reason is null").select(F.explode(F.array("start", "end")).alias("node"), "chunk", F.concat_ws(" ", "type", "start", "end").alias("edge"))
    citing = own.unionByName(e.join(anchors.select(F.col("anchor").alias("node")), "node", "left_semi")).distinct()
    return G.rank_chunks(anchors.select(F.col("anchor").alias("node"), F.lit(0.5).alias("similarity")), citing, 50).withColumn("score", F.round("score", 6))


def _levels(spark, d):
    n = _nodes(spark, d).where("label <> 'MetricValue'")
    pairs, nodes = B.community_graph(_with_reason(spark, d).where("reason is null"), n)
    return CM.two_level(cut(pairs.select("a", "b", "weight")), nodes.select(F.col("key").alias("node")))


@book.query()
def community_tree(spark, d):
    """Communities of the evidence graph on two levels, by the hash of their members."""
    return CM.tree(cut(_levels(spark, d)))


@book.query(
    f"""with {_CAND}, c as (select distinct split_part(key, ':', 2) as parent, key as child from n where label = 'RiskFactor'), ci as (select distinct key as community, chunk from n where label = 'RiskFactor')
select distinct community, chunk from (select community, chunk from ci union all select parent, chunk from c join ci on ci.community = c.child)"""
)
def children_evidence(spark, d):
    """Chunks of each risk and of the filing it was read in, the parent of all its risks."""
    n = _nodes(spark, d).where("label = 'RiskFactor'")
    return CM.or_children(n.select(F.col("key").alias("community"), "chunk").distinct(), n.select(F.split_part("key", F.lit(":"), F.lit(2)).alias("parent"), F.col("key").alias("child")).distinct())


@book.query(
    f"""with {_CAND}, ci as (select split_part(key, ':', 2) as community, chunk, count(distinct key) as n from n where label <> 'MetricValue' group by 1, 2), o as (select community, chunk, n, row_number() over (partition by community order by n desc, chunk) as place, sum(120) over (partition by community order by n desc, chunk rows unbounded preceding) as total from ci)
select community, chunk, place::int as place from o where total <= 1000 or place = 1"""
)
def report_input(spark, d):
    """The passages each community's report is written from: by citations, as many as fit a budget of 1,000 words at 120 each."""
    n = _nodes(spark, d).where("label <> 'MetricValue'")
    own = n.select(F.split_part("key", F.lit(":"), F.lit(2)).alias("node"), "key", "chunk").distinct()
    ranked = CM.ranked_passages(own.select(F.col("key").alias("node"), F.col("node").alias("community")).distinct(), own.select(F.col("key").alias("a"), F.col("key").alias("b"), "chunk").where("false"), own.select(F.col("key").alias("node"), "chunk"))
    kept = R.budget_prefix(ranked.withColumn("words", F.lit(120)), "community", ["place"], "words", 1000)
    return kept.select("community", "chunk", "place")


@book.query(
    f"""with {_CAND}, m as (select distinct file as community_id, key as node from n where label = 'RiskFactor' and file is not null), c as (select community_id, case when ascii(right(community_id, 1)) % 2 = 0 then 'lower' else 'top' end as level, case when ascii(right(community_id, 1)) % 3 = 0 then 'nowhere' end as parent from m group by 1),
t as (select m.node, c.level from m join c using (community_id) group by 1, 2 having count(*) > 1), ci as (select distinct community_id, chunk from m join n on n.key = m.node)
select 'parent' as "check", community_id as item from c where level = 'lower' or (level = 'top' and parent is not null) union select 'members', node from t union
select 'citation', community_id || ' elsewhere' from c where ascii(right(community_id, 1)) % 4 = 0"""
)
def community_findings(spark, d):
    """The risks of a filing as a community, with broken parents and citations: what the checks find."""
    n = _nodes(spark, d).where("label = 'RiskFactor'")
    m = n.select(F.col("file").alias("community_id"), F.col("key").alias("node")).distinct()
    last = F.ascii(F.expr("right(community_id, 1)"))
    c = m.groupBy("community_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("node"))), 256).alias("member_hash"))
    c = c.select("community_id", F.when(last % 2 == 0, "lower").otherwise("top").alias("level"), F.when(last % 3 == 0, "nowhere").alias("parent"), "member_hash")
    evidence = n.select(F.col("key").alias("node"), "chunk").distinct()
    cited = m.join(evidence, "node").select("community_id", "chunk").unionByName(c.where(last % 4 == 0).select("community_id", F.lit("elsewhere").alias("chunk")))
    return B.community_findings(c, m, cited, evidence)
