"""Queries for extraction checks, question filters, routing, communities, resolution scores and the query guard."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedge.book import Book
from sedge.operators import communities as C
from sedge.operators import extraction as X
from sedge.operators import graph as G
from sedge.operators import questions as Q
from sedge.operators.components import components
from sedge.operators.store import chunk_texts, current_filings
from sedge.plans.store import CUR_F, TEXTS
from sedge.session import table

book = Book()
QUERIES, SQL = book.queries, book.sql
LABELS = ["Product", "Segment", "RiskFactor", "MetricValue"]
_CONF = "lower(confidence) in ('stated', 'implied', 'uncertain')"


def _replies(spark, d):
    """Evidence rows as the replies of an extraction run over the stored chunks: one proposed node each, and an edge between the first two of a chunk."""
    e = table(spark, d, "evidence").where("chunk_id is not null").withColumn("chunk_id", F.btrim("chunk_id", F.lit(" \t"))).select("chunk_id", "evidence_id", "label", "node_key", "span", "confidence").distinct()
    node = F.struct(F.col("node_key").alias("id"), "label", F.col("node_key").alias("name"), F.col("evidence_id").cast("string").alias("value"), F.col("span").alias("evidence_span"), "confidence")
    g = e.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("evidence_id", node.alias("n")))).alias("rows"))
    g = g.join(chunk_texts(table(spark, d, "chunks"), table(spark, d, "filings")).select("chunk_id", "text"), "chunk_id", "left")
    nodes = F.transform("rows", lambda r: r["n"])
    pair = F.struct(F.get(nodes, 0)["id"].alias("start"), F.lit("AFFECTS").alias("type"), F.get(nodes, 1)["id"].alias("end"), F.get(nodes, 0)["evidence_span"].alias("evidence_span"), F.get(nodes, 0)["confidence"].alias("confidence"))
    triples = F.when(F.size("rows") > 1, F.array(pair)).otherwise(F.array().cast("array<struct<start:string,type:string,end:string,evidence_span:string,confidence:string>>"))
    return X.parsed(g.select("chunk_id", "text", F.to_json(F.struct(nodes.alias("nodes"), triples.alias("triples"))).alias("reply")))


_NODES = f"""{TEXTS}, e as (select distinct trim(chunk_id, ' ' || chr(9)) as chunk_id, evidence_id, label, node_key, span, confidence from evidence where chunk_id is not null),
n as (select *, count(*) over (partition by chunk_id, node_key) as twice, row_number() over (partition by chunk_id order by evidence_id, node_key, label, span) as pos from e),
c as (select n.*, case when label not in ('Product', 'Segment', 'RiskFactor', 'MetricValue') or label is null then 'label' when node_key is null or trim(node_key) = '' then 'id' when twice > 1 then 'duplicate_id'
when confidence is null or not {_CONF} then 'confidence' when span is null or trim(span) = '' or coalesce(not contains(ct.text, span), true) then 'span' end as reason from n left join ct using (chunk_id))"""


@book.query(f"with {_NODES} select coalesce(reason, 'ok') as reason, count(*) as n from c group by 1")
def extraction_nodes(spark, d):
    return X.rejections(X.checked_nodes(_replies(spark, d), LABELS))


@book.query(
    f"""with {_NODES}, g as (select chunk_id, node_key, label from c where reason is null), a as (select * from c where pos = 1), b as (select * from c where pos = 2)
select coalesce(case when ga.label is null or gb.label is null then 'endpoint' when ga.label not in ('RiskFactor', 'Product') then 'pair' when a.node_key = b.node_key then 'self_loop' end, 'ok') as reason, count(*) as n
from a join b using (chunk_id) left join g ga on ga.chunk_id = a.chunk_id and ga.node_key = a.node_key left join g gb on gb.chunk_id = b.chunk_id and gb.node_key = b.node_key group by 1"""
)
def extraction_triples(spark, d):
    r = _replies(spark, d)
    allowed = spark.createDataFrame([(a, "AFFECTS", b) for a in ("RiskFactor", "Product") for b in LABELS], "start_label string, type string, end_label string")
    return X.rejections(X.checked_triples(r, X.checked_nodes(r, LABELS), allowed, ["AFFECTS"]))


def _listed(spark, d):
    f = current_filings(table(spark, d, "filings"), ["cik", "form_type", "fiscal_period", "report_date"])
    names = table(spark, d, "filer_entries").groupBy("cik").agg(F.min("ticker").alias("ticker"), F.min("name").alias("name"))  # a fixed, small list
    return f.join(F.broadcast(names), "cik").drop("cik")


@book.query()
def question_filters(spark, d):
    a = table(spark, d, "answers").where("question is not null").select("question_id", "question").distinct()
    return Q.question_filters(a.groupBy("question_id").agg(F.min("question").alias("question")), _listed(spark, d).drop("name"), "question_id", "question", table(spark, d, "filer_entries").select("ticker", "name"))


@book.query(
    f"""with {CUR_F}, n as (select cik, min(ticker) as ticker from filer_entries group by 1), f as (select accession_no, form_type, fiscal_period, report_date, ticker, split_part(fiscal_period, '-', 1) as fy, ascii(right(accession_no, 1)) % 4 as k from cf join n using (cik)),
tot as (select count(*) as total from f), m as (
select q.accession_no as key, f.accession_no as acc from f q join f on f.ticker = q.ticker and f.fy = q.fy where q.k = 0 union all
select q.accession_no, f.accession_no from f q join f on f.ticker = q.ticker and (f.fiscal_period = q.fiscal_period or (q.fiscal_period = q.fy and f.fy = q.fy)) where q.k = 1 union all
select q.accession_no, (select arg_max(x.accession_no, (x.report_date, x.accession_no)) from f x where x.ticker = q.ticker and x.form_type = '10-K') from f q where q.k = 2 union all
select q.accession_no, f.accession_no from f q join f on f.form_type = '10-Q' where q.k = 3),
g as (select key, count(distinct acc) as c, array_to_string(list_sort(list(distinct acc)), ' ') as accessions from m where acc is not null group by 1)
select q.accession_no as key, case when c > 0 and c < total then accessions end as accessions from f q cross join tot left join g on g.key = q.accession_no"""
)
def filters_of_filings(spark, d):
    """A question about each filing, by its company's name or ticker and its year, its period, the latest annual report, or all quarterly ones: the filings its filter selects."""
    f = _listed(spark, d)
    k = F.ascii(F.expr("right(accession_no, 1)")) % 4
    year = F.substring("fiscal_period", 3, 4)
    text = (
        F.when(k == 0, F.concat(F.lit("What did "), "name", F.lit(" report in fiscal "), year, F.lit("?"))).when(k == 1, F.concat(F.lit("What did "), "ticker", F.lit(" say for "), "fiscal_period", F.lit("?")))
        .when(k == 2, F.concat(F.lit("What is in the latest 10-K of "), "ticker", F.lit("?"))).otherwise(F.lit("What do the 10-Q reports say?"))
    )
    got = Q.question_filters(f.select(F.col("accession_no").alias("key"), text.alias("text")), f.drop("name"), "key", "text", f.select("ticker", "name").distinct())
    return got.select("key", F.array_join("accessions", " ").alias("accessions"))


@book.query(
    "select distinct question_id, case class_name when 'lookup' then 'vector' when 'local' then 'graph_local' when 'multi_hop' then 'graph_traversal' when 'global' then 'graph_global' when 'decline' then 'decline' else 'vector' end as arm from answers where question_id is not null"
)
def router_dispatch(spark, d):
    routes = spark.createDataFrame([("lookup", "vector"), ("local", "graph_local"), ("multi_hop", "graph_traversal"), ("global", "graph_global"), ("decline", "decline")], "class_name string, arm string")
    return Q.route(table(spark, d, "answers").where("question_id is not null"), routes, "question_id", "class_name")


@book.query()
def communities(spark, d):
    edges = G.shared_pairs(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")
    return C.records(C.propagate(edges, 3)).select("community_id", "members", "member_hash", "reportable")


@book.query(
    """with x as (select distinct l_suppkey as node, l_orderkey as chunk from lineitem), l as (select s_suppkey as node, s_nationkey as community from supplier), n as (select community, chunk from x join l using (node)),
e as (select distinct l_suppkey as a, lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as b, l_orderkey as chunk from lineitem), i as (select p.community, e.chunk from e join l p on p.node = e.a join l q on q.node = e.b where p.community = q.community),
g as (select community, chunk, count(*) as n from (select * from n union all select * from i) group by 1, 2) select community, chunk, n, place::int as place from (select *, row_number() over (partition by community order by n desc, chunk) as place from g) where place <= 6"""
)
def community_passages(spark, d):
    labels = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("community"))
    cites = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_orderkey").alias("chunk"))
    after = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.lead("l_suppkey").over(after).alias("b"), F.col("l_orderkey").alias("chunk")).where("b is not null")
    return C.ranked_passages(labels, edges, cites).where("place <= 6")


@book.query()
def group_cut(spark, d):
    p = table(spark, d, "pair_labels").where("key_a is not null and key_b is not null and key_a <> key_b and same is not null").select("key_a", "key_b", "same").distinct()
    root = components(p, "key_a", "key_b")
    return C.separate(p.join(root.select(F.col("key").alias("key_a"), "root"), "key_a"), "root")
