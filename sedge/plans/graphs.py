"""Queries for the evidence graph, components and resolution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedge.book import Book
from sedge.functions import text as T
from sedge.operators import graph as G
from sedge.operators import store as S
from sedge.operators.components import components
from sedge.plans.store import CUR_C, CUR_F
from sedge.session import table

book = Book()
QUERIES, SQL = book.queries, book.sql
_RANK = "case lower(trim(confidence)) when 'stated' then 3 when 'implied' then 2 when 'uncertain' then 1 else 0 end"
_BEST = (
    f"e as (select * replace (trim(chunk_id, ' ' || chr(9)) as chunk_id), {_RANK} as r from evidence), "
    "be as (select *, count(*) over (partition by node_key, chunk_id) as entries from e where node_key is not null and chunk_id is not null qualify row_number() over (partition by node_key, chunk_id order by r desc, extracted_at desc, evidence_id desc) = 1)"
)
_HOP = "u as (select 's' || l_suppkey as node, 'p' || l_partkey as other from lineitem union select 'p' || l_partkey, 's' || l_suppkey from lineitem)"


@book.query(f"with {_BEST} select node_key, chunk_id, label, confidence, entries from be")
def evidence_merge(spark, d):
    return G.best_evidence(table(spark, d, "evidence")).select("node_key", "chunk_id", "label", "confidence", "entries")


@book.query(f"with {_BEST} select node_key, arg_max(label, chunk_id) as label, count(*) as chunks, max(r) as best, count(distinct regexp_replace(chunk_id, ':[^:]*$', '')) as filings from be group by 1")
def graph_nodes(spark, d):
    return G.nodes(table(spark, d, "evidence"))


@book.query(
    f"with {CUR_F} select 'FILED' as type, 'Company:' || cik as a, 'Filing:' || accession_no as b from cf union all select 'COVERS_PERIOD', 'Filing:' || accession_no, 'Period:' || cik || ':' || fiscal_period from cf"
)
def structural_edges(spark, d):
    f = S.current_filings(table(spark, d, "filings"), ["cik", "fiscal_period", "company_name", "filing_date"])
    filing = F.concat(F.lit("Filing:"), "accession_no")
    filed = f.select(F.lit("FILED").alias("type"), F.concat(F.lit("Company:"), "cik").alias("a"), filing.alias("b"))
    return filed.unionByName(f.select(F.lit("COVERS_PERIOD").alias("type"), filing.alias("a"), F.concat(F.lit("Period:"), "cik", F.lit(":"), "fiscal_period").alias("b")))


@book.query(f"with {CUR_F} select cik, arg_max(company_name, (filing_date, accession_no)) as company_name, count(*) as filings from cf group by 1")
def company_nodes(spark, d):
    f = S.current_filings(table(spark, d, "filings"), ["cik", "fiscal_period", "company_name", "filing_date"])
    return f.groupBy("cik").agg(F.max_by("company_name", F.struct("filing_date", "accession_no")).alias("company_name"), F.count(F.lit(1)).alias("filings"))


@book.query(
    f"""with e as (select *, trim(chunk_id, ' ' || chr(9)) as c, evidence_id::varchar as item, {_RANK} as r from evidence)
select distinct item, rule from (
select item, 'blank_key' as rule from e where node_key is null or trim(node_key) = '' union all
select item, 'blank_span' from e where span is null or trim(span) = '' union all
select item, 'unknown_confidence' from e where r = 0 union all
select item, 'label_mismatch' from e where not starts_with(node_key, label || ':') union all
select item, 'unscoped_key' from e where not regexp_matches(node_key, '^[A-Za-z]+:[0-9]{{10}}-[0-9]{{2}}-[0-9]{{6}}:') union all
select item, 'unknown_chunk' from e where c is not null and c not in (select chunk_id from chunks where chunk_id is not null) union all
select item, 'repeated_evidence' from e where c is not null group by item having count(distinct c) > 1)"""
)
def graph_checks(spark, d):
    return G.violations(table(spark, d, "evidence"), table(spark, d, "chunks"))


@book.query("select label, count(distinct node_key) as nodes, count(*) as evidence from evidence group by 1")
def graph_counts(spark, d):
    return table(spark, d, "evidence").groupBy("label").agg(F.count_distinct("node_key").alias("nodes"), F.count(F.lit(1)).alias("evidence"))


def _anchors(spark, d):
    return table(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(5).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("anchor"))


def _edges(spark, d):
    ends = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p")).distinct()
    return G.undirected(ends, "s", "p")


_ANCHOR = "a as (select 's' || s_suppkey as anchor from supplier order by s_acctbal desc, s_suppkey limit 5)"


@book.query(f"with {_ANCHOR}, {_HOP} select anchor, anchor as node, 0 as hop from a union all select distinct anchor, other, 1 from a join u on u.node = a.anchor")
def hop1(spark, d):
    return G.expand(_anchors(spark, d), _edges(spark, d), 1)


@book.query(
    f"with {_ANCHOR}, {_HOP}, one as (select distinct anchor, other as node from a join u on u.node = a.anchor) select anchor, anchor as node, 0 as hop from a union all select anchor, node, 1 from one union all "
    "select distinct one.anchor, u.other, 2 from one join u on u.node = one.node where u.other <> one.anchor and (one.anchor, u.other) not in (select (anchor, node) from one)"
)
def hop2(spark, d):
    return G.expand(_anchors(spark, d), _edges(spark, d), 2)


@book.query(
    "with a as (select s_suppkey as node, round(1.0 / (1 + rank() over (order by s_acctbal desc, s_suppkey)), 6)::double as similarity from supplier order by s_acctbal desc, s_suppkey limit 20), "
    "p as (select l_suppkey as node, l_orderkey as chunk, count(distinct l_partkey) as edges from lineitem group by 1, 2) "
    "select chunk, round(sum(similarity * (1 + edges)), 6) as score, (row_number() over (order by round(sum(similarity * (1 + edges)), 9) desc, chunk))::int as rank from p join a using (node) group by 1 order by 3 limit 50"
)
def chunk_rank(spark, d):
    top = table(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20)
    place = F.row_number().over(Window.orderBy(F.desc("s_acctbal"), "s_suppkey"))
    anchors = top.select(F.col("s_suppkey").alias("node"), F.round(1 / (1 + place), 6).alias("similarity"))
    citing = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("edge"))
    return G.rank_chunks(anchors, citing, 50).withColumn("score", F.round("score", 6))


@book.query("with m as (select distinct l_orderkey, l_suppkey from lineitem) select x.l_suppkey as a, y.l_suppkey as b, count(*) as weight from m x join m y on x.l_orderkey = y.l_orderkey and x.l_suppkey < y.l_suppkey group by 1, 2")
def cooccurrence_graph(spark, d):
    return G.shared_pairs(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@book.query(
    f"with {_BEST}, r as (select label, dense_rank() over (order by label) as k from (select distinct label from evidence where label is not null)) "
    "select c.chunk_id as chunk, c.node_key as citation, (select arg_min(label, (k, label)) from r where label in (select b.label from be b where b.chunk_id = c.chunk_id)) as via from be c"
)
def provenance(spark, d):
    e = G.best_evidence(table(spark, d, "evidence"))
    held = e.select(F.col("chunk_id").alias("chunk"), F.col("label").alias("via"), F.col("label").alias("rank"), F.lit(False).alias("by_edge")).where("via is not null")
    return G.first_provenance(e.select(F.col("node_key").alias("citation"), F.col("chunk_id").alias("chunk")), held)


@book.query(
    f"with {CUR_C}, w as (select *, max(char_end) over (partition by accession_no order by char_start, char_end, chunk_id rows between unbounded preceding and 1 preceding) as e from cc) "
    "select chunk_id, least(e, char_end) - char_start as overlap from w where e > char_start"
)
def overlapping_chunks(spark, d):
    return G.overlapping(S.current_chunks(table(spark, d, "chunks")), "accession_no", "chunk_id", "char_start", "char_end")


@book.query(
    """with recursive e as (select key_a as a, key_b as b from pair_labels where same and key_a is not null and key_b is not null and key_a <> key_b union select key_b, key_a from pair_labels where same and key_a is not null and key_b is not null and key_a <> key_b),
r as (select a as k, a as o from e union select r.k, e.b from r join e on e.a = r.o) select k as key, min(o) as root from r group by 1"""
)
def label_components(spark, d):
    return components(table(spark, d, "pair_labels").where("same"), "key_a", "key_b")


@book.query(
    """with p as (select least(key_a, key_b) as a, greatest(key_a, key_b) as b, count(*) filter (where same) as yes, count(*) filter (where not same) as no from pair_labels where key_a is not null and key_b is not null and key_a <> key_b group by 1, 2)
select case when yes > 0 and no > 0 then 'contradicting' when yes > 0 then 'same' when no > 0 then 'different' else 'open' end as verdict, count(*) as pairs from p group by 1"""
)
def pair_verdicts(spark, d):
    p = table(spark, d, "pair_labels").where("key_a is not null and key_b is not null and key_a <> key_b")
    g = p.groupBy(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).agg(F.count_if("same").alias("yes"), F.count_if(~F.col("same")).alias("no"))
    verdict = F.when((F.col("yes") > 0) & (F.col("no") > 0), "contradicting").when(F.col("yes") > 0, "same").when(F.col("no") > 0, "different").otherwise("open")
    return g.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("pairs"))


_MK = f"regexp_replace(trim(regexp_replace(replace(regexp_replace(lower(regexp_replace(name, '\\\\([!-/:-@\\[-`{{-~])', '\\1', 'g')), '[.''’]', '', 'g'), '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '^([^ ]+(?: [^ ]+)*?)(?: (?:{T.LEGAL_FORMS}))+$', '\\1')"


@book.query(f"select {_MK} as key, min(node_id) as canonical, count(*) as members from resolve_nodes where label = 'Organization' and name is not null group by 1 having count(*) > 1")
def rule_merges(spark, d):
    n = table(spark, d, "resolve_nodes").where("label = 'Organization' and name is not null")
    return n.groupBy(T.match_key(F.col("name")).alias("key")).agg(F.min("node_id").alias("canonical"), F.count(F.lit(1)).alias("members")).where("members > 1")


@book.query(f"with n as (select node_id, {_MK} as k from resolve_nodes where label = 'Organization'), e as (select entry_id, {_MK} as k from filer_entries) select node_id, entry_id from n join e using (k) where k <> ''")
def filer_merges(spark, d):
    n = table(spark, d, "resolve_nodes").where("label = 'Organization'").select("node_id", T.match_key(F.col("name")).alias("k"))
    return n.join(table(spark, d, "filer_entries").select("entry_id", T.match_key(F.col("name")).alias("k")), "k").where("k <> ''").select("node_id", "entry_id")


@book.query(f"with w as (select distinct node_id, unnest(string_split({_MK}, ' ')) as word from resolve_nodes where label = 'Organization') select word, count(*) as n from w where word <> '' group by 1 having count(*) <= 2")
def rare_words(spark, d):
    n = table(spark, d, "resolve_nodes").where("label = 'Organization'")
    w = n.select("node_id", F.explode(F.split(T.match_key(F.col("name")), " ")).alias("word")).where("word <> ''").distinct()
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n <= 2")
