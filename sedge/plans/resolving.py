"""Queries for neighbour ranks, equal facts, strata, draws and counters of resolution and links over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.book import Book
from sedge.operators import linking as L
from sedge.operators import resolving as R
from sedge.operators import store as S
from sedge.plans import links as _links
from sedge.plans.evaluation import _COS, _TOP
from sedge.plans.store import CUR_F
from sedge.session import table

book = Book()
QUERIES, SQL = book.queries, book.sql


@book.query(f"with {_TOP} select least(query, vec_id) as a, greatest(query, vec_id) as b, min(rank)::int as rank, round(max(score), 6) as cosine from top group by 1, 2")
def neighbour_ranks(spark, d):
    e = table(spark, d, "embeddings")
    return R.neighbour_ranks(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", None, 10).withColumn("cosine", F.round("cosine", 6))


@book.query(
    f"select q.vec_id as later_key, b.vec_id as earlier_key, round({_COS}, 6) as cosine, (row_number() over (partition by q.vec_id order by {_COS} desc, b.vec_id))::int as rank from embeddings q join embeddings b on q.label = b.label where q.vec_id % 100 = 0 and b.vec_id % 2 = 1 qualify rank <= 5"
)
def earlier_neighbours(spark, d):
    """Of every hundredth vector, as the later item, the five nearest odd ones of its block, as the earlier items."""
    e = table(spark, d, "embeddings")
    return R.earlier_neighbours(e.where("vec_id % 100 = 0"), e.where("vec_id % 2 = 1"), "vec_id", "embedding", "label", 5).withColumn("cosine", F.round("cosine", 6))


@book.query(
    "with f as (select distinct node_key as key, regexp_replace(trim(chunk_id, ' ' || chr(9)), ':[^:]*$', '') as filing, regexp_replace(regexp_extract(node_key, '[^:]*$'), '-[0-9]+$', '') as subject from evidence where label = 'MetricValue' and node_key is not null and chunk_id is not null), "
    "g as (select filing, subject, min(key) as fact_class, count(*) - 1 as links from f group by 1, 2 having count(*) > 1) select key, fact_class, links from f join g using (filing, subject)"
)
def same_facts(spark, d):
    e = table(spark, d, "evidence").where("label = 'MetricValue'")
    filing = F.regexp_replace(F.btrim("chunk_id", F.lit(" \t")), ":[^:]*$", "")
    subject = F.regexp_replace(F.regexp_extract("node_key", "([^:]*)$", 1), "-[0-9]+$", "")
    return R.same_facts(e.select(F.col("node_key").alias("key"), filing.alias("filing"), subject.alias("subject")), "key", ["filing", "subject"])


@book.query(f"with x as ({_links.SQL['candidate_pairs'] if 'candidate_pairs' in _links.SQL else 'select null as key_a, null as key_b, null as rules where false'}) select rule, count(*) as pairs, count(*) filter (rules = rule) as only from (select unnest(string_split(rules, ',')) as rule, rules from x) group by 1")
def rule_counts(spark, d):
    """How many pairs each rule proposes, and proposes alone."""
    return R.rule_counts(L.candidate_pairs(table(spark, d, "resolve_nodes").where("label = 'Organization'")).withColumn("rules", F.split("rules", ",")))


_P = "p as (select distinct coalesce(stratum, 'rest') as stratum, key_a, key_b from pair_labels where key_a is not null and key_b is not null and set_name <> 'persist')"
_X = "x as (select distinct key_a, key_b from pair_labels where set_name = 'persist' and key_a is not null and key_b is not null)"


@book.query(
    f"with {_P}, {_X}, r as (select * from p where (key_a, key_b) not in (select (key_a, key_b) from x)), o as (select *, row_number() over (partition by stratum order by sha256('7' || chr(10) || key_a || chr(10) || key_b), key_a, key_b) as place, count(*) over (partition by stratum) as population from r) "
    "select stratum, key_a, key_b, place::int as place, population from o where place <= case stratum when 'candidate' then 60 when 'near' then 25 when 'rest' then 15 else 0 end"
)
def stratified_pairs(spark, d):
    """A draw of labelled pairs by stratum, without those of another set, and the populations."""
    t = table(spark, d, "pair_labels").where("key_a is not null and key_b is not null")
    pairs = t.where("set_name <> 'persist'").select(F.coalesce("stratum", F.lit("rest")).alias("stratum"), "key_a", "key_b")
    return R.draw_strata(pairs, {"candidate": 60, "near": 25, "rest": 15}, "7", t.where("set_name = 'persist'"))


@book.query(
    "with a as (select distinct answer_id, arm, question_id from answers where question_id is not null and arm is not null), h as (select *, sha256('5' || chr(10) || answer_id::varchar) as h from a), o as (select question_id, arg_min(answer_id, (h, answer_id, arm)) as answer_id, arg_min(arm, (h, answer_id, arm)) as arm, min(h) as h from h group by 1), "
    "t as (select *, row_number() over (partition by arm order by h, answer_id) as turn from o) select answer_id, arm, (row_number() over (order by turn, arm))::int as place from t order by turn, arm limit 30"
)
def round_robin(spark, d):
    """Thirty answers, one an arm in turn, no question twice."""
    a = table(spark, d, "answers").where("arm is not null").select("answer_id", "arm", "question_id").distinct()
    return R.round_robin(a, "arm", "question_id", "answer_id", 30, "5")


@book.query(
    "with e as (select distinct evidence_id, label from evidence where label is not null), h as (select *, sha256('3' || chr(10) || evidence_id::varchar) as h from e), p as (select *, row_number() over (partition by label order by h, evidence_id) as p, case label when 'Product' then 500000 when 'Segment' then 10 when 'RiskFactor' then 5 else 0 end as q from h), "
    "o as (select evidence_id, label, p > q as fallback from p order by p > q, h, evidence_id limit 500015) select * from o"
)
def review_slots(spark, d):
    """Review slots by label; the slots that Product cannot fill go to the others."""
    return R.slots(table(spark, d, "evidence").where("label is not null"), "label", "evidence_id", {"Product": 500_000, "Segment": 10, "RiskFactor": 5}, "3")


_ITEMS = "i as (select distinct regexp_replace(trim(chunk_id, ' ' || chr(9)), ':[^:]*$', '') as filing, node_key as key, regexp_replace(regexp_extract(node_key, '[^:]*$'), '-[0-9]+$', '') as title from evidence where label = 'RiskFactor' and node_key is not null and chunk_id is not null)"


@book.query(
    f"""with {CUR_F}, {_ITEMS}, pa as (select a.accession_no as later, arg_max(b.accession_no, (b.report_date, b.accession_no)) as earlier from cf a join cf b on a.cik = b.cik and b.report_date < a.report_date group by 1),
e1 as (select filing, title, min(key) as k from i group by 1, 2 having count(*) = 1), ex as (select later, count(distinct i.key) as exact from pa join i on i.filing = pa.later join e1 on e1.filing = pa.earlier and e1.title = i.title group by 1), n as (select filing, count(*) as n from i group by 1)
select later, earlier, coalesce(a.n, 0) as later_items, coalesce(b.n, 0) as earlier_items, coalesce(a.n, 0) * coalesce(b.n, 0) as possible, coalesce(exact, 0) as exact, coalesce(a.n, 0) - coalesce(exact, 0) as open
from pa left join n a on a.filing = later left join n b on b.filing = earlier left join ex using (later)"""
)
def link_counts(spark, d):
    """Counters of every filing and the one before it: items, possible pairs, exact links and what is left to decide."""
    pairs = S.previous(table(spark, d, "filings"))
    e = table(spark, d, "evidence").where("label = 'RiskFactor' and node_key is not null and chunk_id is not null")
    filing = F.regexp_replace(F.btrim("chunk_id", F.lit(" \t")), ":[^:]*$", "")
    items = e.select(filing.alias("filing"), F.col("node_key").alias("key"), F.regexp_replace(F.regexp_extract("node_key", "([^:]*)$", 1), "-[0-9]+$", "").alias("title")).distinct()
    one = items.groupBy(F.col("filing").alias("earlier"), "title").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    links = items.withColumnRenamed("filing", "later").join(pairs, "later").join(one, ["earlier", "title"]).select("later", F.col("key").alias("later_key"))
    return R.pair_counts(pairs, items, links)
