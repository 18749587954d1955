"""Queries for candidate pairs, links over time, printed numbers, anchors and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.book import Book
from sedge.functions import text as T
from sedge.operators import linking as K
from sedge.operators import store as S
from sedge.operators import vectors as V
from sedge.plans.store import CUR_F
from sedge.session import table

book = Book()
QUERIES, SQL = book.queries, book.sql
_MK = f"regexp_replace(trim(regexp_replace(replace(regexp_replace(lower(regexp_replace(name, '\\\\([!-/:-@\\[-`{{-~])', '\\1', 'g')), '[.''’]', '', 'g'), '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '^([^ ]+(?: [^ ]+)*?)(?: (?:{T.LEGAL_FORMS}))+$', '\\1')"


@book.query(
    f"""with k as (select distinct {_MK} as k from resolve_nodes where label = 'Organization' and {_MK} <> ''), w as (select distinct k, unnest(string_split(k, ' ')) as word from k),
f as (select word from w where word <> '' group by 1 having count(*) between 2 and 3), o as (select w.* from w join f using (word)),
p as (select a.k as key_a, b.k as key_b, 'rare_word' as rule from o a join o b using (word) where a.k < b.k union
select least(l.k, s.k), greatest(l.k, s.k), 'acronym' from k l join k s on l.k like '% %' and s.k not like '% %' and list_aggregate(list_transform(string_split(l.k, ' '), lambda x: x[1]), 'string_agg', '') = s.k)
select key_a, key_b, string_agg(rule, ',' order by rule) as rules from p group by 1, 2"""
)
def candidate_pairs(spark, d):
    return K.candidate_pairs(table(spark, d, "resolve_nodes").where("label = 'Organization'"))


@book.query()
def candidate_pairs_all(spark, d):
    """Also the pairs of fuzzy score 85 or more; no table holds vectors of names, so the embedding rule is not applied here."""
    return K.candidate_pairs(table(spark, d, "resolve_nodes").where("label = 'Organization'"), fuzzy=85)


_PRINTED = "select l_orderkey, l_linenumber, l_partkey, printf('%.2f', l_extendedprice) as a, printf('%.1f', round(l_extendedprice / 1000 + l_tax, 1)) as b from lineitem"


@book.query(f"select l_orderkey, l_linenumber, l_partkey, abs(a::decimal(20,6) - b::decimal(20,6) * 1000) * 2 <= 100 as agree from ({_PRINTED})")
def unit_agreement(spark, d):
    li = table(spark, d, "lineitem")
    a = F.format_string("%.2f", "l_extendedprice")
    b = F.format_string("%.1f", F.round(F.col("l_extendedprice") / 1000 + F.col("l_tax"), 1))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", K.agree(a, F.lit("usd"), b, F.lit("thousand")).alias("agree"))


def _parts(spark, d):
    """The risk items of each filing by the last words of their key, with the pairs of filings in time."""
    e = table(spark, d, "evidence").where("label = 'RiskFactor' and node_key is not null").select("node_key").distinct()
    p = F.split("node_key", ":")
    items = e.select(F.element_at(p, 2).alias("accession"), F.col("node_key").alias("key"), F.regexp_extract("node_key", r":([a-z]+)-[0-9]+$", 1).alias("title"))
    return items, S.previous(table(spark, d, "filings"))


_LINKS = """i as (select distinct split_part(node_key, ':', 2) as accession, node_key as key, regexp_extract(node_key, ':([a-z]+)-[0-9]+$', 1) as title from evidence where label = 'RiskFactor' and node_key is not null),
f as (select distinct accession_no, cik, report_date from filings), p as (select l.accession_no as later, arg_max(e.accession_no, (e.report_date, e.accession_no)) as earlier from f l join f e on e.cik = l.cik and e.report_date < l.report_date group by 1),
o as (select accession as earlier, title, min(key) as earlier_key from i group by 1, 2 having count(distinct key) = 1)"""


@book.query(f"with {_LINKS} select i.key as later_key, o.earlier_key from i join p on p.later = i.accession join o on o.earlier = p.earlier and o.title = i.title")
def exact_links(spark, d):
    items, pairs = _parts(spark, d)
    return K.exact_links(items, items, pairs)


@book.query(
    f"""with {_LINKS}, x as (select i.key as later_key, o.earlier_key, 'exact' as method, 0 as rank from i join p on p.later = i.accession join o on o.earlier = p.earlier and o.title = i.title
union all select key_a, key_b, 'decided', case stratum when 'candidate' then 1 when 'near' then 2 else 3 end from pair_labels where same and key_a is not null and key_b is not null)
select later_key, earlier_key, method from x qualify row_number() over (partition by later_key order by rank, earlier_key, method) = 1"""
)
def select_predecessor(spark, d):
    items, pairs = _parts(spark, d)
    p = table(spark, d, "pair_labels").where("key_a is not null and key_b is not null")
    rank = F.when(F.col("stratum") == "candidate", 1).when(F.col("stratum") == "near", 2).otherwise(3)
    decided = p.select(F.col("key_a").alias("later_key"), F.col("key_b").alias("earlier_key"), rank.alias("rank"), F.when(F.col("same"), "same").otherwise("distinct").alias("answer"))
    return K.choose_links(K.exact_links(items, items, pairs), decided).distinct()


_COS = "round(list_cosine_similarity(q.embedding::double[], b.embedding::double[]), 9)"


@book.query(
    f"""with c as (select q.vec_id as question, b.vec_id as key, {_COS} as cosine from embeddings q join embeddings b on q.vec_id <> b.vec_id where q.vec_id % 100 = 0 qualify row_number() over (partition by q.vec_id order by cosine desc, b.vec_id) <= 20),
n as (select q.vec_id as question, b.vec_id as key, 90.0 + b.vec_id % 10 as score from embeddings q join embeddings b on q.label = b.label where q.vec_id % 100 = 0 and b.vec_id < 20),
r as (select question, key, true as named, score, 1.0::double as similarity from n union all select question, key, false, 0.0, cosine from c),
m as (select question, key, bool_or(named) as named, max(score) as score, case when bool_or(named) then 1.0 else max(similarity) end as similarity from r group by 1, 2)
select question, key, round(similarity, 6) as similarity, case when named then 'name' else 'embedding' end as how, (row_number() over (partition by question order by named desc, score desc, similarity desc, key))::int as place from m qualify place <= 20"""
)
def question_anchors(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0")
    top = V.top_k(e, asked, 20, "vec_id", "embedding").select(F.col("query").alias("question"), F.col("vec_id").alias("key"), F.col("score").alias("cosine"))
    named = asked.select(F.col("vec_id").alias("question"), "label").join(e.where("vec_id < 20").select(F.col("vec_id").alias("key"), "label"), "label").select("question", "key", (90.0 + F.col("key") % 10).alias("score"))
    return K.anchors(named, top, 20).withColumn("similarity", F.round("similarity", 6))


@book.query()
def named_anchors(spark, d):
    """The filers named in the questions of all answers (fuzzy ratio 90 or more); ``question_anchors`` ranks made-up scores, as its SQL has no such ratio."""
    asked = table(spark, d, "answers").select(F.col("question").alias("question"), F.col("question").alias("text"))
    names = table(spark, d, "resolve_nodes").where("label = 'Organization'").select("name").unionByName(table(spark, d, "filer_entries").select("name")).select(T.match_key(F.col("name")).alias("key"), "name")
    return K.named_in(asked, names)


_SCORE = "s as (select b.vec_id as chunk, round(list_cosine_similarity(q.embedding::double[], b.embedding::double[]), 6) as score, b.label from embeddings b, (select embedding from embeddings where vec_id = 0) q)"


def _shown(spark, d):
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)  # one row
    s = e.join(F.broadcast(one)).select(F.col("vec_id").alias("chunk"), F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return K.shown_chunks(e.select(F.col("label").alias("community"), F.col("vec_id").alias("chunk")), s, 6, 10)


@book.query(f"with {_SCORE} select label as community, chunk, score, (row_number() over (partition by label order by score desc, chunk))::int as place from s qualify place <= 6")
def shown_chunks(spark, d):
    return _shown(spark, d)[0].select("community", "chunk", "score", "place")


@book.query(f"with {_SCORE}, t as (select *, row_number() over (partition by label order by score desc, chunk) as place from s qualify place <= 6) select chunk, max(score) as score from t group by 1 order by 2 desc, 1 limit 10")
def handoff_chunks(spark, d):
    return _shown(spark, d)[1]


@book.query(
    "with a as (select arm, class_name, avg((status = 'answered')::int) as m from answers where run_file like '%1%' group by 1, 2), b as (select arm, class_name, avg((status = 'answered')::int) as m from answers where run_file not like '%1%' group by 1, 2) "
    "select arm, class_name, round(a.m, 9) as before, round(b.m, 9) as after, case when a.arm is null then 'added' when b.arm is null then 'lost' when round(a.m, 9) is not distinct from round(b.m, 9) then 'same' when b.m > coalesce(a.m, '-infinity') then 'better' else 'worse' end as verdict from a full join b using (arm, class_name)"
)
def quality_gate(spark, d):
    a = table(spark, d, "answers").withColumn("ok", (F.col("status") == "answered").cast("int"))
    side = lambda x: x.groupBy("arm", "class_name").agg(F.avg("ok").alias("m"))
    one = F.col("run_file").contains("1")
    return K.gate(side(a.where(one)), side(a.where(~one)), ["arm", "class_name"], "m")


@book.query(f"with {CUR_F} select c.chunk_id, c.accession_no is not null as named, f.accession_no is not null as has_filing, f.cik = c.cik as same_company, f.form_type = c.form_type as same_form, f.fiscal_period = c.fiscal_period as same_period from (select distinct chunk_id, trim(accession_no, ' ' || chr(9)) as accession_no, cik, form_type, fiscal_period from chunks) c left join cf f using (accession_no)")
def chunk_filing_checks(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", F.btrim("accession_no", F.lit(" \t")).alias("accession_no"), "cik", "form_type", "fiscal_period").distinct()
    f = S.current_filings(table(spark, d, "filings"), ["cik", "form_type", "fiscal_period"]).select("accession_no", F.col("cik").alias("fc"), F.col("form_type").alias("ff"), F.col("fiscal_period").alias("fp"), F.lit(True).alias("hit"))
    return c.join(f, "accession_no", "left").select(
        "chunk_id", F.col("accession_no").isNotNull().alias("named"), F.col("hit").isNotNull().alias("has_filing"), (F.col("fc") == F.col("cik")).alias("same_company"), (F.col("ff") == F.col("form_type")).alias("same_form"),
        (F.col("fp") == F.col("fiscal_period")).alias("same_period"),
    )
