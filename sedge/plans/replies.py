"""Queries for extraction runs, merged figures, map and report replies, routing maps and corruptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.book import Book
from sedge.operators import extraction as X
from sedge.operators import replies as R
from sedge.operators import store as S
from sedge.plans.pipelines import _NODES, LABELS, _replies
from sedge.plans.store import CUR_C
from sedge.session import cut, table

book = Book()
QUERIES, SQL = book.queries, book.sql


def _checked(spark, d):
    return X.checked_nodes(_replies(spark, d), LABELS)


def _measures(nodes):
    """A MEASURES triple from each metric of a reply to the reply's node after it by position, sound or not."""
    from pyspark.sql import Window

    after = Window.partitionBy("chunk_id").orderBy("pos")
    return nodes.withColumn("end", F.lead("id").over(after)).where("label = 'MetricValue'").select("chunk_id", F.col("id").alias("start"), F.lit("MEASURES").alias("type"), "end")


@book.query(
    f"""with {_NODES}, m as (select distinct chunk_id, node_key as id, e2 as "end" from (select *, lead(node_key) over (partition by chunk_id order by pos) as e2 from c) where label = 'MetricValue' and e2 is not null), so as (select distinct chunk_id, node_key, label from c where reason is null),
p as (select m.chunk_id, m.id, count(*) filter (so.label in ('Company', 'Segment', 'MarketPlatform', 'Product')) as n, min(m."end") filter (so.label in ('Company', 'Segment', 'MarketPlatform', 'Product')) as subject, count(*) filter (so.label is null) as lost from m left join so on so.chunk_id = m.chunk_id and so.node_key = m."end" group by 1, 2),
k as (select distinct chunk_id, node_key as id from c where reason is null and label = 'MetricValue')
select chunk_id, id, case when coalesce(n, 0) = 1 then subject end as subject, case when coalesce(n, 0) = 0 and coalesce(lost, 0) > 0 then 'endpoint_node_rejected' when coalesce(n, 0) <> 1 then 'missing_property' end as reason from k left join p using (chunk_id, id)"""
)
def metric_subjects(spark, d):
    n = cut(_checked(spark, d))
    return R.metric_subjects(n, _measures(n))


@book.query(
    f"""with {_NODES} select chunk_id, node_key as id, 'name_not_in_span' as flag from c where reason is null and not contains(trim(regexp_replace(lower(span), '\\s+', ' ', 'g')), trim(regexp_replace(lower(node_key), '\\s+', ' ', 'g')))
union all select chunk_id, node_key, 'uncertain' from c where reason is null and lower(trim(confidence)) = 'uncertain'"""
)
def node_flags(spark, d):
    return R.node_flags(_checked(spark, d))


@book.query(
    f"""with {_NODES}, f as (select regexp_replace(chunk_id, ':[^:]*$', '') as filing, chunk_id, reason from c) select filing, count(distinct chunk_id) as chunks, 0::bigint as failed, count(*) filter (reason is null) as accepted, count(*) filter (reason is not null) as rejected, count(*) filter (reason is not null) = 0 as complete from f group by 1"""
)
def filing_outcomes(spark, d):
    r = _replies(spark, d)
    return R.filing_outcomes(r, X.checked_nodes(r, LABELS))


@book.query(
    f"""with {_NODES}, b as (select reason, chunk_id || ' ' || coalesce(node_key, '?') as item from c where reason is not null) select reason, count(*) as n, count(*) / (select count(*) from c) as rate, array_to_string(list_slice(list_sort(list(distinct item)), 1, 3), ' | ') as examples from b group by 1"""
)
def rejection_report(spark, d):
    return R.rejection_report(_checked(spark, d))


@book.query(
    "with r as (select lower(trim(confidence)) as confidence, span is not null as ok, evidence_id % 60 as seconds from evidence where confidence is not null), g as (select confidence, count(*) as n, count(*) filter (ok) as k, quantile_cont(seconds, 0.5) as median_seconds from r group by 1), c as (select *, 1.959963984540054 as z, k / n as p from g) "
    "select confidence, n, k as \"right\", p as accuracy, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) as low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) as high, median_seconds from c"
)
def review_summary(spark, d):
    """Accuracy by confidence of a review in which a row is right when it quotes a span."""
    e = table(spark, d, "evidence").where("confidence is not null")
    x = R.review_summary(e.select(F.lower(F.trim("confidence")).alias("confidence"), F.col("span").isNotNull().alias("right"), (F.col("evidence_id") % 60).alias("seconds")))
    return x.withColumns({c: F.round(c, 9) for c in ("low", "high")})


@book.query()
def merged_figures(spark, d):
    """The first decimal number of each metric's spans, in millions, merged over its chunks."""
    e = table(spark, d, "evidence").where("label = 'MetricValue' and chunk_id is not null")
    value = F.regexp_extract("span", r"([0-9][0-9,]*\.[0-9]+)", 1)
    rows = e.select(F.col("node_key").alias("key"), F.nullif(value, F.lit("")).alias("value"), F.lit("million").alias("unit"), "confidence", F.btrim("chunk_id", F.lit(" \t")).alias("chunk"), F.col("extracted_at").alias("at"), F.col("evidence_id").alias("id"))
    return R.merged_figures(rows.distinct())


_POINTS = f"""{CUR_C}, g as (select accession_no as community, fiscal_period, chunk_id, ordinal, row_number() over (partition by accession_no order by chunk_id) as pos from cc where accession_no is not null),
p as (select community, (pos - 1)::int as pos, case when pos % 7 = 0 then '' else 'point ' || chunk_id end as text, (ordinal % 120)::varchar as s, case when pos % 5 = 0 then 'elsewhere' else chunk_id end as cited from g),
q as (select community, pos, text, case when regexp_matches(s, '^(?:[0-9]|[1-9][0-9]|100)$') then s::int end as score, cited from p),
r as (select community, pos, text, score, case when trim(text) = '' then 'text' when score is null then 'score' when cited = 'elsewhere' then 'not_shown' end as reason from q)"""


def _points(spark, d):
    from pyspark.sql import Window

    c = S.current_chunks(table(spark, d, "chunks")).where("accession_no is not null").withColumn("pos", F.row_number().over(Window.partitionBy("accession_no").orderBy("chunk_id")))
    point = F.struct(
        F.when(F.col("pos") % 7 == 0, "").otherwise(F.concat(F.lit("point "), "chunk_id")).alias("text"), (F.col("ordinal") % 120).cast("string").alias("score"), F.array(F.when(F.col("pos") % 5 == 0, "elsewhere").otherwise(F.col("chunk_id"))).alias("chunk_ids")
    )
    replies = c.groupBy(F.col("accession_no").alias("community")).agg(F.sort_array(F.collect_list(F.struct("pos", point.alias("p")))).alias("x")).select("community", F.to_json(F.struct(F.col("x.p").alias("points"))).alias("reply"))
    return R.map_points(replies, c.select(F.col("accession_no").alias("community"), F.col("chunk_id").alias("chunk")))


@book.query(f"with {_POINTS} select * from r")
def map_points(spark, d):
    """A reply about each filing, a point a chunk, with faults of each kind."""
    return _points(spark, d)


@book.query(
    f"with {_POINTS}, o as (select *, row_number() over (order by score desc, community, pos) as place, sum(2) over (order by score desc, community, pos rows unbounded preceding) as total from r where reason is null and score > 0) select community, pos, score, place::int as place from o where total <= 40 or place = 1"
)
def reduced_points(spark, d):
    return R.reduced_points(_points(spark, d), 40)


@book.query(
    f"""with {CUR_C}, m as (select distinct section, chunk_id from cc where section is not null), f as (select coalesce(section, 'none') as community, chunk_id as finding, case when ordinal % 4 = 0 then null when ordinal % 3 = 0 then 'elsewhere' else chunk_id end as c from cc)
select community, finding, case when c is null then 'uncited' else 'foreign' end as reason from f where c is null or (community, c) not in (select (section, chunk_id) from m)"""
)
def report_problems(spark, d):
    c = S.current_chunks(table(spark, d, "chunks"))
    cited = F.when(F.col("ordinal") % 4 == 0, F.array().cast("array<string>")).when(F.col("ordinal") % 3 == 0, F.array(F.lit("elsewhere"))).otherwise(F.array("chunk_id"))
    reports = c.select(F.coalesce("section", F.lit("none")).alias("community"), F.col("chunk_id").alias("finding"), cited.alias("chunks"))
    return R.report_problems(reports, c.where("section is not null").select(F.col("section").alias("community"), F.col("chunk_id").alias("chunk")))


@book.query(
    """with r as (select distinct class_name, arm from answers where class_name is not null and arm is not null), l as (select unnest(['lookup', 'local', 'multi_hop', 'global', 'decline', 'compare']) as class_name), g as (select class_name, count(distinct arm) as n, bool_or(arm not in ('vector', 'graph_local', 'traversal', 'graph_global')) as bad from r group by 1)
select l.class_name, 'missing' as reason from l where class_name not in (select class_name from g) union all select class_name, 'unknown_class' from g where class_name not in (select class_name from l) union all select class_name, 'several' from g where n > 1 union all
select class_name, 'unknown_arm' from g where bad union all select class_name, 'answered' from r where class_name = 'decline' and arm <> 'decline' group by 1"""
)
def routing_problems(spark, d):
    """The classes and arms of the answers read as a routing map."""
    r = table(spark, d, "answers").where("class_name is not null and arm is not null").select("class_name", "arm").distinct()
    return R.routing_problems(r, ["lookup", "local", "multi_hop", "global", "decline", "compare"], ["vector", "graph_local", "traversal", "graph_global"])


_OUT = "case stop_reason when 'end_turn' then case when status = 'answered' then 'ok' else 'empty' end when 'max_tokens' then 'timeout' when 'refusal' then 'invalid' else 'error' end"


@book.query(
    f"""with a as (select question_id as question, {_OUT} as outcome, row_number() over (partition by question_id order by answered_at, answer_id, arm, outcome) as attempt from (select distinct question_id, stop_reason, status, answered_at, answer_id, arm, {_OUT} as outcome from answers where question_id is not null and arm = 'traversal')),
k as (select * from a where attempt <= 2) select question, arg_min(outcome, ((outcome <> 'ok')::int, -attempt)) as outcome, max(attempt) > 1 as repaired, arg_min(outcome, ((outcome <> 'ok')::int, -attempt)) <> 'ok' as fallback from k group by 1"""
)
def traversal_outcomes(spark, d):
    """Answers of the traversal arm as the attempts of its questions."""
    from pyspark.sql import Window

    a = table(spark, d, "answers").where("question_id is not null and arm = 'traversal'").select("question_id", "stop_reason", "status", "answered_at", "answer_id", "arm").distinct()
    outcome = F.when(F.col("stop_reason") == "end_turn", F.when(F.col("status") == "answered", "ok").otherwise("empty")).when(F.col("stop_reason") == "max_tokens", "timeout").when(F.col("stop_reason") == "refusal", "invalid").otherwise("error")
    order = Window.partitionBy("question_id").orderBy("answered_at", "answer_id", "arm", "outcome")
    return R.traversal_outcomes(a.withColumn("outcome", outcome).withColumn("attempt", F.row_number().over(order)).select(F.col("question_id").alias("question"), "attempt", "outcome"))


@book.query(
    f"""with {CUR_C}, s as (select section as community, dense_rank() over (order by section) as rank, chunk_id as chunk, (ordinal % 10)::double as score from cc where section is not null qualify row_number() over (partition by section order by ordinal % 10 desc, chunk_id) <= 6) select chunk, community, (row_number() over (order by rank, -score, chunk))::int as place from s"""
)
def first_shown(spark, d):
    from pyspark.sql import Window

    best = Window.partitionBy("section").orderBy(F.desc(F.col("ordinal") % 10), "chunk_id")
    c = S.current_chunks(table(spark, d, "chunks")).where("section is not null").withColumn("n", F.row_number().over(best)).where("n <= 6")  # what is shown of each
    ranks = c.select("section").distinct().withColumn("rank", F.row_number().over(Window.orderBy("section")))  # over the sections, a short list
    return R.first_shown(c.join(F.broadcast(ranks), "section").select(F.col("section").alias("community"), "rank", F.col("chunk_id").alias("chunk"), (F.col("ordinal") % 10).cast("double").alias("score")))


_VERB = "\\b(is|are|was|were|has|have|will|can)\\b"


@book.query(
    f"""with s as (select distinct answer_id, pos, x.text as t from (select answer_id, unnest(kept) as x, generate_subscripts(kept, 1) as pos from answers where kept is not null) where x.text is not null),
k as (select unnest([{{'kind': 'number', 'ok': regexp_matches(t, '\\p{{Nd}}')}}, {{'kind': 'negation', 'ok': len(regexp_extract_all(t, '{_VERB}')) > len(regexp_extract_all(t, '{_VERB} not'))}}, {{'kind': 'citation', 'ok': regexp_matches(t, '\\[[^\\[\\]\\n]+\\]')}}, {{'kind': 'half', 'ok': len(regexp_extract_all(t, '\\S+')) >= 6}}]) as u from s)
select u.kind as kind, count(*) filter (u.ok) as made, count(*) filter (not u.ok) as skipped from k group by 1"""
)
def corruption_counts(spark, d):
    """How many kept sentences each corruptor applies to, and skips."""
    a = table(spark, d, "answers").where("kept is not null").select("answer_id", F.posexplode("kept").alias("at", "s"))
    others = F.array(F.lit("0000000000-00-000000:0000"), F.lit("0000000000-00-000000:0001"))
    rows = a.select(F.concat_ws(":", F.col("answer_id").cast("string"), F.col("at").cast("string")).alias("key"), F.col("s.text").alias("text"), others.alias("others")).distinct()
    return R.corrupted(rows, "key", "text", "others").groupBy("kind").agg(F.count_if(F.col("text").isNotNull()).alias("made"), F.count_if(F.col("text").isNull()).alias("skipped"))


_ESC = "replace(replace(lower(trim({0})), '%', '%25'), ':', '%3A')"


@book.query(f"select distinct evidence_id, 'MetricValue:' || {_ESC.format('chunk_id')} || ':' || {_ESC.format('node_key')} || ':revenue:million:' || year(extracted_at) as metric_key from evidence where label = 'MetricValue' and node_key is not null and chunk_id is not null and extracted_at is not null and not contains(chunk_id, chr(9))")
def metric_keys(spark, d):
    e = table(spark, d, "evidence").where("label = 'MetricValue' and node_key is not null and chunk_id is not null and extracted_at is not null and not contains(chunk_id, '\t')")
    return e.select("evidence_id", R.metric_key(F.col("chunk_id"), F.col("node_key"), F.lit("Revenue"), F.lit("million"), F.year("extracted_at").cast("string")).alias("metric_key")).distinct()


@book.query(
    "with f as (select lower(trim(name)) as k, min(cik) as cik from filer_entries where name is not null and cik is not null group by 1) select distinct node_id, case when lower(trim(n.name)) in ('company', 'the company', 'registrant', 'the registrant', 'filer', 'we', 'us') then 'Company:0' else 'Company:' || f.cik end as company from resolve_nodes n left join f on f.k = lower(trim(n.name)) where n.name is not null"
)
def filer_references(spark, d):
    """Names of nodes as references to filers; the names of filers are a fixed, small list."""
    f = table(spark, d, "filer_entries").where("name is not null and cik is not null").groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min("cik").alias("cik"))
    names = f.agg(F.map_from_entries(F.collect_list(F.struct("k", "cik"))).alias("names"))
    n = table(spark, d, "resolve_nodes").where("name is not null").select("node_id", "name").distinct().join(F.broadcast(names))
    return n.select("node_id", R.filer_reference(F.col("name"), F.lit("0"), F.col("names")).alias("company"))


@book.query("select distinct node_id, case when trim(name) <> '' then label || ': ' || trim(name) end as text from resolve_nodes")
def node_texts(spark, d):
    n = table(spark, d, "resolve_nodes")
    return n.select("node_id", R.node_text(F.col("label"), F.col("name"), F.lit(None).cast("string")).alias("text")).distinct()
