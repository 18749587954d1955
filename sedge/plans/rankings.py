"""Queries for rankings, budgets, draws, set operations, joins and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.book import Book
from sedge.operators import ranking as R
from sedge.operators.store import current_filings
from sedge.plans.store import CUR_F
from sedge.session import table

book = Book()
QUERIES, SQL = book.queries, book.sql


@book.query("select user_id, event_type, round(1.0 / rank, 6)::double as score, rank::int as rank from (select user_id, event_type, row_number() over (partition by user_id order by min((ts, event_id)), event_type) as rank from events group by 1, 2) where rank <= 3")
def ranked_first_seen(spark, d):
    return R.first_seen(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], 3)


@book.query(
    "with s as (select l_orderkey, l_linenumber, l_quantity, row_number() over w as n, sum(l_quantity) over w as run from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey rows unbounded preceding)), "
    "o as (select *, max((run > 80)::int) over (partition by l_orderkey order by n rows unbounded preceding) as over from s) select l_orderkey, l_linenumber, l_quantity from o where over = 0 or n = 1"
)
def budget_prefix(spark, d):
    return R.budget_prefix(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], "l_quantity", 80).select("l_orderkey", "l_linenumber", "l_quantity")


@book.query(
    """with l as (select l_orderkey as o, l_partkey * 100 + l_linenumber as key, l_quantity::bigint as q, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity::bigint) as n from lineitem),
g as (select o, list(struct_pack(k := key, s := q) order by n) as line from l group by 1)
select o as l_orderkey, unnest(list_reduce(list_prepend({'used': 0::bigint, 'kept': []::bigint[]}, list_transform(line, lambda x: {'used': x.s, 'kept': [x.k::bigint]})),
lambda acc, x: case when len(acc.kept) = 0 or acc.used + x.used <= 80 then {'used': acc.used + x.used, 'kept': list_concat(acc.kept, x.kept)} else acc end).kept) as key from g"""
)
def budget_skip(spark, d):
    rows = table(spark, d, "lineitem").withColumn("key", F.col("l_partkey") * 100 + F.col("l_linenumber"))
    return R.budget_skip(rows, "l_orderkey", "key", ["l_linenumber", "l_partkey"], "l_quantity", 80)


@book.query(
    "with c as (select o_orderpriority as p, count(*) as n from orders group by 1), s as (select p, n, unnest(range(least(n, 40))) as seat from c), "
    "w as (select p from s order by (case when seat = 0 then 'infinity'::double else n / (seat + 1) end) desc, n desc, p limit 40) select p as o_orderpriority, count(*) as seats from w group by 1"
)
def quotas(spark, d):
    return R.quotas(table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")), "o_orderpriority", "n", 40)


@book.query(
    "select pair_id, stratum, place::int as place from (select pair_id, stratum, row_number() over (partition by stratum order by sha256('seed-1' || chr(10) || pair_id), pair_id) as place from (select distinct pair_id, stratum from pair_labels)) "
    "where place <= case stratum when 'candidate' then 60 when 'near' then 25 when 'rest' then 15 end"
)
def stratified_sample(spark, d):
    p = table(spark, d, "pair_labels").select("pair_id", "stratum").distinct()
    return R.draw(p, "stratum", "pair_id", {"candidate": 60, "near": 25, "rest": 15}, "seed-1")


@book.query("select item_id, p::int as percent, p < 30 as test from (select item_id, list_reduce(list_prepend(0, list_transform(string_split(sha256(trim(regexp_replace(lower(question), '[ \\t\\r\\n]+', ' ', 'g'))), ''), lambda x: ('0x' || x)::int)), lambda a, x: (a * 16 + x) % 100) as p from eval_items)")
def hash_split(spark, d):
    from sedge.functions.text import question_key

    p = R.hash_percent(question_key(F.col("question")))
    return table(spark, d, "eval_items").select("item_id", p.alias("percent"), (p < 30).alias("test"))


@book.query("select item_id, class_name, place::int as place from (select item_id, class_name, row_number() over (partition by class_name order by sha256('spot' || chr(10) || item_id), item_id) as place from eval_items) where place <= 5")
def spot_check(spark, d):
    i = table(spark, d, "eval_items").select("item_id", "class_name")
    sizes = {c: 5 for c in ("lookup", "local", "multi_hop", "global", "decline", "unanswerable")}
    return R.draw(i, "class_name", "item_id", sizes, "spot")


@book.query("select pair_id, key_a, key_b from pair_labels where key_a is not null and key_b is not null qualify pair_id > min(pair_id) over (partition by key_a, key_b)")
def repeated_pairs(spark, d):
    p = table(spark, d, "pair_labels").where("key_a is not null and key_b is not null")
    return R.repeats(p, ["key_a", "key_b"], "pair_id").select("pair_id", "key_a", "key_b")


@book.query("select user_id, arg_max(event_type <> 'error', (ts, event_id)) as active, count(*) as events from events where user_id is not null group by 1")
def replay_log(spark, d):
    return R.replay(table(spark, d, "events"), "user_id", "ts,event_id", "event_type", "error")


@book.query(
    "with a as (select node_key, count(*) as n from evidence where extract_prompt like 'extract/v1%' group by 1), b as (select node_key, count(*) as n from evidence where extract_prompt like 'extract/v2%' group by 1) "
    "select coalesce(a.node_key, b.node_key) as node_key, a.n as before, b.n as after, a.n is distinct from b.n as changed from a full join b on a.node_key is not distinct from b.node_key"
)
def run_changes(spark, d):
    e = table(spark, d, "evidence")

    def side(v: str, name: str):
        return e.where(F.col("extract_prompt").startswith(f"extract/{v}")).groupBy("node_key").agg(F.count(F.lit(1)).alias(name))

    a, b = side("v1", "before"), side("v2", "after").withColumnRenamed("node_key", "other")
    both = a.join(b, F.col("node_key").eqNullSafe(F.col("other")), "full")
    return both.select(F.coalesce("node_key", "other").alias("node_key"), "before", "after", (~F.col("before").eqNullSafe(F.col("after"))).alias("changed"))


@book.query("select set_name, count(*) as pairs, count(*) filter (where key_a > key_b) as reversed, count(*) filter (where key_a = key_b) as selfs, count(*) filter (where same is null) as open from pair_labels group by 1")
def label_shapes(spark, d):
    return table(spark, d, "pair_labels").groupBy("set_name").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("key_a") > F.col("key_b")).alias("reversed"), F.count_if(F.col("key_a") == F.col("key_b")).alias("selfs"), F.count_if(F.col("same").isNull()).alias("open")
    )


@book.query(
    f"with {CUR_F}, q as (select cik, accession_no, report_date, form_type, row_number() over (partition by cik, form_type order by report_date desc, accession_no desc) as n from cf) select cik, form_type, accession_no from q where n = 1"
)
def newest_of_form(spark, d):
    f = current_filings(table(spark, d, "filings"), ["cik", "form_type", "report_date"])
    return f.groupBy("cik", "form_type").agg(F.max_by("accession_no", F.struct("report_date", "accession_no")).alias("accession_no"))


@book.query("select coalesce(a.node_key, b.node_key) as node_key, coalesce(a.key, a.node_key) as canonical from (select distinct e.node_key, p.k as key from evidence e left join (select key_b as k2, min(key_a) as k from pair_labels where same and key_a < key_b group by 1) p on p.k2 = e.node_key where e.node_key is not null) a left join evidence b on false")
def canonical_keys(spark, d):
    alias = table(spark, d, "pair_labels").where("same and key_a < key_b").groupBy(F.col("key_b").alias("node_key")).agg(F.min("key_a").alias("key"))
    n = table(spark, d, "evidence").where("node_key is not null").select("node_key").distinct()
    return n.join(alias, "node_key", "left").select("node_key", F.coalesce("key", "node_key").alias("canonical"))


@book.query(
    "with g as (select o_custkey, o_orderpriority as grp, bool_or(o_orderstatus = 'F') as hit from orders group by 1, 2) select o_custkey, count(*) as groups, count(*) filter (where hit) as hits, bool_and(hit) as passed from g group by 1"
)
def multihop_judge(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("grp")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("hit"))
    return g.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("groups"), F.count_if("hit").alias("hits"), F.bool_and("hit").alias("passed"))


@book.query(
    "with s as (select o_orderpriority as cls, o_orderstatus as arm, round(avg(o_totalprice), 2) as score, count(*) as cost from orders group by 1, 2), b as (select cls, max(score) as best from s group by 1) "
    "select cls, (select arg_min(arm, (cost, arm)) from s where s.cls = b.cls and s.score >= b.best * 0.95) as arm from b"
)
def cheapest_of_best(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("cls"), F.col("o_orderstatus").alias("arm")).agg(F.round(F.avg("o_totalprice"), 2).alias("score"), F.count(F.lit(1)).alias("cost"))
    tied = s.join(s.groupBy("cls").agg(F.max("score").alias("best")), "cls").where("score >= best * 0.95")
    return tied.groupBy("cls").agg(F.min_by("arm", F.struct("cost", "arm")).alias("arm"))


@book.query(
    "select 'class' as field, class_name as value, count(*) as n from eval_items group by 2 union all select 'topic', topic, count(*) from eval_items group by 2 union all select 'split', split, count(*) from eval_items group by 2"
)
def coverage(spark, d):
    i = table(spark, d, "eval_items")
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in (("class", "class_name"), ("topic", "topic"), ("split", "split"))])).alias("x")
    return i.select(fields).select("x.*").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


@book.query()
def packed_chunks(spark, d):
    """Sentences of every filing packed greedily into chunks of at most 160 words with up to 20 words of overlap."""
    f = current_filings(table(spark, d, "filings"), ["parsed_text"])
    units = R.sentence_bounds(f, "accession_no", "parsed_text").join(f, "accession_no")
    words = F.regexp_count(F.substring(F.col("parsed_text"), F.col("start") + 1, F.col("end") - F.col("start")), F.lit(r"[^ \t\r\n]+")).cast("long")
    return R.packed(units.select("accession_no", "start", "end", words.alias("tokens")), "accession_no", "start", "end", "tokens", 160, 20)
