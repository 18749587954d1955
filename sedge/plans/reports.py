"""Queries of run reports: two-level means, winners and conflicts, verification, rates and quarters of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.book import Book
from sedge.operators import graph as G
from sedge.plans.graphs import _RANK
from sedge.plans.store import TEXTS, _texts
from sedge.session import table

book = Book()
QUERIES, SQL = book.queries, book.sql


@book.query(
    "with q as (select arm, question_id, avg((status = 'answered')::int) as m from answers where question_id is not null group by 1, 2), r as (select arm, run_file, avg((status = 'answered')::int) as m from answers where question_id is not null group by 1, 2) "
    "select a.arm, questions, round(mean, 6) as mean, runs, round(spread, 6) as spread from (select arm, count(*) as questions, avg(m) as mean from q group by 1) a join (select arm, count(*) as runs, max(m) - min(m) as spread from r group by 1) b on a.arm is not distinct from b.arm"
)
def judged_cells(spark, d):
    """Mean of question means, and the spread of run means."""
    a = table(spark, d, "answers").where("question_id is not null").withColumn("ok", (F.col("status") == "answered").cast("int"))
    q = a.groupBy("arm", "question_id").agg(F.avg("ok").alias("m")).groupBy("arm").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("m"), 6).alias("mean"))
    r = a.groupBy("arm", "run_file").agg(F.avg("ok").alias("m")).groupBy(F.col("arm").alias("other")).agg(F.count(F.lit(1)).alias("runs"), F.round(F.max("m") - F.min("m"), 6).alias("spread"))
    return q.join(r, F.col("arm").eqNullSafe(F.col("other"))).drop("other")


@book.query(
    f"""with e as (select node_key, extract_prompt, {_RANK} as r, extracted_at, evidence_id from evidence where node_key is not null),
v as (select node_key, extract_prompt, max((r, extracted_at, evidence_id)) as top, count(*) as n from e group by 1, 2)
select node_key, extract_prompt, n, row_number() over (partition by node_key order by top desc, extract_prompt) = 1 as winner from v"""
)
def value_conflicts(spark, d):
    """Of each node the value that the firmest and latest evidence gives, and those that lose against it."""
    e = table(spark, d, "evidence").where("node_key is not null")
    v = e.groupBy("node_key", "extract_prompt").agg(F.max(F.struct(G.confidence_rank(F.col("confidence")).alias("r"), "extracted_at", "evidence_id")).alias("top"), F.count(F.lit(1)).alias("n"))
    best = v.groupBy("node_key").agg(F.max("top").alias("best"))
    return v.join(best, "node_key").select("node_key", "extract_prompt", "n", (F.col("top") == F.col("best")).alias("winner"))


@book.query(
    f"with {TEXTS} select chunk_id, text <> '' as filled, length(text) = char_end - char_start as whole, len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) = token_count as counted, "
    "regexp_full_match(chunk_id, '[0-9]{10}-[0-9]{2}-[0-9]{6}:[0-9]{4,}') as id_ok from ct"
)
def load_verification(spark, d):
    """Whether every chunk's stored offsets and counts agree with the text they point to."""
    t = _texts(spark, d)
    words = F.regexp_count("text", F.lit(r"[^ \t\r\n]+"))
    return t.select(
        "chunk_id", (F.col("text") != "").alias("filled"), (F.length("text") == F.col("char_end") - F.col("char_start")).alias("whole"), (words == F.col("token_count")).alias("counted"),
        F.col("chunk_id").rlike(r"^[0-9]{10}-[0-9]{2}-[0-9]{6}:[0-9]{4,}$").alias("id_ok"),
    )


@book.query(
    "with e as (select *, trim(chunk_id, ' ' || chr(9)) as c from evidence), f as (select distinct node_key, regexp_replace(c, ':[^:]*$', '') as filing from e where c is not null and node_key is not null), own as (select *, split_part(node_key, ':', 2) as own from f) "
    "select node_key, count(*) as filings, bool_or(filing = own) as in_own from own group by 1"
)
def own_filing(spark, d):
    """Whether a node of a filing is evidenced in that filing."""
    e = table(spark, d, "evidence").withColumn("c", F.btrim("chunk_id", F.lit(" \t"))).where("c is not null and node_key is not null")
    f = e.select("node_key", F.regexp_replace("c", ":[^:]*$", "").alias("filing")).distinct()
    return f.groupBy("node_key").agg(F.count(F.lit(1)).alias("filings"), F.bool_or(F.col("filing") == F.split_part("node_key", F.lit(":"), F.lit(2))).alias("in_own"))


@book.query(
    "with k as (select distinct set_name, least(key_a, key_b) as a, greatest(key_a, key_b) as b, same from pair_labels where same is not null and key_a is not null and key_b is not null) "
    "select x.set_name as set_a, y.set_name as set_b, count(*) as pairs, count(*) filter (where x.same = y.same) as agreed from k x join k y on x.a = y.a and x.b = y.b and x.set_name < y.set_name group by 1, 2"
)
def set_agreement(spark, d):
    """Verdicts of two sets on the same pair, whichever way round it was written."""
    p = table(spark, d, "pair_labels").where("same is not null and key_a is not null and key_b is not null")
    k = p.select("set_name", F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"), "same").distinct()
    one, two = k.select("a", "b", F.col("set_name").alias("set_a"), F.col("same").alias("x")), k.select("a", "b", F.col("set_name").alias("set_b"), F.col("same").alias("y"))
    return one.join(two, ["a", "b"]).where("set_a < set_b").groupBy("set_a", "set_b").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("x") == F.col("y")).alias("agreed"))


@book.query(
    "select arm, class_name, count(*) as n, round(avg((stop_reason = 'max_tokens')::int), 6) as cut_share, count(*) filter (where message_id is null) as replayed, round(quantile_cont(output_tokens, 0.5), 6) as median_tokens from answers where class_name is not null group by grouping sets ((arm, class_name), (arm))"
)
def run_rates(spark, d):
    a = table(spark, d, "answers").where("class_name is not null")
    kinds = a.withColumn("class_name", F.explode(F.array("class_name", F.lit(None).cast("string"))))
    return kinds.groupBy("arm", "class_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("stop_reason") == "max_tokens").cast("int")), 6).alias("cut_share"), F.count_if(F.col("message_id").isNull()).alias("replayed"), F.round(F.percentile("output_tokens", 0.5), 6).alias("median_tokens")
    )
