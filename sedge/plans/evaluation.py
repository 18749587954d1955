"""Queries for vector search, retrieval metrics and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedge.book import Book
from sedge.operators import evaluate as E
from sedge.operators import metrics as M
from sedge.operators import vectors as V
from sedge.plans.scoring import _boot as boot
from sedge.session import table

book = Book()
QUERIES, SQL = book.queries, book.sql

_COS = "round(list_cosine_similarity(q.embedding::double[], b.embedding::double[]), 9)"
_TOP = f"""top as (select q.vec_id as query, b.vec_id as vec_id, q.label as qlabel, b.label as label, {_COS} as score,
  row_number() over (partition by q.vec_id order by {_COS} desc, b.vec_id) as rank
  from embeddings q join embeddings b on q.vec_id <> b.vec_id where q.vec_id % 100 = 0 qualify rank <= 10)"""


def _top(spark: SparkSession, d: str, facet: str | None = None) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.top_k(e, e.where("vec_id % 100 = 0"), 10, "vec_id", "embedding", facet)


@book.query(f"with {_TOP} select query, vec_id, round(score, 6) as score, rank::int as rank from top")
def vector_topk(spark, d):
    return _top(spark, d).select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


@book.query(
    f"select q.vec_id as query, b.vec_id as vec_id, round({_COS}, 6) as score, (row_number() over (partition by q.vec_id order by {_COS} desc, b.vec_id))::int as rank "
    "from embeddings q join embeddings b on q.vec_id <> b.vec_id and q.label = b.label where q.vec_id % 100 = 0 qualify rank <= 10"
)
def vector_topk_filtered(spark, d):
    return _top(spark, d, "label").select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


@book.query("select b.vec_id, round(list_cosine_similarity(q.embedding::double[], b.embedding::double[]), 6) as score from embeddings b, (select embedding from embeddings where vec_id = 0) q where b.label in (1, 3)")
def vector_cosines_of(spark, d):
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)  # one row
    return e.where("label in (1, 3)").join(F.broadcast(one)).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


@book.query("select vec_id, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as norm, round((embedding::double[])[1] / sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))), 6) as first from embeddings")
def unit_vectors(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(V.dot(v, v)), 6).alias("norm"), F.round(F.element_at(V.unit(v), 1), 6).alias("first"))


@book.query(
    f"""with {_TOP} select qlabel as label, round(avg(hits), 6) as hits, round(avg(hits / 10.0), 6) as precision, round(avg(hits::double / gold), 6) as recall from
(select query, qlabel, count(*) filter (where label = qlabel) as hits from top group by 1, 2) t join (select label, count(*) - 1 as gold from embeddings group by 1) g on g.label = t.qlabel group by 1"""
)
def recall_precision(spark, d):
    e = table(spark, d, "embeddings")
    labels = e.select("vec_id", "label")
    got = _top(spark, d).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("qlabel")), "query")
    hits = got.groupBy("query", "qlabel").agg(F.count_if(F.col("label") == F.col("qlabel")).alias("hits"))
    gold = e.groupBy(F.col("label").alias("qlabel")).agg((F.count(F.lit(1)) - 1).alias("gold"))
    return hits.join(gold, "qlabel").groupBy(F.col("qlabel").alias("label")).agg(
        F.round(F.avg("hits"), 6).alias("hits"), F.round(F.avg(F.col("hits") / 10), 6).alias("precision"), F.round(F.avg(F.col("hits") / F.col("gold")), 6).alias("recall")
    )


@book.query(
    f"""with {_TOP}, gold as (select query, vec_id from top where label = qlabel and rank % 2 = 0), neg as (select query, vec_id from top where label <> qlabel),
w as (select query, max(rank) as worst from top semi join gold using (query, vec_id) group by 1)
select t.query, t.vec_id as item from top t semi join neg using (query, vec_id) join w using (query) where t.rank < w.worst"""
)
def wrong_evidence(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    got = _top(spark, d).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("qlabel")), "query").withColumnRenamed("vec_id", "item")
    gold = got.where("label = qlabel and rank % 2 = 0").select("query", "item")
    return M.wrong_evidence(got.select("query", "item", "rank"), gold, got.where("label <> qlabel").select("query", "item"))


@book.query(
    f"with w as (select event_type, count(*) filter (where value > 50) as k, count(*) as n from events group by 1) select event_type, n, "
    f"round((k / n + {M.Z_95}*{M.Z_95} / (2 * n) - {M.Z_95} * sqrt((k / n) * (1 - k / n) / n + {M.Z_95}*{M.Z_95} / (4.0 * n * n))) / (1 + {M.Z_95}*{M.Z_95} / n), 6) as low, "
    f"round((k / n + {M.Z_95}*{M.Z_95} / (2 * n) + {M.Z_95} * sqrt((k / n) * (1 - k / n) / n + {M.Z_95}*{M.Z_95} / (4.0 * n * n))) / (1 + {M.Z_95}*{M.Z_95} / n), 6) as high from w"
)
def wilson_interval(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return g.select("event_type", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_KAPPA = "select set_name, count(*) as n, count(*) filter (where same and quotes_verified) as yy, count(*) filter (where same) as a, count(*) filter (where quotes_verified) as b from pair_labels where same is not null and quotes_verified is not null group by 1"


@book.query(f"select set_name, n, round((((yy + n - a - b + yy) / n) - ((a * b + (n - a) * (n - b)) / (n * n))) / (1 - ((a * b + (n - a) * (n - b)) / (n * n))), 6) as kappa from ({_KAPPA})")
def cohen_kappa(spark, d):
    p = table(spark, d, "pair_labels").where("same is not null and quotes_verified is not null")
    g = p.groupBy("set_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("same and quotes_verified")).alias("yy"), F.count_if("same").alias("a"), F.count_if("quotes_verified").alias("b"))
    return g.select("set_name", "n", F.round(M.kappa(F.col("yy"), F.col("a"), F.col("b"), F.col("n")), 6).alias("kappa"))


@book.query(
    """with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 as rx,
rank() over (partition by l_returnflag order by l_discount) + (count(*) over (partition by l_returnflag, l_discount) - 1) / 2.0 as ry from lineitem)
select l_returnflag, count(*) as n, round(corr(rx, ry), 6) as rho from r group by 1"""
)
def spearman_by_flag(spark, d):
    out = M.spearman(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount")
    return out.withColumn("rho", F.round("rho", 6))


@book.query(
    """with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 as rx,
rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0 as ry from lineitem),
c as (select l_returnflag, count(*) as n, corr(rx, ry) as rho from r group by 1)
select l_returnflag, round(tanh(atanh(rho) - 1.959963984540054 / sqrt(n - 3)), 6) as low, round(tanh(atanh(rho) + 1.959963984540054 / sqrt(n - 3)), 6) as high from c"""
)
def fisher_interval(spark, d):
    out = M.spearman(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    low, high = M.fisher(F.col("rho"), F.col("n"))
    return out.select("l_returnflag", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def _boot_sql(value: str, weight: str) -> str:
    own = boot("x", "embeddings", "label", "vec_id", {"top": value, "bottom": weight}, "top / nullif(bottom, 0)", 1000)
    return f"with {own} select label, n, round(estimate, 6) as estimate, round(low, 6) as low, round(high, 6) as high, kept from x"


@book.query(_boot_sql("(embedding[1])::double", "1.0"))
def bootstrap_mean(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", F.element_at("embedding", 1).alias("v"))
    return E.bootstrap_of(e, ["label"], "vec_id", {"top": F.col("v"), "bottom": F.lit(1.0)}, E.ratio, 1000).withColumns({c: F.round(c, 6) for c in ("estimate", "low", "high")})


@book.query(_boot_sql("(embedding[1])::double", "(vec_id % 5)::double"))
def bootstrap_ratio(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", F.element_at("embedding", 1).alias("v"), (F.col("vec_id") % 5).alias("w"))
    return E.bootstrap_of(e, ["label"], "vec_id", {"top": F.col("v"), "bottom": F.col("w")}, E.ratio, 1000).withColumns({c: F.round(c, 6) for c in ("estimate", "low", "high")})


@book.query(
    """with a as (select o_custkey, o_orderpriority as cls, avg(o_totalprice) as x from orders where o_orderstatus = 'F' group by 1, 2), b as (select o_custkey, o_orderpriority as cls, avg(o_totalprice) as x from orders where o_orderstatus = 'O' group by 1, 2)
select coalesce(a.cls, b.cls) as cls, count(*) filter (where a.x is not null and b.x is not null) as paired, count(*) filter (where a.x is null or b.x is null) as unpaired, round(avg(a.x - b.x), 4) as diff from a full join b on a.o_custkey = b.o_custkey and a.cls = b.cls group by 1"""
)
def paired_difference(spark, d):
    o = table(spark, d, "orders")

    def side(status: str, name: str) -> DataFrame:
        return o.where(F.col("o_orderstatus") == status).groupBy("o_custkey", F.col("o_orderpriority").alias("cls")).agg(F.avg("o_totalprice").alias(name))

    both = side("F", "x").join(side("O", "y"), ["o_custkey", "cls"], "full")
    paired = F.col("x").isNotNull() & F.col("y").isNotNull()
    return both.groupBy("cls").agg(F.count_if(paired).alias("paired"), F.count_if(~paired).alias("unpaired"), F.round(F.avg(F.col("x") - F.col("y")), 4).alias("diff"))


@book.query("select event_type, count(*) as n, count(*) < 10 as directional, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events where value is not null group by 1")
def latency_percentiles(spark, d):
    return table(spark, d, "events").where("value is not null").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) < 10).alias("directional"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95")
    )


@book.query(
    "select class_name, count(*) filter (where status = 'answered') as answered, count(*) filter (where status = 'not_found') as not_found, count(*) filter (where status = 'declined') as declined, "
    "count(*) filter (where status = 'refused') as refused, count(*) filter (where status = 'no_status') as no_status from answers group by 1"
)
def confusion_matrix(spark, d):
    return table(spark, d, "answers").groupBy("class_name").pivot("status", ["answered", "not_found", "declined", "refused", "no_status"]).count().na.fill(0)


@book.query(
    "select arm, count(*) as n, round(sum(len(list_filter(kept, lambda s: len(s.citations) = 0)))::double / nullif(sum(len(kept)), 0), 6) as uncited_share from answers group by 1"
)
def answer_cell(spark, d):
    kept = F.col("kept")
    return table(spark, d, "answers").groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.size(F.filter(kept, lambda s: F.size(s["citations"]) == 0))).cast("double") / F.nullif(F.sum(F.when(kept.isNotNull(), F.size(kept))), F.lit(0)), 6).alias("uncited_share"),
    )


@book.query("select model, arm, round(sum(coalesce(input_tokens, 0) * 3.0 + coalesce(output_tokens, 0) * 15.0) / 1e6, 6) as cost, count(*) filter (where input_tokens is null) as unknown from answers group by 1, 2")
def token_cost(spark, d):
    zero = F.lit(0)
    return table(spark, d, "answers").groupBy("model", "arm").agg(
        F.round(F.sum(F.coalesce("input_tokens", zero) * 3.0 + F.coalesce("output_tokens", zero) * 15.0) / 1e6, 6).alias("cost"), F.count_if(F.col("input_tokens").isNull()).alias("unknown")
    )


@book.query(
    "select a_key, b_key, case when 2 * yes = n then null else 2 * yes > n end as verdict, n from (select least(key_a, key_b) as a_key, greatest(key_a, key_b) as b_key, count(*) as n, count(*) filter (where same) as yes "
    "from pair_labels where same is not null and key_a is not null and key_b is not null group by 1, 2)"
)
def majority_verdict(spark, d):
    p = table(spark, d, "pair_labels").where("same is not null and key_a is not null and key_b is not null")
    g = p.groupBy(F.least("key_a", "key_b").alias("a_key"), F.greatest("key_a", "key_b").alias("b_key")).agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("yes"))
    return g.select("a_key", "b_key", F.when(2 * F.col("yes") != F.col("n"), 2 * F.col("yes") > F.col("n")).alias("verdict"), "n")


@book.query(
    "with g as (select set_name, stratum, count(*) as n, count(*) filter (where same) as tp from pair_labels where same is not null group by 1, 2) "
    "select coalesce(set_name, 'all') as set_name, coalesce(stratum, 'all') as stratum, sum(n)::bigint as n, round(sum(tp)::double / sum(n), 6) as share from g group by grouping sets ((set_name, stratum), (set_name), ())"
)
def pooled_cells(spark, d):
    p = table(spark, d, "pair_labels").where("same is not null")
    return p.rollup("set_name", "stratum").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if("same").cast("double") / F.count(F.lit(1)), 6).alias("share")).select(
        F.coalesce("set_name", F.lit("all")).alias("set_name"), F.coalesce("stratum", F.lit("all")).alias("stratum"), "n", "share"
    )


@book.query("select event_type, round(avg(abs(value - u)), 6) as mae, round(avg(value - u), 6) as bias, round(avg((value > u)::int), 6) as above from (select *, avg(value) over (partition by user_id) as u from events where value is not null) group by 1")
def mean_errors(spark, d):
    e = table(spark, d, "events").where("value is not null").withColumn("u", F.avg("value").over(Window.partitionBy("user_id")))
    x = F.col("value") - F.col("u")
    return e.groupBy("event_type").agg(F.round(F.avg(F.abs(x)), 6).alias("mae"), F.round(F.avg(x), 6).alias("bias"), F.round(F.avg((F.col("value") > F.col("u")).cast("int")), 6).alias("above"))
