"""Queries for intervals, paired comparisons, verdicts, evaluation sets, pair scores and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.book import Book
from sedge.operators import arms as A
from sedge.operators import evaluate as V
from sedge.session import table

book = Book()
QUERIES, SQL = book.queries, book.sql

_U = "('0x' || substr(sha256('{seed}|' || {unit} || '|' || draw), 1, 8))::bigint / 4294967296.0"
_W = "(" + " + ".join(f"({{u}} >= {c})::int" for c in V.POISSON) + ")"


def _boot(name: str, src: str, by: str, unit: str, sums: dict[str, str], stat: str, resamples: int = 200, seed: int = 7) -> str:
    """CTEs that give ``name`` (by..., n, estimate, low, high, kept) as ``bootstrap_of`` does."""
    agg = ", ".join(f"sum(({x})::double) as {k}" for k, x in sums.items())
    again = ", ".join(f"sum({k} * w) as {k}" for k in sums)
    total = ", ".join(f"sum({k}) as {k}" for k in sums)
    w = _W.format(u="u")
    keys = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    on = " and ".join(f"l.{c.strip()} is not distinct from r.{c.strip()}" for c in by.split(",")) if by else "true"
    own = ", ".join(f"l.{c.strip()}" for c in by.split(",")) + ", " if by else ""
    return f"""{name}_p as (select {keys}{unit} as unit, {agg} from {src} where {unit} is not null group by {keys}{unit}),
{name}_t as (select {keys}count(*) as n, {total} from {name}_p {group}), {name}_e as (select {keys}n, {stat} as estimate from {name}_t),
{name}_d as (select *, {w} as w from (select *, {_U.format(seed=seed, unit="unit::varchar")} as u from {name}_p, (select unnest(range({resamples})) as draw))),
{name}_s as (select {keys}draw, {again} from {name}_d where w > 0 group by {keys}draw), {name}_v as (select {keys}{stat} as s from {name}_s where ({stat}) is not null),
{name}_i as (select {keys}quantile_cont(s, 0.025) as low, quantile_cont(s, 0.975) as high, count(*) as kept from {name}_v {group}),
{name} as (select {own}n, estimate, low, high, coalesce(kept, 0) as kept from {name}_e l left join {name}_i r on {on})"""


_RATIO = "top / nullif(bottom, 0)"
_Q = "q as (select arm, class_name, question_id as question, avg((status = 'answered')::int)::double as score, avg(output_tokens)::double as tokens from answers where arm is not null and class_name is not null and question_id is not null and status is not null group by 1, 2, 3)"
_QP = "qp as (select arm, unnest([class_name, 'all']) as class_name, question, score, tokens from q)"


def _scores(spark, d):
    a = table(spark, d, "answers").where("arm is not null and class_name is not null and question_id is not null and status is not null")
    return a.groupBy("arm", "class_name", F.col("question_id").alias("question")).agg(F.avg((F.col("status") == "answered").cast("int")).alias("score"), F.avg("output_tokens").alias("tokens"))


@book.query(
    f"with {_Q}, {_QP}, {_boot('x', 'qp', 'arm, class_name', 'question', {'top': 'score', 'bottom': '1'}, _RATIO)} select arm, class_name, n, round(estimate, 9) as mean, round(low, 9) as low, round(high, 9) as high, n < 10 as directional from x"
)
def cell_intervals(spark, d):
    """Mean and interval of every cell of arm and class, and of the pooled classes."""
    x = V.bootstrap_of(V.with_pooled(_scores(spark, d), "class_name"), ["arm", "class_name"], "question", {"top": F.col("score"), "bottom": F.lit(1.0)}, V.ratio)
    return x.select("arm", "class_name", "n", F.round("estimate", 9).alias("mean"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), V.is_directional(F.col("n")).alias("directional"))


_PAIRED = f"""{_Q}, {_QP}, own as (select * from qp where arm <> 'vector'), ref as (select class_name, question, score from qp where arm = 'vector'), arms as (select distinct arm from own),
rf as (select arms.arm, ref.* from arms, ref), bo as (select coalesce(o.arm, r.arm) as arm, coalesce(o.class_name, r.class_name) as class_name, coalesce(o.question, r.question) as question, o.score as sx, r.score as sy
 from own o full join rf r on o.arm = r.arm and o.class_name = r.class_name and o.question = r.question),
un as (select arm, class_name, count(*) filter (sx is null or sy is null) as unpaired from bo group by 1, 2), me as (select *, sx - sy as dd from bo where sx is not null and sy is not null),
{_boot('x', 'me', 'arm, class_name', 'question', {'top': 'dd', 'bottom': '1'}, _RATIO)},
pr as (select arm, class_name, coalesce(n, 0) as n, unpaired, round(estimate, 9) as difference, round(low, 9) as low, round(high, 9) as high, coalesce(round(low, 9) > 0 or round(high, 9) < 0, false) as counts from un left join x using (arm, class_name))"""


def _paired(spark, d):
    p = V.paired(_scores(spark, d).drop("tokens"), "vector")
    out = p.select("arm", "class_name", "n", "unpaired", F.round("difference", 9).alias("difference"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))
    return out.withColumn("counts", F.coalesce((F.col("low") > 0) | (F.col("high") < 0), F.lit(False)))


@book.query(f"with {_PAIRED} select * from pr")
def paired_cells(spark, d):
    """Every arm against the vector arm, by class and pooled, with unpaired questions."""
    return _paired(spark, d)


@book.query(
    f"""with {_PAIRED}, h as (select * from (values ('H1', 'lookup', 'graph_local', -1, 0.05), ('H2', 'multi_hop', 'traversal', 1, 0.10), ('H4', 'global', 'graph_global', 1, 0.10), ('H7', 'all', 'none', 1, 0.0)) v(name, class_name, arm, sign, margin))
select name, h.class_name, h.arm, coalesce(n, 0) as n, case when difference is null then 'not testable' when n < 10 then case when sign * difference >= sign * margin then 'met (directional)' else 'not met (directional)' end
when sign * difference >= sign * margin then 'met' else 'not met' end as verdict from h left join pr on pr.arm = h.arm and pr.class_name = h.class_name"""
)
def hypotheses(spark, d):
    """Verdicts of hypotheses about paired differences: at least, or at most, a margin."""
    h = spark.createDataFrame([("H1", "lookup", "graph_local", -1, 0.05), ("H2", "multi_hop", "traversal", 1, 0.10), ("H4", "global", "graph_global", 1, 0.10), ("H7", "all", "none", 1, 0.0)], "name string, class_name string, arm string, sign int, margin double")
    p = F.broadcast(h).join(_paired(spark, d), ["class_name", "arm"], "left")
    met = F.col("sign") * F.col("difference") >= F.col("sign") * F.col("margin")
    return p.select("name", "class_name", "arm", F.coalesce("n", F.lit(0)).alias("n"), V.verdict(met, F.col("n")).alias("verdict"))


@book.query(
    f"""with {_Q}, m as (select class_name, arm, round(avg(score), 9) as mean, round(avg(tokens), 9) as cost from q group by 1, 2), best as (select class_name, arg_min(arm, (-mean, arm)) as best from m group by 1),
me as (select o.class_name, o.arm, o.question, o.score - r.score as dd from q o join best using (class_name) join q r on r.class_name = o.class_name and r.arm = best.best and r.question = o.question where o.arm <> best.best),
{_boot('x', 'me', 'class_name, arm', 'question', {'top': 'dd', 'bottom': '1'}, _RATIO)}, ti as (select class_name, arm from x where low <= 0 and high >= 0 union select class_name, best from best)
select class_name, best, array_to_string(list_sort(list(distinct ti.arm)), ' ') as tied, arg_min(ti.arm, (coalesce(cost, 'inf'::double), ti.arm)) as chosen from ti join best using (class_name) left join m on m.class_name = ti.class_name and m.arm = ti.arm group by 1, 2"""
)
def dev_best(spark, d):
    """The arm to use for each class: the cheapest of those that may be as good as the best."""
    q = _scores(spark, d)
    m = q.groupBy("class_name", "arm").agg(F.round(F.avg("score"), 9).alias("mean"), F.round(F.avg("tokens"), 9).alias("cost"))
    best = m.groupBy("class_name").agg(F.min_by("arm", F.struct((-F.col("mean")).alias("m"), "arm")).alias("best"))
    with_best = q.join(F.broadcast(best), "class_name")
    ref = with_best.where("arm = best").select("class_name", "question", F.col("score").alias("__y"))
    met = with_best.where("arm <> best").join(ref, ["class_name", "question"]).withColumn("__d", F.col("score") - F.col("__y"))
    diff = V.bootstrap_of(met, ["class_name", "best", "arm"], "question", {"top": F.col("__d"), "bottom": F.lit(1.0)}, V.ratio)
    return V.tied_cheapest(m, m.select("class_name", "arm", "cost"), diff)


_CLASSES = "('lookup', 'local', 'multi_hop', 'global')"


@book.query(
    f"""with k as (select *, trim(regexp_replace(lower(question), '[ \\t\\r\\n]+', ' ', 'g')) as key, count(*) over (partition by item_id) as times from eval_items), f as (select *, min(item_id) over (partition by key) as first from k)
select distinct item_id as item, rule from (select item_id, 'repeated_id' as rule from f where times > 1 union all select item_id, 'blank_question' from f where question is null or trim(question) = '' union all select item_id, 'blank_passage' from f where passage is null or trim(passage) = ''
union all select item_id, 'unknown_class' from f where class_name is null or class_name not in ('lookup', 'local', 'multi_hop') union all select item_id, 'unknown_split' from f where split is null or split not in ('dev', 'test') union all select item_id, 'repeated_question' from f where item_id <> first)"""
)
def eval_problems(spark, d):
    """Rules of an evaluation set that has no global questions."""
    return V.eval_problems(table(spark, d, "eval_items"), ["lookup", "local", "multi_hop"], ["dev", "test"])


@book.query(
    """with v as (select model, key_a || ' ' || key_b as item, bool_or(same) as verdict, avg(quotes_verified::int) as score from pair_labels where key_a is not null and key_b is not null and same is not null group by 1, 2),
r as (select * from v where model = 'label-model-1'), c as (select * from v where model = 'label-model-2')
select count(c.item) as compared, avg((c.verdict = r.verdict)::int::double) as agreement, avg(abs(r.score - c.score)) as gap, count(*) filter (c.item is null) / count(*) as missing from r left join c using (item)"""
)
def judge_comparison(spark, d):
    """Two labelling models on the same pairs."""
    p = table(spark, d, "pair_labels").where("key_a is not null and key_b is not null and same is not null")
    v = p.groupBy("model", F.concat_ws(" ", "key_a", "key_b").alias("item")).agg(F.bool_or("same").alias("verdict"), F.avg(F.col("quotes_verified").cast("int")).alias("score"))
    return V.judge_comparison(v.where("model = 'label-model-2'"), v.where("model = 'label-model-1'"))


_KAPPA = "(case when (a * b + (n2 - a) * (n2 - b)) / (n2 * n2) < 1 then ((n2 - a - b + 2 * both_) / n2 - (a * b + (n2 - a) * (n2 - b)) / (n2 * n2)) / (1 - (a * b + (n2 - a) * (n2 - b)) / (n2 * n2)) end)"


@book.query(
    f"""with s as (select label, key_a, same, quotes_verified as qv from pair_labels where same is not null and quotes_verified is not null), {_boot('x', 's', 'label', 'key_a', {'n2': '1', 'both_': '(same and qv)::int', 'a': 'same::int', 'b': 'qv::int'}, _KAPPA)}
select label, n, round(estimate, 9) as kappa, round(low, 9) as low, round(high, 9) as high from x"""
)
def kappa_clusters(spark, d):
    """Kappa of two verdicts with an interval over whole clusters of pairs."""
    p = table(spark, d, "pair_labels").where("same is not null and quotes_verified is not null")
    yes = lambda c: F.col(c).cast("int")
    x = V.bootstrap_of(p, ["label"], "key_a", {"n": F.lit(1.0), "both": yes("same") * yes("quotes_verified"), "a": yes("same"), "b": yes("quotes_verified")}, V.kappa_of)
    return x.select("label", "n", F.round("estimate", 9).alias("kappa"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@book.query("with s as (select arm, unnest(kept) as k from answers where kept is not null) select arm, count(*) filter (len(k.citations) > 0) / count(*) as faithfulness, count(*) as checked from s where k.text is not null and length(trim(k.text)) >= 12 group by 1")
def human_faithfulness(spark, d):
    """Supported among checked sentences of each arm; very short ones are no claims."""
    s = table(spark, d, "answers").where("kept is not null").select("arm", F.explode("kept").alias("k")).where("k.text is not null and length(trim(k.text)) >= 12")
    return s.groupBy("arm").agg((F.count_if(F.size("k.citations") > 0) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("faithfulness"), F.count(F.lit(1)).alias("checked"))


@book.query("select coalesce(class_name, 'all') as class_name, count(*) as n, avg((stop_reason = 'end_turn')::int::double) as valid, count(*) filter (stop_reason = 'max_tokens') as cut_off from answers where class_name is not null and stop_reason is not null group by rollup (class_name)")
def validity_rates(spark, d):
    """Share of complete replies by class and pooled."""
    a = table(spark, d, "answers").where("class_name is not null and stop_reason is not null")
    return a.rollup("class_name").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("stop_reason") == "end_turn").cast("double")).alias("valid"), F.count_if(F.col("stop_reason") == "max_tokens").alias("cut_off")).withColumn("class_name", F.coalesce("class_name", F.lit("all")))


@book.query("select class_name, count(*) filter (arm = 'graph_local') as graph_local, count(*) filter (arm = 'traversal') as traversal, count(*) filter (arm = 'traversal' and status <> 'answered') as fallbacks, count(*) filter (kept is null) as without_kept from answers where class_name is not null group by 1")
def arm_counters(spark, d):
    a = table(spark, d, "answers").where("class_name is not null")
    return a.groupBy("class_name").agg(
        F.count_if(F.col("arm") == "graph_local").alias("graph_local"), F.count_if(F.col("arm") == "traversal").alias("traversal"), F.count_if((F.col("arm") == "traversal") & (F.col("status") != "answered")).alias("fallbacks"), F.count_if(F.col("kept").isNull()).alias("without_kept")
    )


@book.query(
    """with r as (select class_name as gold, case when status = 'declined' then 'decline' when status = 'not_found' then 'unanswerable' else class_name end as said from answers where class_name is not null and status is not null)
select gold, count(*) as n, count(*) filter (said = gold) as correct, count(*) filter (said = gold) / count(*) as accuracy, count(*) / sum(count(*)) over () as share, coalesce(mode(said) filter (said <> gold), '') <> '' as has_errors from r group by 1"""
)
def route_report(spark, d):
    """Accuracy, share and errors of each gold class."""
    a = table(spark, d, "answers").where("class_name is not null and status is not null")
    said = F.when(F.col("status") == "declined", "decline").when(F.col("status") == "not_found", "unanswerable").otherwise(F.col("class_name"))
    g = a.groupBy(F.col("class_name").alias("gold")).agg(F.count(F.lit(1)).alias("n"), F.count_if(said == F.col("class_name")).alias("correct"))
    total = g.agg(F.sum("n").alias("total"))
    return g.join(F.broadcast(total)).select("gold", "n", "correct", (F.col("correct") / F.col("n")).alias("accuracy"), (F.col("n") / F.col("total")).alias("share"), (F.col("correct") < F.col("n")).alias("has_errors"))


@book.query("select arm, round(sum(((input_tokens - least(input_tokens % 500, input_tokens)) * 3.0::double + least(input_tokens % 500, input_tokens) * 0.3::double + output_tokens * 15.0::double) / 1e6), 9) as cost from answers where input_tokens is not null and output_tokens is not null group by 1")
def cached_cost(spark, d):
    a = table(spark, d, "answers").where("input_tokens is not null and output_tokens is not null")
    return a.groupBy("arm").agg(F.round(F.sum(V.cached_cost(F.col("input_tokens"), F.col("input_tokens") % 500, F.col("output_tokens"), (3.0, 0.3, 15.0))), 9).alias("cost"))


@book.query(
    "with s as (select regexp_extract(run_file, '([0-9]+)', 1)::int as option, class_name, avg((status = 'answered')::int)::double as value from answers where run_file is not null and class_name is not null and status is not null group by 1, 2) select option, round(avg(value), 9) as mean from s group by 1 order by mean desc, option limit 1"
)
def chosen_option(spark, d):
    """The run setting (hops, number of communities) of best mean over classes."""
    a = table(spark, d, "answers").where("run_file is not null and class_name is not null and status is not null")
    s = a.groupBy(F.regexp_extract("run_file", "([0-9]+)", 1).cast("int").alias("option"), "class_name").agg(F.avg((F.col("status") == "answered").cast("int")).alias("value"))
    return V.choose_option(s, "option")


_TOPIC = "regexp_replace(regexp_extract({0}, '[^:]*$'), '-[0-9]+$', '')"


@book.query(
    f"""with p as (select distinct key_a, key_b, stratum, same, {_TOPIC.format("key_a")} = {_TOPIC.format("key_b")} as predicted from pair_labels where key_a is not null and key_b is not null and same is not null and stratum is not null),
po as (select stratum, count(*) as population from pair_labels where stratum is not null group by 1), w as (select stratum, max(population) / count(*) as w from p join po using (stratum) group by 1)
select count(*) as pairs, sum(case when same and predicted then w else 0 end) / nullif(sum(case when predicted then w else 0 end), 0) as precision, sum(case when same and predicted then w else 0 end) / nullif(sum(case when same then w else 0 end), 0) as recall from p join w using (stratum)"""
)
def pair_scores(spark, d):
    """Precision and recall of links of one topic, weighted by the strata's populations."""
    topic = lambda c: F.regexp_replace(F.regexp_extract(c, "([^:]*)$", 1), "-[0-9]+$", "")
    t = table(spark, d, "pair_labels").where("stratum is not null")
    p = t.where("key_a is not null and key_b is not null and same is not null").select("key_a", "key_b", "stratum", "same", (topic("key_a") == topic("key_b")).alias("predicted")).distinct()
    return V.pair_scores(p, t.groupBy("stratum").agg(F.count(F.lit(1)).alias("population")))


_CONFIGS = [(s, q, m) for s in ("candidate", "near", "rest") for q in (True, False) for m in ("label-model-1", "label-model-2")]
_WITHIN = {"candidate": "'candidate'", "near": "'candidate', 'near'", "rest": "'candidate', 'near', 'rest'"}


@book.query(
    "with c(config, merged, \"right\", wrong, lost) as ("
    + " union all ".join(
        f"select '{s}/{'quoted' if q else 'any'}/{m}', count(*) filter ({c}), count(*) filter ({c} and same), count(*) filter ({c} and not same), count(*) filter (not ({c}) and same) from pair_labels where same is not null"
        for s, q, m in _CONFIGS
        for c in [f"coalesce(stratum in ({_WITHIN[s]}) and model = '{m}'{' and quotes_verified' if q else ''}, false)"]
    )
    + ") select * from c"
)
def tuning_sweep(spark, d):
    """Twelve configurations on the labelled pairs, in one pass."""
    configs = {}
    for s, q, m in _CONFIGS:
        within = F.col("stratum").isin(*[x.strip("' ") for x in _WITHIN[s].split(",")]) & (F.col("model") == m)
        configs[f"{s}/{'quoted' if q else 'any'}/{m}"] = within & F.col("quotes_verified") if q else within
    return V.sweep(table(spark, d, "pair_labels").where("same is not null"), configs)


@book.query(f"with {_Q}, m as (select arm, count(*) as questions, round(avg(score), 4) as mean from q group by 1), l as (select '| ' || arm || ' | ' || questions || ' | ' || mean || ' |' as line, arm, questions, mean from m) select 0 as place, '| arm | questions | mean |' as line union all select 1, '| --- | --- | --- |' union all select (row_number() over (order by arm, questions, mean) + 1)::int, line from l")
def results_table(spark, d):
    """The arms' means as a markdown table."""
    m = _scores(spark, d).groupBy("arm").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("score"), 4).alias("mean"))
    return V.markdown_rows(m, ["arm", "questions", "mean"])


_NEG = "n as (select c.chunk_id, c.cik as company, c.fiscal_period as period, c.section, g.gold, case abs(ascii(right(c.chunk_id, 1))) % 3 when 0 then 'other_company' when 1 then 'other_period' else 'other_section' end as relation from (select distinct chunk_id, cik, fiscal_period, section from chunks where chunk_id is not null and cik is not null and fiscal_period is not null and section is not null) c, g)"


@book.query(
    f"""with s as (select distinct cik as company, fiscal_period as period, section from chunks where cik is not null and fiscal_period is not null and section is not null), g as (select list(x) as gold from (select {{'company': company, 'period': period, 'section': section}} as x from s order by company, period, section limit 1)), {_NEG}
select relation, coalesce(case relation when 'other_company' then len(list_filter(gold, lambda x: x.company <> company)) = len(gold) when 'other_period' then len(list_filter(gold, lambda x: x.company = company and x.period <> period)) = len(gold)
else len(list_filter(gold, lambda x: x.company = company and x.period = period and x.section <> section)) = len(gold) end, false) as holds, count(*) as n from n group by 1, 2"""
)
def negative_relations(spark, d):
    """Whether chunks stand in a claimed relation to one gold place."""
    c = table(spark, d, "chunks").where("chunk_id is not null and cik is not null and fiscal_period is not null and section is not null")
    place = F.struct(F.col("cik").alias("company"), F.col("fiscal_period").alias("period"), "section")
    gold = c.select(place.alias("x")).distinct().orderBy("x").limit(1).agg(F.collect_list("x").alias("gold"))
    n = c.select("chunk_id", "cik", "fiscal_period", "section").distinct().join(F.broadcast(gold))
    kind = F.abs(F.ascii(F.expr("right(chunk_id, 1)"))) % 3
    relation = F.when(kind == 0, "other_company").when(kind == 1, "other_period").otherwise("other_section")
    holds = V.relation_holds(F.col("relation"), F.col("gold"), F.col("cik"), F.col("fiscal_period"), F.col("section"))
    return n.withColumn("relation", relation).groupBy("relation", F.coalesce(holds, F.lit(False)).alias("holds")).agg(F.count(F.lit(1)).alias("n"))


_CITED = "k as (select question_id, class_name, list_sort(list(distinct regexp_replace(c, ':[^:]*$', ''))) as gold from (select question_id, class_name, unnest(s.citations) as c from (select question_id, class_name, unnest(kept) as s from answers where kept is not null and question_id is not null)) group by 1, 2)"


@book.query(
    f"with {_CITED}, o as (select class_name, gold, list_slice(gold, 1, 2) as allowed, list_slice(gold, 1, 3) as label from k) select class_name, count(*) as n, count(*) filter (allowed = label) as exact, count(*) filter (len(list_filter(gold, lambda x: not list_contains(allowed, x))) > 0) as excluded from o group by 1"
)
def filter_report(spark, d):
    """How often a filter of the first two cited filings is the wanted one, and leaves cited ones out."""
    s = table(spark, d, "answers").where("kept is not null and question_id is not null").select("question_id", "class_name", F.explode("kept").alias("s"))
    k = s.select("question_id", "class_name", F.explode("s.citations").alias("c")).groupBy("question_id", "class_name").agg(F.array_sort(F.collect_set(F.regexp_replace("c", ":[^:]*$", ""))).alias("gold"))
    return V.filter_report(k.select("class_name", "gold", F.slice("gold", 1, 2).alias("allowed"), F.slice("gold", 1, 3).alias("label")))


_REL = "r as (select arm, question_id, case when status = 'not_found' then 'other_period' when status = 'declined' then 'other_company' when stop_reason = 'max_tokens' then 'other_section' end as relation from answers where arm is not null and question_id is not null)"


@book.query(f"with {_REL}, q as (select arm, question_id, bool_or(relation is not null) as hit from r group by 1, 2), t as (select arm, count(*) as questions, count(*) filter (hit) as wrong from q group by 1), n as (select arm, relation, count(distinct question_id) as hits from r where relation is not null group by 1, 2) select arm, relation, hits, hits / questions as rate, hits / nullif(wrong, 0) as of_wrong from n join t using (arm)")
def wrong_by_relation(spark, d):
    """Questions with wrong evidence by relation, as a share of all questions and of those with any."""
    relation = F.when(F.col("status") == "not_found", "other_period").when(F.col("status") == "declined", "other_company").when(F.col("stop_reason") == "max_tokens", "other_section")
    r = table(spark, d, "answers").where("arm is not null and question_id is not null").select("arm", "question_id", relation.alias("relation"))
    return V.by_relation(r, "arm", "question_id", "relation")


@book.query(
    "with v as (select vec_id as chunk, label as filing, embedding from embeddings), q as (select vec_id as question, label, embedding from embeddings where vec_id % 100 = 0), f as (select q.question, v.chunk, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 9) as score from q join v on (q.question % 200 = 0 or q.label = v.filing)), "
    "o as (select *, row_number() over (partition by question order by score desc, chunk) as rank from f) select 'vector' as arm, question, chunk, round(score, 6) as score, rank::int as rank from o where rank <= 5"
)
def vector_arm(spark, d):
    """The vector arm through the registry: half of the questions keep to the filings of their own label."""
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("chunk"), F.col("label").alias("filing"), F.col("embedding").alias("vector"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question"), "label", F.col("embedding").alias("vector"))
    allowed = q.where("question % 200 <> 0").select("question", F.col("label").alias("filing"))
    arms = A.Arms()
    arms.add("vector", lambda asked: A.vector_arm(asked.select("question", "vector"), v, 5, allowed))
    return arms.run(q).withColumn("score", F.round("score", 6))
