"""Evaluation: intervals of any statistic of sums, paired comparisons, verdicts, checks of evaluation sets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.session import spread

# fixed values: below so many questions a cell is directional; cumulative chances of 0, 1, 2, ... for a Poisson variable of mean 1
DIRECTIONAL = 10
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def is_directional(n: Column) -> Column:
    return n < DIRECTIONAL


def poisson_weight(seed: int, unit: Column, b: Column) -> Column:
    """How often a unit is drawn in resample ``b``: a Poisson variable of mean 1 from the first 32 bits of a SHA-256, so that any engine can repeat it."""
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), unit.cast("string"), b.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    return reduce(lambda x, y: x + y, [(u >= c).cast("int") for c in POISSON])


def bootstrap_of(df: DataFrame, by: list[str], unit: str, sums: dict[str, Column], statistic: Callable[[Callable[[str], Column]], Column], resamples: int = 200, seed: int = 7) -> DataFrame:
    """(by..., n, estimate, low, high, kept): ``statistic`` of the sums of ``sums`` with a percentile interval over resamples of whole units.

    ``unit`` is what is drawn: the row's own key, or the key of a cluster of rows.  Each unit gets a Poisson weight a resample, so a resample is a
    weighted sum: rows are summed by unit first, weighted where they lie, and only ``resamples`` rows a group and task are shuffled; nothing is joined.
    ``statistic`` gets a function from a name to its sum.  Resamples where it is null are dropped and counted out of ``kept``.  Null units take no part.
    """
    per = df.where(F.col(unit).isNotNull()).groupBy(*by, unit).agg(*[F.sum(c.cast("double")).alias(f"__{k}") for k, c in sums.items()])
    whole = per.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"__{k}").alias(f"__{k}") for k in sums])
    estimate = whole.select(*by, "n", statistic(lambda k: F.col(f"__{k}")).alias("estimate"))
    drawn = spread(per).withColumn("__draw", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("__w", poisson_weight(seed, F.col(unit), F.col("__draw"))).where("__w > 0")
    each = drawn.groupBy(*by, "__draw").agg(*[F.sum(F.col(f"__{k}") * F.col("__w")).alias(f"__{k}") for k in sums])
    each = each.select(*by, statistic(lambda k: F.col(f"__{k}")).alias("__s")).where("__s is not null")
    interval = each.groupBy(*by).agg(F.percentile("__s", 0.025).alias("low"), F.percentile("__s", 0.975).alias("high"), F.count(F.lit(1)).alias("kept"))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    if not by:
        return estimate.crossJoin(F.broadcast(interval))  # one row each
    return estimate.alias("l").join(interval.alias("r"), on, "left").select(*[F.col(f"l.{c}") for c in by], "n", "estimate", "low", "high", F.coalesce("kept", F.lit(0)).alias("kept"))


def ratio(s: Callable[[str], Column]) -> Column:
    return s("top") / F.nullif(s("bottom"), F.lit(0.0))


def kappa_of(s: Callable[[str], Column]) -> Column:
    """Cohen's kappa from the sums ``n``, ``both``, ``a`` and ``b``; null where chance agreement is 1."""
    n = F.nullif(s("n"), F.lit(0.0))
    agreed = (n - s("a") - s("b") + 2 * s("both")) / n
    chance = (s("a") * s("b") + (n - s("a")) * (n - s("b"))) / (n * n)
    return F.when(chance < 1, (agreed - chance) / (1 - chance))


def with_pooled(df: DataFrame, column: str, name: str = "all") -> DataFrame:
    """Every row twice: in its own group, and in the pooled one."""
    return df.withColumn(column, F.explode(F.array(F.col(column), F.lit(name))))


def paired(scores: DataFrame, base: str, seed: int = 7) -> DataFrame:
    """(arm, class_name, n, unpaired, difference, low, high, counts): each arm against ``base`` on the questions both have, by class and pooled.

    scores: arm, class_name, question, score (one row a question).  ``unpaired`` are the questions that one of the two lacks; a difference
    ``counts`` when its interval leaves 0 out.
    """
    own = with_pooled(scores.where(F.col("arm") != base), "class_name").withColumnRenamed("score", "__x")
    ref = with_pooled(scores.where(F.col("arm") == base), "class_name").select("class_name", "question", F.col("score").alias("__y"))
    arms = F.broadcast(own.select("arm").distinct())
    both = own.join(arms.join(ref), ["arm", "class_name", "question"], "full")  # the base's questions once an arm
    counts = both.groupBy("arm", "class_name").agg(F.count_if(F.col("__x").isNull() | F.col("__y").isNull()).alias("unpaired"))
    met = both.where("__x is not null and __y is not null").withColumn("__d", F.col("__x") - F.col("__y"))
    got = bootstrap_of(met, ["arm", "class_name"], "question", {"top": F.col("__d"), "bottom": F.lit(1.0)}, ratio, seed=seed)
    out = counts.join(got, ["arm", "class_name"], "left")
    counting = (F.col("low") > 0) | (F.col("high") < 0)
    return out.select("arm", "class_name", F.coalesce("n", F.lit(0)).alias("n"), "unpaired", F.col("estimate").alias("difference"), "low", "high", F.coalesce(counting, F.lit(False)).alias("counts"))


def verdict(met: Column, n: Column) -> Column:
    """not testable without a value, directional below DIRECTIONAL questions, else whether it was met."""
    return F.when(met.isNull(), "not testable").when(is_directional(n), F.when(met, "met (directional)").otherwise("not met (directional)")).otherwise(F.when(met, "met").otherwise("not met"))


def tied_cheapest(scores: DataFrame, costs: DataFrame, differences: DataFrame) -> DataFrame:
    """(class_name, best, tied, chosen): the arm of best mean (ties by name), the arms whose difference to it may be 0, and the cheapest of these.

    scores: class_name, arm, mean; costs: class_name, arm, cost; differences: class_name, best, arm, low, high.
    """
    best = scores.groupBy("class_name").agg(F.min_by("arm", F.struct((-F.col("mean")).alias("m"), "arm")).alias("best"))
    near = differences.join(best, ["class_name", "best"]).where("low <= 0 and high >= 0").select("class_name", "arm")
    tied = near.unionByName(best.select("class_name", F.col("best").alias("arm"))).distinct()
    priced = tied.join(costs, ["class_name", "arm"], "left")
    chosen = priced.groupBy("class_name").agg(F.array_join(F.array_sort(F.collect_set("arm")), " ").alias("tied"), F.min_by("arm", F.struct(F.coalesce("cost", F.lit(float("inf"))), "arm")).alias("chosen"))
    return best.join(chosen, "class_name").select("class_name", "best", "tied", "chosen")


def eval_problems(items: DataFrame, classes: list[str], splits: list[str]) -> DataFrame:
    """(item, rule) of every rule that an evaluation set breaks: blank_id, repeated_id, blank_question, blank_passage, unknown_class, unknown_split, repeated_question.

    items: item_id, question, passage, class_name, split.  A repeated question is told of every item but its first.
    """
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    key = F.trim(F.regexp_replace(F.lower("question"), r"[ \t\r\n]+", " "))
    rows = items.withColumn("__times", F.count(F.lit(1)).over(Window.partitionBy("item_id"))).withColumn("__first", F.min("item_id").over(Window.partitionBy(key)))
    rules = {
        "blank_id": blank("item_id"), "repeated_id": F.col("__times") > 1, "blank_question": blank("question"), "blank_passage": blank("passage"), "unknown_class": ~F.coalesce(F.col("class_name").isin(*classes), F.lit(False)),
        "unknown_split": ~F.coalesce(F.col("split").isin(*splits), F.lit(False)), "repeated_question": ~blank("question") & (F.col("item_id") != F.col("__first")),
    }
    held = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda r: r.isNotNull())
    return rows.select(F.coalesce("item_id", F.lit("?")).alias("item"), F.explode(held).alias("rule")).distinct()


def judge_comparison(candidate: DataFrame, reference: DataFrame) -> DataFrame:
    """One row (compared, agreement, gap, missing): verdicts of two judges item by item; ``missing`` is the share of the reference's items the candidate lacks.

    Both: item, verdict (boolean), score.  Items of the candidate alone are not compared.
    """
    both = reference.select("item", F.col("verdict").alias("__r"), F.col("score").alias("__x")).join(candidate.select("item", F.col("verdict").alias("__c"), F.col("score").alias("__y")), "item", "left")
    met = F.col("__c").isNotNull() & F.col("__r").isNotNull()
    return both.agg(
        F.count_if(met).alias("compared"), F.avg(F.when(met, (F.col("__c") == F.col("__r")).cast("double"))).alias("agreement"), F.avg(F.when(met, F.abs(F.col("__x") - F.col("__y")))).alias("gap"),
        (F.count_if(F.col("__c").isNull()) / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("missing"),
    )


def pair_scores(pairs: DataFrame, population: DataFrame) -> DataFrame:
    """One row (pairs, precision, recall): of predicted links against labels, each labelled pair weighted by its stratum's population over its labelled pairs.

    pairs: stratum, same, predicted; population: stratum, population.  Null where nothing was predicted, or nothing is the same.
    """
    labelled = pairs.groupBy("stratum").agg(F.count(F.lit(1)).alias("__n"))
    w = labelled.join(population, "stratum").select("stratum", (F.col("population") / F.col("__n")).alias("__w"))
    weighted = lambda c: F.sum(F.when(c, F.col("__w")).otherwise(0.0))
    both, said, true = weighted(F.col("same") & F.col("predicted")), weighted(F.col("predicted")), weighted(F.col("same"))
    return pairs.join(F.broadcast(w), "stratum").agg(F.count(F.lit(1)).alias("pairs"), (both / F.nullif(said, F.lit(0.0))).alias("precision"), (both / F.nullif(true, F.lit(0.0))).alias("recall"))


def sweep(pairs: DataFrame, configs: dict[str, Column]) -> DataFrame:
    """(config, merged, right, wrong, lost): labelled pairs under every configuration's predicate, in one pass."""
    marks = F.array(*[F.struct(F.lit(k).alias("config"), F.coalesce(c, F.lit(False)).alias("hit")) for k, c in configs.items()])
    rows = pairs.select("same", F.explode(marks).alias("x")).select("same", "x.config", "x.hit")
    return rows.groupBy("config").agg(F.count_if("hit").alias("merged"), F.count_if(F.col("hit") & F.col("same")).alias("right"), F.count_if(F.col("hit") & ~F.col("same")).alias("wrong"), F.count_if(~F.col("hit") & F.col("same")).alias("lost"))


def cached_cost(input_tokens: Column, cached: Column, output_tokens: Column, price: tuple[float, float, float]) -> Column:
    """Cost where ``cached`` of the input tokens are read from a cache; price: of a million input, cached and output tokens."""
    part = F.least(F.coalesce(cached, F.lit(0)), input_tokens)
    return ((input_tokens - part) * price[0] + part * price[1] + output_tokens * price[2]) / 1e6


def choose_option(scores: DataFrame, option: str) -> DataFrame:
    """One row: the option of best mean over classes after rounding to 9 places, ties to the smaller option.  scores: option, class_name, value."""
    mean = scores.groupBy(option).agg(F.round(F.avg("value"), 9).alias("mean"))
    return mean.orderBy(F.desc("mean"), option).limit(1)


def filter_report(outcomes: DataFrame) -> DataFrame:
    """(class_name, n, exact, excluded): questions whose filter equals its label as a set, and whose gold is partly outside of the filter.

    outcomes: class_name, allowed, label, gold (arrays; a null ``allowed`` lets everything through).
    """
    same = F.array_sort(F.array_distinct("allowed")).eqNullSafe(F.array_sort(F.array_distinct("label")))
    outside = F.when(F.col("allowed").isNotNull(), F.size(F.array_except("gold", "allowed")) > 0).otherwise(False)
    return outcomes.groupBy("class_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("exact"), F.count_if(outside).alias("excluded"))


def named_but_absent(named: Column, seen: Column) -> Column:
    """The companies a question names that none of its results is of; only where it names two or more, else none."""
    return F.when(F.size(F.array_distinct(named)) >= 2, F.array_sort(F.array_except(named, seen))).otherwise(F.array().cast("array<string>"))


def relation_holds(relation: Column, gold: Column, company: Column, period: Column, section: Column) -> Column:
    """Whether a hard negative stands to all gold rows (structs company, period, section) in its relation.

    other_company: all are of another company; other_period: all of its company, none of its period; other_section: all of its company and period, none of its section.
    """
    mine = F.forall(gold, lambda g: g["company"] == company)
    when = F.forall(gold, lambda g: g["period"] == period)
    return (
        F.when(F.size(gold) <= 0, F.lit(None).cast("boolean")).when(relation == "other_company", F.forall(gold, lambda g: g["company"] != company))
        .when(relation == "other_period", mine & F.forall(gold, lambda g: g["period"] != period)).when(relation == "other_section", mine & when & F.forall(gold, lambda g: g["section"] != section))
    )


def markdown_rows(df: DataFrame, columns: list[str], key: str = "place") -> DataFrame:
    """(place, line): a table as markdown lines, the two of the header first, then the rows in order of all columns."""
    head = "| " + " | ".join(columns) + " |"
    rows = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns]), F.lit(" |")).alias("line"), *columns)
    placed = rows.withColumn(key, F.row_number().over(Window.orderBy(*columns)) + 1).select(key, "line")  # a table to be read: few rows
    return df.sparkSession.createDataFrame([(0, head), (1, "| " + " | ".join("---" for _ in columns) + " |")], f"{key} int, line string").unionByName(placed)


def by_relation(hits: DataFrame, by: str, question: str, relation: str) -> DataFrame:
    """(by, relation, hits, rate, of_wrong): questions with a hit of each relation, as a share of all questions and of those with any hit.

    hits: a row a question and hit; a question without one has a null relation.
    """
    per = hits.groupBy(by, question).agg(F.bool_or(F.col(relation).isNotNull()).alias("__hit")).groupBy(by).agg(F.count(F.lit(1)).alias("__all"), F.count_if("__hit").alias("__wrong"))
    n = hits.where(F.col(relation).isNotNull()).groupBy(by, relation).agg(F.count_distinct(question).alias("hits"))
    return n.join(per, by).select(by, relation, "hits", (F.col("hits") / F.col("__all")).alias("rate"), (F.col("hits") / F.nullif(F.col("__wrong"), F.lit(0))).alias("of_wrong"))
