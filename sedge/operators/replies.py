"""Model replies: metric subjects, flags, outcomes and merges of extraction; map and report replies of retrieval; routing maps; corruptions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import floor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions.text import changed_number
from sedge.operators.graph import confidence_rank
from sedge.operators.linking import agree, resolution
from sedge.operators.metrics import wilson
from sedge.operators.skew import salted_join

SUBJECTS = ("Company", "Segment", "MarketPlatform", "Product")


def metric_subjects(nodes: DataFrame, triples: DataFrame) -> DataFrame:
    """(chunk_id, id, subject, reason): the one subject each metric's MEASURES triples name in its own reply.

    nodes: chunk_id, id, label, reason; triples: chunk_id, start, type, end.  ``reason`` is endpoint_node_rejected where no end is a sound node and one is
    none at all, else missing_property where there is not exactly one sound subject, else null.
    """
    metrics = nodes.where("label = 'MetricValue' and reason is null").select("chunk_id", "id").distinct()
    sound = nodes.where("reason is null").select("chunk_id", F.col("id").alias("end"), F.col("label").alias("end_label")).distinct()
    measures = triples.where(F.lower("type") == "measures").select("chunk_id", F.col("start").alias("id"), "end").where("end is not null").distinct()
    ends = measures.join(sound, ["chunk_id", "end"], "left")
    good = F.col("end_label").isin(*SUBJECTS)
    per = ends.groupBy("chunk_id", "id").agg(F.count_if(good).alias("n"), F.min(F.when(good, F.col("end"))).alias("subject"), F.count_if(F.col("end_label").isNull()).alias("lost"))
    n, lost = F.coalesce("n", F.lit(0)), F.coalesce("lost", F.lit(0))
    reason = F.when((n == 0) & (lost > 0), "endpoint_node_rejected").when(n != 1, "missing_property")
    return metrics.join(per, ["chunk_id", "id"], "left").select("chunk_id", "id", F.when(n == 1, F.col("subject")).alias("subject"), reason.alias("reason"))


def node_flags(nodes: DataFrame) -> DataFrame:
    """(chunk_id, id, flag): accepted nodes whose name does not stand in their span (case and blanks do not count), and uncertain ones."""
    even = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    flags = F.array_compact(F.array(F.when(~F.coalesce(F.contains(even("evidence_span"), even("name")), F.lit(False)), F.lit("name_not_in_span")), F.when(confidence_rank(F.col("confidence")) == 1, F.lit("uncertain"))))
    return nodes.where("reason is null").select("chunk_id", "id", F.explode(flags).alias("flag"))


def filing_outcomes(replies: DataFrame, nodes: DataFrame) -> DataFrame:
    """(filing, chunks, failed, accepted, rejected, complete): the run of each filing; it is complete when every reply could be read and nothing was rejected.

    replies: chunk_id, reply (null where it could not be read); nodes: chunk_id, reason.
    """
    filing = F.regexp_replace("chunk_id", ":[^:]*$", "").alias("filing")
    r = replies.select(filing, "chunk_id", F.col("reply").isNull().alias("bad")).groupBy("filing").agg(F.count_distinct("chunk_id").alias("chunks"), F.count_if("bad").alias("failed"))
    n = nodes.select(filing, "reason").groupBy("filing").agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    zero = F.lit(0)
    out = r.join(n, "filing", "left").select("filing", "chunks", "failed", F.coalesce("accepted", zero).alias("accepted"), F.coalesce("rejected", zero).alias("rejected"))
    return out.withColumn("complete", (F.col("failed") == 0) & (F.col("rejected") == 0))


def rejection_report(checked: DataFrame, examples: int = 3) -> DataFrame:
    """(reason, n, rate, examples): rejected candidates by reason, their share of all, and the first ids in order of chunk and id.  checked: chunk_id, id, reason."""
    total = checked.agg(F.count(F.lit(1)).alias("total"))
    bad = checked.where("reason is not null").withColumn("item", F.concat_ws(" ", "chunk_id", F.coalesce("id", F.lit("?"))))
    n = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    first = bad.select("reason", "item").distinct().withColumn("r", F.row_number().over(Window.partitionBy("reason").orderBy("item"))).where(F.col("r") <= examples)
    shown = first.groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("item")), " | ").alias("examples"))
    return n.join(F.broadcast(total)).join(shown, "reason").select("reason", "n", (F.col("n") / F.col("total")).alias("rate"), "examples")


def review_summary(reviews: DataFrame, by: str = "confidence") -> DataFrame:
    """(by, n, right, accuracy, low, high, median_seconds): accuracy of a review round with its Wilson interval.  reviews: by, right (boolean), seconds."""
    g = reviews.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("right"), F.percentile("seconds", 0.5).alias("median_seconds"))
    low, high = wilson(F.col("right"), F.col("n"))
    return g.select(by, "n", "right", (F.col("right") / F.col("n")).alias("accuracy"), low.alias("low"), high.alias("high"), "median_seconds")


def merged_figures(figures: DataFrame) -> DataFrame:
    """(key, value, unit, chunk, conflicts): one figure for each key from its entries in order of (at, id).

    figures: key, value (as printed), unit, confidence, chunk, at, id.  Of each chunk the most confident entry counts, the later of equal ones.  A figure that
    agrees with the one so far replaces it if it is printed more precisely, or as precisely with no less confidence; one that does not agree replaces
    it with no less confidence, and is a conflict either way.  The entries of a key are folded in one row: as many as there are chunks that state it.
    """
    rank = confidence_rank(F.col("confidence"))
    per = figures.where("key is not null and value is not null").groupBy("key", "chunk").agg(F.min(F.struct("at", "id")).alias("first"), F.max_by(F.struct("value", "unit", rank.alias("rank"), "chunk"), F.struct(rank, "at", "id")).alias("x"))
    line = F.array_sort(F.collect_list(F.struct("first", "chunk", "x")))
    g = per.groupBy("key").agg(line.alias("line"))
    start = F.struct(F.get("line", 0)["x"].alias("x"), F.lit(0).alias("conflicts"))

    def step(acc: Column, item: Column) -> Column:
        old, new = acc["x"], item["x"]
        same = F.coalesce(agree(old["value"], old["unit"], new["value"], new["unit"]), F.lit(False))
        was, now = resolution(F.replace(old["value"], F.lit(",")), old["unit"]), resolution(F.replace(new["value"], F.lit(",")), new["unit"])
        wins = new["rank"] >= old["rank"]
        better = F.when(same, (now < was) | ((now == was) & wins)).otherwise(wins)
        return F.struct(F.when(better, new).otherwise(old).alias("x"), (acc["conflicts"] + F.when(same, 0).otherwise(1)).alias("conflicts"))

    folded = g.select("key", F.aggregate(F.slice("line", 2, F.greatest(F.size("line") - 1, F.lit(1))), start, step).alias("a"))
    return folded.select("key", "a.x.value", "a.x.unit", "a.x.chunk", "a.conflicts")


MAP_REPLY = "struct<points:array<struct<text:string,score:string,chunk_ids:array<string>>>>"


def map_points(replies: DataFrame, shown: DataFrame) -> DataFrame:
    """(community, pos, text, score, reason): the points of each community's reply; ``reason`` is why a point is refused, or null.

    replies: community, reply (JSON); shown: community, chunk.  Rules in order: text (blank), score (no whole number of 0 to 100), uncited, not_shown (it cites a
    chunk the community was not shown).  A reply that cannot be read has one row of reason ``reply``.
    """
    listed = shown.groupBy("community").agg(F.collect_set("chunk").alias("__shown"))
    r = replies.withColumn("r", F.from_json("reply", MAP_REPLY)).join(listed, "community", "left")
    broken = r.where("r.points is null").select("community", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("score"), F.lit("reply").alias("reason"))
    p = r.where("r.points is not null").select("community", "__shown", F.posexplode("r.points").alias("pos", "p"))
    score = F.when(F.col("p.score").rlike(r"^(?:[0-9]|[1-9][0-9]|100)$"), F.col("p.score").cast("int"))
    outside = F.size(F.array_except(F.col("p.chunk_ids"), F.coalesce("__shown", F.array().cast("array<string>")))) > 0
    reason = F.when(F.col("p.text").isNull() | (F.trim("p.text") == ""), "text").when(score.isNull(), "score").when(F.coalesce(F.size("p.chunk_ids"), F.lit(0)) <= 0, "uncited").when(outside, "not_shown")
    return p.select("community", "pos", F.col("p.text").alias("text"), score.alias("score"), reason.alias("reason")).unionByName(broken)


def reduced_points(points: DataFrame, budget: int) -> DataFrame:
    """(community, pos, score, place): the accepted points by falling score (0 left out), ties by community and place, while their words fit the budget; the first always."""
    ok = points.where("reason is null and score > 0").withColumn("words", F.size(F.split(F.trim("text"), r"\s+")))
    best = ok.orderBy(F.desc("score"), "community", "pos").limit(budget)  # each has a word at least, so no more can fit
    order = Window.orderBy(F.desc("score"), "community", "pos")
    so_far = best.withColumn("place", F.row_number().over(order)).withColumn("__sum", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return so_far.where((F.col("__sum") <= budget) | (F.col("place") == 1)).select("community", "pos", "score", "place")


def report_problems(reports: DataFrame, evidence: DataFrame) -> DataFrame:
    """(community, finding, reason): findings of a report that cite nothing (uncited) or a chunk that is no evidence of a member (foreign).

    reports: community, finding, chunks (array); evidence: community, chunk.
    """
    held = evidence.where("community is not null and chunk is not null").select(F.struct("community", "chunk").alias("__key")).distinct()
    cited = F.coalesce(F.size("chunks"), F.lit(0))
    uncited = reports.where(cited <= 0).select("community", "finding", F.lit("uncited").alias("reason"))
    # citations are compared one by one, never with the whole list of a community, which may be as long as the table
    one = reports.where(cited > 0).select("community", "finding", "chunks", F.posexplode(F.array_distinct("chunks")).alias("pos", "chunk")).withColumn("__key", F.struct("community", "chunk")).drop("chunk")
    outside = salted_join(one, held, "__key", "left_anti")
    # findings that are equal throughout have the same citations outside, so rows by citations give how many there were
    times = outside.groupBy("community", "finding", "chunks").agg((F.count(F.lit(1)) / F.count_distinct("pos")).cast("int").alias("times"))
    foreign = times.select("community", "finding", F.explode(F.array_repeat(F.lit("foreign"), F.col("times"))).alias("reason"))
    return uncited.unionByName(foreign)


def routing_problems(routes: DataFrame, classes: list[str], arms: list[str]) -> DataFrame:
    """(class_name, reason): a class without a route (missing) or with several, a route of an unknown class or to an unknown arm, a decline class that is answered."""
    listed = routes.sparkSession.createDataFrame([(c,) for c in classes], "class_name string")
    n = routes.groupBy("class_name").agg(F.count_distinct("arm").alias("n"), F.max((~F.coalesce(F.col("arm").isin(*arms), F.lit(False))).cast("int")).alias("bad"), F.max((F.col("arm") != "decline").cast("int")).alias("answers"), F.lit(True).alias("__r"))
    both = F.broadcast(listed.withColumn("__c", F.lit(True))).join(n, "class_name", "full")
    rules = {"missing": F.col("__r").isNull(), "unknown_class": F.col("__c").isNull(), "several": F.col("n") > 1, "unknown_arm": F.col("bad") == 1, "answered": (F.col("class_name") == "decline") & (F.col("answers") == 1)}
    return both.select("class_name", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))).alias("reason"))


def traversal_outcomes(attempts: DataFrame) -> DataFrame:
    """(question, outcome, repaired, fallback): what came of a generated query and its one repair.

    attempts: question, attempt (1 or 2), outcome (ok, invalid, error, timeout, empty).  The first ``ok`` counts, else the last attempt; anything but ``ok`` falls back.
    """
    last = attempts.where("attempt <= 2").groupBy("question").agg(F.min_by("outcome", F.struct((F.col("outcome") != "ok").cast("int"), -F.col("attempt"))).alias("outcome"), F.max("attempt").alias("n"))
    return last.select("question", "outcome", (F.col("n") > 1).alias("repaired"), (F.col("outcome") != "ok").alias("fallback"))


def first_shown(shown: DataFrame) -> DataFrame:
    """(chunk, community, place): chunks by the rank of their community, then by score, each where it comes first.  shown: community, rank, chunk, score."""
    first = shown.groupBy("chunk").agg(F.min_by("community", F.struct("rank", (-F.col("score")).alias("s"), "community")).alias("community"), F.min(F.struct("rank", (-F.col("score")).alias("s"))).alias("at"))
    return first.select("chunk", "community", F.row_number().over(Window.orderBy("at.rank", "at.s", "chunk")).alias("place"))  # over what was shown: a few chunks a community


_WORDS = re.compile(r"\S+")


def corruptions(text: str, others: list[str]) -> dict[str, str | None]:
    """Four corrupted forms of a sentence, by kind; null where a kind does not apply: a changed number, a negation, another's citation, a half sentence."""
    cites = re.findall(r"\[[^\[\]\n]+\]", text)
    other = next((o for o in others if cites and f"[{o}]" not in cites), None)
    verb = re.search(r"\b(is|are|was|were|has|have|will|can)\b(?! not)", text)
    words = list(_WORDS.finditer(text))
    return {
        "number": changed_number(text), "negation": None if verb is None else text[: verb.end()] + " not" + text[verb.end() :],
        "citation": None if other is None else text.replace(cites[0], f"[{other}]", 1), "half": text[: words[floor(len(words) / 2) - 1].end()] if len(words) >= 6 else None,
    }


def corrupted(sentences: DataFrame, key: str, text: str, others: str) -> DataFrame:
    """(key, kind, text): each sentence under the four corruptors; a kind that does not apply has a null text, so that skips can be counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, kind, new) for k, t, o in zip(pdf[key], pdf[text], pdf[others]) for kind, new in corruptions(t, [] if o is None else list(o)).items()], columns=[key, "kind", text])

    return sentences.where(F.col(text).isNotNull()).select(key, text, others).mapInPandas(run, f"{key} {dict(sentences.dtypes)[key]}, kind string, {text} string")


def metric_key(filing: Column, subject: Column, concept: Column, unit: Column, period: Column) -> Column:
    """``MetricValue:filing:subject:concept:unit:period`` with ``%`` and ``:`` of the parts escaped and words in lower case."""
    part = lambda c: F.replace(F.replace(F.lower(F.trim(c)), F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A"))
    return F.concat_ws(":", F.lit("MetricValue"), part(filing), part(subject), part(concept), part(unit), part(period))


def filer_reference(reference: Column, cik: Column, names: Column) -> Column:
    """The company key a reference names: words for the filer itself, or a known name (a map from lower case names to cik); null for others."""
    low = F.lower(F.trim(reference))
    own = low.isin("company", "the company", "registrant", "the registrant", "filer", "we", "us")
    return F.when(own, F.concat(F.lit("Company:"), cik)).otherwise(F.concat(F.lit("Company:"), F.try_element_at(names, low)))


def node_text(label: Column, name: Column, title: Column) -> Column:
    """What is embedded of a node: its label and name, of a risk factor its title; null without either."""
    shown = F.when((label == "RiskFactor") & title.isNotNull(), title).otherwise(name)
    return F.when(shown.isNotNull() & (F.trim(shown) != ""), F.concat(label, F.lit(": "), F.trim(shown)))
