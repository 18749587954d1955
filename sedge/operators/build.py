"""Building the graph from extraction files: canonical keys, dropped items, merged records, and the rules a batch has to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedge.operators.graph import confidence_rank
from sedge.operators.skew import FEW, hot_keys, salted_join
from sedge.session import cut

# fixed values: the ontology
STRUCTURAL = ("Company", "Filing", "Period", "Chunk")
EXTRACTED = ("Organization", "Segment", "MarketPlatform", "Product", "RiskFactor", "Regulation", "LegalProceeding", "Agreement", "Facility", "Person", "MetricValue")
FIRMS = ("Company", "Organization")
EDGES = {
    "FILED": (("Company",), ("Filing",)),
    "COVERS_PERIOD": (("Filing",), ("Period",)),
    "PART_OF": (("Chunk",), ("Filing",)),
    "EVIDENCED_BY": (EXTRACTED, ("Chunk",)),
    "HAS_SEGMENT": (("Company",), ("Segment",)),
    "HAS_MARKET_PLATFORM": (("Company",), ("MarketPlatform",)),
    "OFFERS": (("Company", "Segment", "MarketPlatform"), ("Product",)),
    "DISCLOSES": (("Filing",), ("RiskFactor",)),
    "AFFECTS": (("RiskFactor",), ("Segment", "MarketPlatform", "Product")),
    "PERSISTS_AS": (("RiskFactor",), ("RiskFactor",)),
    "REPORTS": (("Filing",), ("MetricValue",)),
    "MEASURES": (("MetricValue",), ("Company", "Segment", "MarketPlatform", "Product")),
    "SUPPLIES": (FIRMS, FIRMS),
    "CUSTOMER_OF": (FIRMS, FIRMS),
    "COMPETES_WITH": (FIRMS, FIRMS),
    "OWNS": (FIRMS, ("Organization", "Facility")),
    "PARTY_TO": (FIRMS, ("Agreement",)),
    "CONCERNS": (("Agreement",), ("Company", "Organization", "Product", "Facility")),
    "SUBJECT_TO": (("Company", "Product"), ("Regulation",)),
    "INVOLVED_IN": (FIRMS, ("LegalProceeding",)),
    "HOLDS_ROLE_AT": (("Person",), ("Company",)),
    "IN_COMMUNITY": (tuple(x for x in EXTRACTED if x != "MetricValue"), ("Community",)),
    "PARENT_OF": (("Community",), ("Community",)),
}
SYMMETRIC = ("COMPETES_WITH",)
WITH_ROLE = ("INVOLVED_IN", "HOLDS_ROLE_AT")
FILER_SCOPED = ("Segment", "MarketPlatform")
NODE_PROPERTIES = {"RiskFactor": {"title": "string"}, "MetricValue": {"concept": "string", "value": "number", "unit": "string", "period": "string"}}
RESERVED = ("key", "ontology_version")


def allowed_pairs(spark: SparkSession) -> DataFrame:
    """The ontology as (type, start_label, end_label): a fixed list of some hundred rows."""
    return spark.createDataFrame([(t, a, b) for t, (starts, ends) in EDGES.items() for a in starts for b in ends], "type string, start_label string, end_label string")


def label_of(key: Column) -> Column:
    """The label a node key begins with."""
    return F.split_part(key, F.lit(":"), F.lit(1))


def canonical(rows: DataFrame, alias: DataFrame, column: str, hot: list | None = None) -> DataFrame:
    """``rows`` with ``column`` replaced by its canonical key where ``alias`` (key, canonical; one row a key) has one; null stays null.  ``hot`` as in ``salted_join``."""
    named = salted_join(rows, alias.select(F.col("key").alias(column), F.col("canonical").alias("__to")), column, "left", hot=hot)
    return named.withColumn(column, F.coalesce("__to", column)).drop("__to")


def metrics_without_subject(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, key): metric nodes that no MEASURES edge of their own file starts at."""
    held = edges.where("type = 'MEASURES'").select("file", F.col("start").alias("key")).distinct()
    return nodes.where("label = 'MetricValue' and file is not null and key is not null").select("file", "key").distinct().join(held, ["file", "key"], "left_anti")


def with_drop_reason(edges: DataFrame, alias: DataFrame, skipped: DataFrame) -> DataFrame:
    """``edges`` between canonical keys with ``reason``: skipped_metric, self_loop or disallowed_endpoint, the first that holds, or null.

    edges: file, type, start, end, ...; skipped: key.  A key that stands for several is compared after it was mapped, a skipped metric before.
    """
    gone = skipped.select(F.col("key").alias("__key")).distinct().withColumn("__gone", F.lit(True))
    e = edges
    for end in ("start", "end"):
        e = e.join(gone.select(F.col("__key").alias(end), F.col("__gone").alias(f"__{end}")), end, "left")
    e, alias = cut(e), cut(alias)
    few = e.count() <= FEW  # heavy ends are looked for once, on what was written, and not among few edges
    for end in ("start", "end"):
        e = canonical(e, alias, end, [] if few else hot_keys(e, end))
    e = e.withColumn("start_label", label_of(F.col("start"))).withColumn("end_label", label_of(F.col("end")))
    pairs = F.broadcast(allowed_pairs(edges.sparkSession).withColumn("__pair", F.lit(True)))
    e = e.join(pairs, ["type", "start_label", "end_label"], "left")
    reason = F.when(F.col("__start") | F.col("__end"), "skipped_metric").when(F.col("start") == F.col("end"), "self_loop").when(F.col("__pair").isNull(), "disallowed_endpoint")
    return e.withColumn("reason", reason).drop("__start", "__end", "__pair")


def node_records(nodes: DataFrame, alias: DataFrame) -> DataFrame:
    """(key, label, name, aliases, chunks, best): one row per canonical key.

    nodes: key, name, chunk, confidence, at, id.  The name is that of the latest entry, ``aliases`` are the other keys in order, ``chunks`` the
    number of distinct chunks, ``best`` the best confidence rank.
    """
    named = canonical(nodes.where("key is not null").withColumn("own", F.col("key")), alias, "key")
    g = named.groupBy("key").agg(
        F.max_by("name", F.struct("at", "id")).alias("name"), F.array_sort(F.collect_set("own")).alias("owns"), F.count_distinct("chunk").alias("chunks"), F.max(confidence_rank(F.col("confidence"))).alias("best")
    )
    return g.select("key", label_of(F.col("key")).alias("label"), "name", F.array_remove("owns", F.col("key")).alias("aliases"), "chunks", "best")


def edge_records(kept: DataFrame) -> DataFrame:
    """(type, start, end, role, chunks, entries, stake): one row per edge identity; edges of symmetric types run from the smaller key.

    kept: type, start, end, role, chunk, confidence, stake, at, id.  The stake is that of best confidence, the later of equal ones.
    """
    swap = F.col("type").isin(*SYMMETRIC) & (F.col("start") > F.col("end"))
    e = kept.withColumn("__s", F.when(swap, F.col("end")).otherwise(F.col("start"))).withColumn("end", F.when(swap, F.col("start")).otherwise(F.col("end"))).withColumn("start", F.col("__s"))
    rank = F.when(F.col("stake").isNotNull(), F.struct(confidence_rank(F.col("confidence")), "at", "id"))
    return e.groupBy("type", "start", "end", "role").agg(F.count_distinct("chunk").alias("chunks"), F.count(F.lit(1)).alias("entries"), F.max_by("stake", rank).alias("stake"))


def stake_conflicts(kept: DataFrame) -> DataFrame:
    """(type, start, end, role, kept, other): every stake that lost against the one kept."""
    keys = ["type", "start", "end", "role"]
    records = edge_records(kept).where("stake is not null").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("stake").alias("kept"))
    others = kept.where("stake is not null").select(*keys, F.col("stake").alias("other")).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return others.join(records, same).where("kept <> other").select(*keys, "kept", "other")


def persistence_edges(links: DataFrame, nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(later, earlier, reason): links between filings as edges; ``reason`` is why one may not be written, or null.

    links: later, earlier, chunk; nodes: key; evidence: key, chunk.  Rules in order: several_predecessors, unknown_endpoint,
    foreign_chunk (the cited chunk is no evidence of the later node).
    """
    known = nodes.select("key").distinct()
    one = links.distinct().withColumn("__n", F.min("earlier").over(Window.partitionBy("later")) != F.max("earlier").over(Window.partitionBy("later")))
    for end in ("later", "earlier"):
        one = one.join(known.select(F.col("key").alias(end), F.lit(True).alias(f"__{end}")), end, "left")
    own = evidence.select(F.col("key").alias("later"), "chunk").distinct().withColumn("__own", F.lit(True))
    one = one.join(own, ["later", "chunk"], "left")
    reason = F.when(F.col("__n"), "several_predecessors").when(F.col("__later").isNull() | F.col("__earlier").isNull(), "unknown_endpoint").when(F.col("__own").isNull(), "foreign_chunk")
    return one.select("later", "earlier", reason.alias("reason"))


def _blank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (F.trim(c) == "")


def _rules(rows: DataFrame, item: str, rules: dict[str, Column]) -> DataFrame:
    """(item, rule) of the rules that hold for a row."""
    held = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]), lambda r: r.isNotNull())
    return rows.select(F.col(item).alias("item"), F.explode(held).alias("rule"))


def _wrong(kind: Column, value: Column) -> Column:
    return (kind == "number") & value.try_cast("double").isNull()


def batch_violations(nodes: DataFrame, edges: DataFrame, known_chunks: DataFrame, known_nodes: DataFrame) -> DataFrame:
    """(item, rule) of every rule that a batch breaks; an item breaks a rule once.

    nodes: key, label, props (map of strings), chunks, spans, confidences (arrays); edges: item, type, start_label, start, end_label, end, props,
    chunks, spans, confidences; known_chunks: chunk; known_nodes: label, key.  Evidence of an item is its three arrays, which have to be of one
    length, name known chunks once each, and hold no blank span or unknown confidence.
    """
    spark = nodes.sparkSession
    n = nodes.withColumn("item", F.concat_ws("/", F.coalesce("label", F.lit("?")), F.coalesce("key", F.lit("?"))))
    specs = spark.createDataFrame([(k, p, t) for k, props in NODE_PROPERTIES.items() for p, t in props.items()], "label string, prop string, kind string")
    extracted, structural = F.col("label").isin(*EXTRACTED), F.col("label").isin(*STRUCTURAL, "Community")
    scoped = F.col("label").isin(*FILER_SCOPED) & ~_blank("key") & ~F.col("key").rlike(r"(?s)^(?:Segment|MarketPlatform):[0-9]+:\S.*$")
    lengths = (F.size("chunks") != F.size("spans")) | (F.size("chunks") != F.size("confidences"))
    evidence = {
        "evidence_length_mismatch": lengths, "duplicate_chunk": F.size(F.array_distinct("chunks")) < F.size("chunks"),
        "missing_property": F.exists("spans", lambda s: _blank(s)), "disallowed_value": F.exists("confidences", lambda c: confidence_rank(c) == 0) | F.exists("confidences", lambda c: c.isNull()),
    }
    out = _rules(n, "item", {
        "unknown_label": ~(extracted | structural) | F.col("label").isNull(), "bad_key": scoped, "missing_property": _blank("key"), "missing_evidence": extracted & (F.size("chunks") <= 0),
        "unexpected_evidence": structural & (F.size("chunks") > 0), "reserved_property": F.exists(F.map_keys("props"), lambda k: k.isin(*RESERVED)),
    })
    out = out.unionByName(_rules(n.where(extracted), "item", evidence))
    twice = n.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("item", F.lit("duplicate_item").alias("rule"))
    given = n.where(extracted).select("item", "label", F.explode_outer("props").alias("prop", "value")).where("prop is not null").where(~F.col("prop").isin("name", *RESERVED))
    checked = given.join(F.broadcast(specs), ["label", "prop"], "left")
    props = _rules(checked, "item", {"unknown_property": F.col("kind").isNull(), "wrong_type": _wrong(F.col("kind"), F.col("value"))})
    wanted = n.join(F.broadcast(specs), "label").where(~F.coalesce(F.array_contains(F.map_keys("props"), F.col("prop")), F.lit(False))).select("item", F.lit("missing_property").alias("rule"))
    chunks = known_chunks.select("chunk").distinct()
    e_rules = dict(evidence)
    types = F.col("type").isin(*EDGES)
    e_rules |= {
        "unknown_edge_type": ~types | F.col("type").isNull(), "bad_reference": _blank("start") | _blank("end"), "missing_evidence": types & ~F.col("type").isin("FILED", "COVERS_PERIOD", "PART_OF", "EVIDENCED_BY", "IN_COMMUNITY", "PARENT_OF") & (F.size("chunks") <= 0),
        "missing_role": F.col("type").isin(*WITH_ROLE) & _blank(F.col("props")["role"]), "stake": (F.col("type") == "OWNS") & ~F.coalesce(F.col("props")["stake"].try_cast("double").between(0, 1), F.col("props")["stake"].isNull()),
    }
    of_edges = _rules(edges, "item", e_rules)
    of_edges = of_edges.withColumn("rule", F.when(F.col("rule") == "missing_role", "missing_property").when(F.col("rule") == "stake", "disallowed_value").otherwise(F.col("rule")))
    pairs = F.broadcast(allowed_pairs(spark).withColumn("__pair", F.lit(True)))
    ends = edges.where(types).join(pairs, ["type", "start_label", "end_label"], "left").where("__pair is null").select("item", F.lit("disallowed_endpoint").alias("rule"))
    held = n.select("label", "key").unionByName(known_nodes.select("label", "key")).distinct()
    endpoints = edges.select("item", F.col("start_label").alias("label"), F.col("start").alias("key")).unionByName(edges.select("item", F.col("end_label").alias("label"), F.col("end").alias("key")))
    lost = endpoints.where("key is not null").join(held, ["label", "key"], "left_anti").select("item", F.lit("unknown_endpoint").alias("rule"))
    cited = n.select("item", F.explode("chunks").alias("chunk")).unionByName(edges.select("item", F.explode("chunks").alias("chunk")))
    unknown = cited.where("chunk is not null").join(chunks, "chunk", "left_anti").select("item", F.lit("unknown_chunk").alias("rule"))
    for more in (twice, props, wanted, of_edges, ends, lost, unknown):
        out = out.unionByName(more)
    return out.distinct()


def graph_findings(nodes: DataFrame, edges: DataFrame, chunk_filings: DataFrame) -> DataFrame:
    """(check, item) of everything wrong with a stored graph.

    nodes: key, labels (array), name; edges: type, start_label, start, end_label, end, chunks (array); chunk_filings: chunk, filing as the chunk store has them.
    Checks: node_labels (exactly one label of the ontology), edge_types, endpoints, node_properties (an extracted node has a name),
    node_evidence (an extracted node is the start of an EVIDENCED_BY), edge_evidence (an extracted edge cites a chunk), structure (a filing has one
    FILED and one COVERS_PERIOD, a chunk one PART_OF, to its own filing), postgres_chunks (chunks of graph and store are the same).
    """
    spark = nodes.sparkSession
    known = F.array(*[F.lit(x) for x in (*STRUCTURAL, *EXTRACTED, "Community")])
    n = nodes.withColumn("label", F.get(F.array_intersect("labels", known), 0)).withColumn("__n", F.size(F.array_intersect("labels", known)))
    extracted = F.col("label").isin(*EXTRACTED)
    found = n.where("__n <> 1").select(F.lit("node_labels").alias("check"), F.col("key").alias("item"))
    found = found.unionByName(n.where(extracted & _blank("name")).select(F.lit("node_properties").alias("check"), F.col("key").alias("item")))
    item = F.concat_ws(" ", "start", "type", "end").alias("item")
    found = found.unionByName(edges.where(~F.col("type").isin(*EDGES)).select(F.lit("edge_types").alias("check"), item))
    pairs = F.broadcast(allowed_pairs(spark))
    found = found.unionByName(edges.where(F.col("type").isin(*EDGES)).join(pairs, ["type", "start_label", "end_label"], "left_anti").select(F.lit("endpoints").alias("check"), item))
    held = edges.where("type = 'EVIDENCED_BY'").select(F.col("start").alias("key")).distinct()
    found = found.unionByName(n.where(extracted).join(held, "key", "left_anti").select(F.lit("node_evidence").alias("check"), F.col("key").alias("item")))
    inner = ~F.col("type").isin("FILED", "COVERS_PERIOD", "PART_OF", "EVIDENCED_BY", "IN_COMMUNITY", "PARENT_OF")
    found = found.unionByName(edges.where(inner & (F.coalesce(F.size("chunks"), F.lit(0)) <= 0)).select(F.lit("edge_evidence").alias("check"), item))
    for type_, end, label in (("FILED", "end", "Filing"), ("COVERS_PERIOD", "start", "Filing"), ("PART_OF", "start", "Chunk")):
        counts = edges.where(F.col("type") == type_).groupBy(F.col(end).alias("key")).agg(F.count(F.lit(1)).alias("c"))
        off = n.where(F.col("label") == label).join(counts, "key", "left").where("coalesce(c, 0) <> 1")
        found = found.unionByName(off.select(F.lit("structure").alias("check"), F.concat_ws(" ", "key", F.lit(type_)).alias("item")))
    parts = edges.where("type = 'PART_OF'").select(F.col("start").alias("chunk"), F.col("end").alias("in_graph"))
    both = parts.join(chunk_filings.select("chunk", F.col("filing").alias("in_store")), "chunk", "full").where("not (in_graph <=> in_store)")
    return found.unionByName(both.select(F.lit("postgres_chunks").alias("check"), F.col("chunk").alias("item"))).distinct()


def validation_report(findings: DataFrame, checks: list[str], examples: int = 3) -> DataFrame:
    """(check, findings, examples): every check with its count and its first items; a check without findings has 0 and none."""
    listed = findings.sparkSession.createDataFrame([(c,) for c in checks], "check string")
    counts = findings.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    first = findings.withColumn("__r", F.row_number().over(Window.partitionBy("check").orderBy("item"))).where(F.col("__r") <= examples)
    shown = first.groupBy("check").agg(F.array_sort(F.collect_list("item")).alias("examples"))
    out = F.broadcast(listed).join(counts, "check", "left").join(shown, "check", "left")
    return out.select("check", F.coalesce("n", F.lit(0)).alias("findings"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def anchor_nodes(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(key, label, name, filings): nodes a question can be anchored at, with the filings of their evidence in order.

    nodes: key, label, name; evidence: key, chunk.  A node without evidence has an empty list.
    """
    of = evidence.where("chunk is not null").groupBy("key").agg(F.array_sort(F.collect_set(F.regexp_replace("chunk", ":[^:]*$", ""))).alias("filings"))
    return nodes.join(of, "key", "left").select("key", "label", "name", F.coalesce("filings", F.array().cast("array<string>")).alias("filings"))


def chunk_confidence(evidence: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk, best, edges): the best confidence rank of all node evidence and edges that cite a chunk, and how many edges do; 0 where nothing does.

    evidence: chunk, confidence; edges: edge, chunk, confidence; chunks: chunk.
    """
    rows = evidence.select("chunk", confidence_rank(F.col("confidence")).alias("r"), F.lit(None).cast("string").alias("edge")).unionByName(edges.select("chunk", confidence_rank(F.col("confidence")).alias("r"), F.col("edge").cast("string").alias("edge")))
    best = rows.groupBy("chunk").agg(F.max("r").alias("best"), F.count_distinct("edge").alias("edges"))
    return chunks.select("chunk").distinct().join(best, "chunk", "left").select("chunk", F.coalesce("best", F.lit(0)).alias("best"), F.coalesce("edges", F.lit(0)).alias("edges"))


def support_trace(retrieved: DataFrame, reach: DataFrame) -> DataFrame:
    """(chunk, support): of each retrieved chunk the anchors that reach it as ``anchor via edge``, in order; empty where none does.

    retrieved: chunk; reach: anchor, chunk, edge (null for the anchor's own evidence).
    """
    line = F.concat_ws(" via ", "anchor", F.coalesce("edge", F.lit("own evidence")))
    of = reach.groupBy("chunk").agg(F.array_sort(F.collect_set(line)).alias("support"))
    return retrieved.select("chunk").distinct().join(of, "chunk", "left").select("chunk", F.coalesce("support", F.array().cast("array<string>")).alias("support"))


def community_graph(edges: DataFrame, evidence: DataFrame, per_chunk: int = 40) -> tuple[DataFrame, DataFrame]:
    """(pairs, nodes): undirected weights of extracted edges and of nodes cited by one chunk, and all nodes, those without an edge too.

    edges: start, end; evidence: key, chunk; metric values are left out.  A chunk with more than ``per_chunk`` nodes (a list of names) says nothing of any
    two of them: its nodes are joined to the first one instead of to each other, so that no group forms all pairs.
    """
    own = evidence.where((label_of(F.col("key")) != "MetricValue") & F.col("chunk").isNotNull()).select("key", "chunk").distinct()
    sized = own.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("chunk"))).withColumn("first", F.min("key").over(Window.partitionBy("chunk")))
    few = sized.where(F.col("n") <= per_chunk)
    near = few.select("chunk", F.col("key").alias("a")).join(few.select("chunk", F.col("key").alias("b")), "chunk").where("a < b").select("a", "b", F.lit("shared").alias("kind"))
    far = sized.where((F.col("n") > per_chunk) & (F.col("key") != F.col("first"))).select(F.col("first").alias("a"), F.col("key").alias("b"), F.lit("shared").alias("kind"))
    e = edges.where((label_of(F.col("start")) != "MetricValue") & (label_of(F.col("end")) != "MetricValue") & (F.col("start") != F.col("end")))
    linked = e.select(F.least("start", "end").alias("a"), F.greatest("start", "end").alias("b"), F.lit("extracted").alias("kind"))
    both = near.unionByName(far).unionByName(linked)
    pairs = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"), F.count_if(F.col("kind") == "extracted").alias("extracted"))
    return pairs, own.select("key").distinct()


def community_findings(communities: DataFrame, members: DataFrame, cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """(check, item) of what is wrong with a stored community tree.

    communities: community_id, level, parent, member_hash; members: community_id, node; cited: community_id, chunk (of reports); evidence: node, chunk.  Checks: parent (a lower one
    without a known top one, or a top one with one), members (none, or a member of several communities of a level), hash (not that of the members), citation (a chunk that is no
    evidence of a member).
    """
    tops = communities.where("level = 'top'").select(F.col("community_id").alias("parent"), F.lit(True).alias("__top"))
    linked = communities.join(tops, "parent", "left")
    orphan = linked.where("(level = 'lower' and __top is null) or (level = 'top' and parent is not null)").select(F.lit("parent").alias("check"), F.col("community_id").alias("item"))
    own = members.distinct().groupBy("community_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("node"))), 256).alias("__hash"))
    hashed = communities.join(own, "community_id", "left")
    empty = hashed.where("__hash is null").select(F.lit("members").alias("check"), F.col("community_id").alias("item"))
    other = hashed.where("__hash <> member_hash").select(F.lit("hash").alias("check"), F.col("community_id").alias("item"))
    twice = members.distinct().join(communities.select("community_id", "level"), "community_id").groupBy("level", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("members").alias("check"), F.col("node").alias("item"))
    held = members.join(evidence, "node").select("community_id", "chunk").distinct()
    foreign = cited.distinct().join(held, ["community_id", "chunk"], "left_anti").select(F.lit("citation").alias("check"), F.concat_ws(" ", "community_id", "chunk").alias("item"))
    return orphan.unionByName(empty).unionByName(other).unionByName(twice).unionByName(foreign).distinct()
