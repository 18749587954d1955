"""Queries that write to the shared folder and read back: files, snapshots, stores, caches and the merge log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sedge.book import Book
from sedge.operators import store as S
from sedge.plans.store import CUR_C, CUR_F
from sedge.session import shared_folder, table
from sedge.sources import cache as K
from sedge.sources import files as I
from sedge.streaming import log as L

book = Book()
QUERIES, SQL = book.queries, book.sql


def _path(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@book.query(f"with {CUR_F} select accession_no, length(parsed_text)::bigint as n_chars, sha256(parsed_text) as text_sha256 from cf where parsed_text is not null")
def parsed_round_trip(spark, d):
    """Filings written as JSON with their hashes, read and checked."""
    f = S.current_filings(table(spark, d, "filings"), ["cik", "form_type", "fiscal_period", "parsed_text"]).where("parsed_text is not null").withColumnRenamed("parsed_text", "text")
    I.write_parsed(f.withColumn("sections", F.array().cast("array<struct<label:string,char_start:int,char_end:int>>")), at := _path(spark))
    return I.read_parsed(spark, at).select("accession_no", F.length("text").cast("long").alias("n_chars"), "text_sha256")


@book.query(f"with {CUR_C} select chunk_id, section, char_start, char_end from cc")
def snapshot_round_trip(spark, d):
    """Chunks exported in key order, imported into an empty store, checked for chunks that repeat."""
    c = S.current_chunks(table(spark, d, "chunks")).select("chunk_id", "section", "char_start", "char_end")
    I.write_snapshot({"chunks": (c, ["chunk_id"])}, at := _path(spark))
    I.import_snapshot(spark, at, {"chunks": "chunk_id string, section string, char_start int, char_end int"}, to := _path(spark), lambda t: t["chunks"].groupBy("chunk_id").count().where("count > 1"))
    return spark.read.parquet(f"{to}/chunks")


@book.query("select item_id, question from eval_items")
def numbered_lines(spark, d):
    """The evaluation set as JSON lines, read with file and line, ids unique."""
    I.write_once(table(spark, d, "eval_items").select("item_id", "question"), at := _path(spark))
    return I.read_numbered(spark, at, "item_id string, question string", "item_id").select("item_id", "question")


_LINES = "with e as (select distinct node_key as key, label, trim(chunk_id, ' ' || chr(9)) as chunk_id, span, confidence, evidence_id from evidence where node_key is not null)"


@book.query(f"{_LINES} select case when span is null then 'flag' when label = 'MetricValue' then 'edge' else 'node' end as kind, count(*) as n, count(distinct key) as keys from e group by 1")
def candidate_lines(spark, d):
    """Evidence as the lines of extraction files, read again by kind."""
    e = table(spark, d, "evidence").where("node_key is not null").select(F.col("node_key").alias("key"), "label", F.btrim("chunk_id", F.lit(" \t")).alias("chunk_id"), "span", "confidence", "evidence_id").distinct()
    I.write_once(e.withColumn("kind", F.when(F.col("span").isNull(), "flag").when(F.col("label") == "MetricValue", "edge").otherwise("node")).drop("evidence_id"), at := _path(spark))
    parts = I.read_candidates(spark, at)
    counts = [df.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys")) for df in parts.values()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@book.query(
    f"{_LINES}, f as (select key, chunk_id, min(evidence_id) as at from e where chunk_id is not null group by 1, 2), n as (select key, arg_min(span, evidence_id) filter (span is not null) as name from e group by 1) "
    "select n.key, n.name, coalesce(string_agg(f.chunk_id, ' ' order by f.at, f.chunk_id), '') as chunks from n left join f using (key) group by 1, 2"
)
def merged_files(spark, d):
    """Nodes of all extraction files: the first span as the name, chunks in order of appearance."""
    e = table(spark, d, "evidence").select(F.col("node_key").alias("key"), F.btrim("chunk_id", F.lit(" \t")).alias("chunk_id"), F.col("span").alias("name"), "evidence_id").distinct()
    return I.merged_nodes(e, ["evidence_id"]).withColumn("chunks", F.array_join("chunks", " "))


@book.query("with n as (select node_key as key, count(*) as n from evidence where node_key is not null group by 1) select key, case when key like 'Product:%' then 0 else n end as n from n")
def graph_round_trip(spark, d):
    """A graph that is rebuilt in one step, then gets a batch of products in place of its own."""
    n = table(spark, d, "evidence").where("node_key is not null").groupBy(F.col("node_key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    edges = n.select(F.col("key").alias("start"), F.col("key").alias("end")).where("start like 'Segment:%'")
    I.rebuild_graph(n, edges, at := _path(spark))
    batch = n.where("key like 'Product:%'").withColumn("n", F.lit(0).cast("long"))
    I.upsert_graph(batch, edges, n.where("false"), at, ["key"], ["start", "end"])
    return spark.read.parquet(f"{at}/nodes")


@book.query(f"with {CUR_F}, {CUR_C} select accession_no, cf.form_type = '10-K' as again, case when cf.form_type = '10-K' then 1 else count(chunk_id) end as chunks from cf left join cc using (accession_no) group by 1, 2, cf.form_type")
def loaded_filings(spark, d):
    """A store of filings into which the annual reports are loaded once more, each with one chunk instead of all."""
    f = S.current_filings(table(spark, d, "filings"), ["form_type"]).withColumn("again", F.lit(False))
    c = S.current_chunks(table(spark, d, "chunks")).where("accession_no is not null").select("accession_no", "chunk_id")
    I.load_filings(f, c, at := _path(spark))
    annual = f.where("form_type = '10-K'")
    I.load_filings(annual.withColumn("again", F.lit(True)), annual.select("accession_no", F.lit("one").alias("chunk_id")), at)
    n = spark.read.parquet(f"{at}/chunks").groupBy("accession_no").agg(F.count(F.lit(1)).alias("chunks"))
    return spark.read.parquet(f"{at}/filings").join(n, "accession_no", "left").select("accession_no", "again", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@book.query("with q as (select distinct question from eval_items where question is not null) select question, length(question)::varchar as reply, length(question) % 2 = 0 as cached from q")
def cached_replies(spark, d):
    """Requests answered from a cache, the missing ones by a model (here: the length of the text) in batches."""
    q = K.request_key(table(spark, d, "eval_items").where("question is not null").select("question").distinct(), ["question"])
    held = q.where(F.length("question") % 2 == 0).select("request_key", F.length("question").cast("string").alias("reply"))
    out, _ = K.answered(q, held, lambda texts: [str(len(t)) for t in texts], "question")
    return out.select("question", "reply", "cached")


_LOG = """with p as (select distinct pair_id, key_a, key_b, same from pair_labels where same is not null and key_a is not null and key_b is not null and key_a <> key_b), m as (select pair_id as seq, 'm' || pair_id as id, unnest([key_a, key_b]) as member, least(key_a, key_b) as canonical from p),
s as (select distinct 'm' || pair_id as id from p where not same), a as (select * from m where id not in (select id from s)), l as (select member, arg_max(canonical, (seq, canonical)) as canonical from a group by 1)"""


@book.query(f"{_LOG} select member, canonical from l where member <> canonical")
def merge_log(spark, d):
    """Labelled pairs as merges, those labelled different split again: the aliases that remain, from a log with repeated events."""
    p = table(spark, d, "pair_labels").where("same is not null and key_a is not null and key_b is not null and key_a <> key_b").select("pair_id", "key_a", "key_b", "same").distinct()
    id_ = F.concat(F.lit("m"), F.col("pair_id").cast("string")).alias("merge_id")
    merges = p.select(F.col("pair_id").alias("seq"), F.lit("merge").alias("event"), id_, F.explode(F.array("key_a", "key_b")).alias("member"), F.least("key_a", "key_b").alias("canonical"), F.lit(1).cast("long").alias("count"))
    splits = p.where("not same").select(F.col("pair_id").alias("seq"), F.lit("split").alias("event"), id_, F.lit(None).cast("string").alias("member"), F.lit(None).cast("string").alias("canonical"), F.lit(None).cast("long").alias("count")).dropDuplicates(["merge_id"])
    first = L.new_events(merges.where("false"), merges.unionByName(splits))
    again = L.new_events(first, merges)  # events sent again change nothing
    return L.aliases(first.unionByName(again))
