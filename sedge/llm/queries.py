"""Queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm.defects import defective
from sedge.llm.groups import group_pairs
from sedge.llm.leaks import leaked_items
from sedge.llm.mixing import mixture, shares, source_name, token_counts
from sedge.llm.names import linked_names, name_pairs
from sedge.llm.neighbours import similar_pairs
from sedge.llm.pieces import LIMIT, OVERLAP, chunk_stretches, oversized_pieces
from sedge.llm.sentences import fitted, found_units, sentence_units
from sedge.llm.spans import shared_shares, shared_spans
from sedge.session import table

#: A public vocabulary file; the same path on every executor.
TOKENIZER = os.environ.get("SEDGE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "chunk_embeddings").where("model = 'meridian-embed-3'")
    pairs = similar_pairs(vectors, "chunk_id", "embedding", k=5, min_sim=0.8)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_units(table(spark, sf_dir, "filings"), table(spark, sf_dir, "answers"))


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(answer_id, kept_at, sent_start, sent_end): the units of the kept texts of each answer, by their place in ``kept`` from 0."""
    answers = table(spark, sf_dir, "answers")
    kept = answers.where("kept is not null").select("answer_id", F.posexplode("kept").alias("kept_at", "s")).select("answer_id", "kept_at", F.col("s.text").alias("text"))
    return sentence_units(kept, fitted(table(spark, sf_dir, "filings"), answers), ["answer_id", "kept_at"]).distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    filings = table(spark, sf_dir, "filings")
    model = fitted(filings, table(spark, sf_dir, "answers"))
    return oversized_pieces(chunk_stretches(table(spark, sf_dir, "chunks"), filings), model)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).select("chunk_id").distinct()


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_names(table(spark, sf_dir, "resolve_nodes"), table(spark, sf_dir, "filer_entries"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(p4_links(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defective(table(spark, sf_dir, "answers"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_pairs(table(spark, sf_dir, "pair_labels"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("run >= 12").select("doc_id", "item_id")


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also the regions that differ from a passage by edits."""
    return _leaks(spark, sf_dir)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return shared_shares(docs, shared_spans(docs))


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(token_counts(table(spark, sf_dir, "documents"), TOKENIZER), table(spark, sf_dir, "mix_targets"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, n_words, within): the words of each oversized chunk as its pieces have them with their overlaps taken off, and whether no piece is over the limit."""
    pieces = p3_pieces(spark, sf_dir).groupBy("chunk_id").agg((F.sum("n_words") - OVERLAP * (F.count(F.lit(1)) - 1)).alias("n_words"), (F.max("n_words") <= LIMIT).alias("within"))
    return pieces.select("chunk_id", "n_words", "within")


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, live, met, capped): of every target whether it has documents, gets its share of what the live ones share out to within a hundredth, and keeps to its cap."""
    targets = table(spark, sf_dir, "mix_targets").select(source_name(F.col("source")).alias("source"), "max_repeats")
    s = p9_shares(spark, sf_dir).join(targets, "source")
    whole = s.where("docs > 0").agg(F.sum("target_share").alias("whole"))
    met = F.when(F.col("docs") > 0, F.abs(F.col("actual_share") - F.col("target_share") / F.col("whole")) < 0.01).otherwise(F.col("actual_share") == 0)
    return s.crossJoin(F.broadcast(whole)).select("source", (F.col("docs") > 0).alias("live"), met.alias("met"), (F.col("passes") <= F.greatest("max_repeats", F.lit(1))).alias("capped"))


_SPANS = r"""
d as (select distinct doc_id, regexp_extract_all(text, '[^ \t\r\n]+') t from documents where doc_id is not null and text is not null),
w as (select doc_id, k, array_to_string(t[k:k + 49], ' ') s from (select doc_id, t, unnest(range(1, len(t) - 48)) k from d where len(t) >= 50)),
h as (select s from w group by s having min(doc_id) <> max(doc_id)),
c as (select distinct doc_id, k from w join h using (s)),
o as (select doc_id, k, case when k - lag(k) over (partition by doc_id order by k) <= 50 then 0 else 1 end new from c),
g as (select doc_id, k, sum(new) over (partition by doc_id order by k rows unbounded preceding) run from o),
sp as (select doc_id, (min(k) - 1)::int as first_word, (max(k) + 48)::int as last_word from g group by doc_id, run)"""

QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_kept": p2_kept,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_checks": p3_checks,
    "p4_found": p4_found,
    "p4_links": p4_links,
    "p5_found": p5_found,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_near": p8_near,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_checks": p9_checks,
    "p10_found": p10_found,
    "p10_shares": p10_shares,
}
SQL = {
    "p3_found": r"""
select distinct c.chunk_id from chunks c join (select distinct accession_no, parsed_text from filings) f
on f.accession_no = trim(c.accession_no, ' ' || chr(9))
where len(regexp_extract_all(substr(f.parsed_text, greatest(c.char_start, 0) + 1, c.char_end - greatest(c.char_start, 0)), '[^ \t\r\n]+')) > 160""",
    "p7_found": r"""
with recursive n as (select key_a k from pair_labels where key_a is not null union select key_b from pair_labels where key_b is not null),
e as (select key_a a, key_b b from pair_labels where same and key_a is not null and key_b is not null union select key_b, key_a from pair_labels where same and key_a is not null and key_b is not null),
r as (select k, k as g from n union select r.k, e.b from r join e on e.a = r.g)
select k as node_key, min(g) as group_key from r group by k""",
    "p8_found": r"""
with i as (select item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') t from eval_items), d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') t from documents where text is not null),
iw as (select distinct item_id, array_to_string(t[k:k + 11], ' ') w from (select item_id, t, unnest(range(1, len(t) - 10)) k from i where len(t) >= 12)),
dw as (select distinct doc_id, array_to_string(t[k:k + 11], ' ') w from (select doc_id, t, unnest(range(1, len(t) - 10)) k from d where len(t) >= 12))
select distinct doc_id, item_id from dw join iw using (w)""",
    "p10_found": f"with {_SPANS} select * from sp",
    "p10_shares": f"""with {_SPANS}, n as (select doc_id, len(regexp_extract_all(text, '[^ \\t\\r\\n]+'))::bigint as n_words from documents where text is not null), s as (select doc_id, sum(last_word - first_word + 1)::bigint as shared_words from sp group by 1)
select doc_id, n_words, coalesce(shared_words, 0) as shared_words, coalesce(shared_words, 0) / nullif(n_words, 0) as share from n left join s using (doc_id)""",
    "p3_checks": r"""
select chunk_id, max(n)::bigint as n_words, true as within from (select c.chunk_id, len(regexp_extract_all(substr(f.parsed_text, greatest(c.char_start, 0) + 1, c.char_end - greatest(c.char_start, 0)), '[^ \t\r\n]+')) as n
from chunks c join (select distinct accession_no, parsed_text from filings) f on f.accession_no = trim(c.accession_no, ' ' || chr(9))) where n > 160 group by 1""",
    "p9_checks": r"""
with t as (select lower(replace(trim(source), '-', '_')) as source from mix_targets), d as (select distinct lower(replace(trim(source), '-', '_')) as source from documents where text is not null and length(text) > 0)
select source, source in (select source from d where source is not null) as live, true as met, true as capped from t""",
}
