"""Queries of the orphan-reference operator (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedge.operators.orphans import all_orphans, orphan_report
from sedge.session import table


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_orphans(*(table(spark, sf_dir, t) for t in ("evidence", "chunk_embeddings", "chunks", "filings", "deletions")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("source_table", "ref_key", "ref_month", "kind")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


def _part(src: str, key: str, at: str, tgt: str, tgt_key: str, tgt_at: str) -> str:
    return f"""
select '{src}' as source_table, r.k as ref_key, r.m as ref_month, r.n as n_refs,
  case when t.k is null and d.k is not null then 'deleted' when t.k is null then 'missing' else 'late' end as kind
from (select trim({key}, ' ' || chr(9)) as k, strftime({at}, '%Y-%m') as m, count(*) as n, min({at}) as first_ref
      from {src} where {key} is not null group by 1, 2) r
left join (select {tgt_key} as k, min({tgt_at}) as since from {tgt} group by 1) t on t.k = r.k
left join (select distinct key_value as k from deletions where table_name = '{tgt}') d on d.k = r.k
where t.k is null or t.since > r.first_ref"""


_ALL = " union all ".join(
    [
        _part("evidence", "chunk_id", "extracted_at", "chunks", "chunk_id", "chunked_at"),
        _part("chunk_embeddings", "chunk_id", "embedded_at", "chunks", "chunk_id", "chunked_at"),
        _part("chunks", "accession_no", "chunked_at", "filings", "accession_no", "loaded_at"),
    ]
)

QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
SQL = {
    "p6_found": f"select source_table, ref_key, ref_month, kind from ({_ALL})",
    "p6_report": f"select source_table, ref_month, kind, count(*) as n_keys, sum(n_refs)::bigint as n_refs from ({_ALL}) group by all",
}
