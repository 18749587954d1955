"""References to records that do not exist, are deleted, or came later than the reference.

References are counted per key and month first (partial aggregation on the map side), so the rows
of a key that holds a third of a table shrink to one row per month before any shuffle by key.  Keys
that are heavy even then are checked against the targets by a broadcast (fewer than 64 of them by
construction); the rest goes through a shuffled left join.  Both parts are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.operators.skew import heavy_keys

BLANKS = " \t"


def trimmed(col: Column) -> Column:
    """Without blanks and tabs at either end."""
    return F.btrim(col, F.lit(BLANKS))


def reference_counts(refs: DataFrame, key: str, at: str) -> DataFrame:
    """(ref_key, ref_month, n_refs, first_ref, last_ref) per trimmed key and yyyy-MM of ``at``.

    Rows with a null key refer to nothing and are left out.  A null ``at`` gives a null month; such
    references can be missing or deleted but never late.
    """
    return (
        refs.select(trimmed(F.col(key)).alias("ref_key"), F.col(at).alias("__at"))
        .where(F.col("ref_key").isNotNull())
        .groupBy("ref_key", F.date_format("__at", "yyyy-MM").alias("ref_month"))
        .agg(F.count(F.lit(1)).alias("n_refs"), F.min("__at").alias("first_ref"), F.max("__at").alias("last_ref"))
    )


def orphan_references(
    refs: DataFrame, key: str, at: str, targets: DataFrame, target_key: str, target_at: str, deletions: DataFrame, deleted_key: str
) -> DataFrame:
    """Orphans of one reference column: (ref_key, ref_month, kind, n_refs, first_ref, last_ref).

    kind is ``deleted`` (no such record, but ``deletions`` names it), ``missing`` (neither) or
    ``late`` (the record's earliest ``target_at`` is after a reference of that month; ``n_refs``
    then counts all references of the key in the month).  Keys are compared exactly after
    trimming the reference.  Repeated targets and repeated deletions count once; an empty target
    table makes every reference missing or deleted.
    """
    counts = reference_counts(refs, key, at)
    known = targets.groupBy(F.col(target_key).alias("ref_key")).agg(F.lit(True).alias("__known"), F.min(target_at).alias("__since"))
    gone = deletions.select(F.col(deleted_key).alias("ref_key")).where("ref_key is not null").distinct().withColumn("__gone", F.lit(True))

    heavy = heavy_keys(counts, "ref_key")
    hot = counts.join(F.broadcast(heavy), "ref_key", "left_semi")
    rest = counts.join(F.broadcast(heavy), "ref_key", "left_anti")
    # fewer than 64 keys: the targets are filtered by the broadcast list, not shuffled with it
    hot_known = known_of(targets, target_key, target_at, heavy)
    hot_gone = gone.join(F.broadcast(heavy), "ref_key", "left_semi")
    both = (
        hot.join(F.broadcast(hot_known), "ref_key", "left").join(F.broadcast(hot_gone), "ref_key", "left")
        .unionByName(rest.join(known, "ref_key", "left").join(gone, "ref_key", "left"))
    )
    kind = (
        F.when(F.col("__known").isNull() & F.col("__gone"), "deleted")
        .when(F.col("__known").isNull(), "missing")
        .when(F.col("__since") > F.col("first_ref"), "late")
    )
    return both.withColumn("kind", kind).where("kind is not null").select("ref_key", "ref_month", "kind", "n_refs", "first_ref", "last_ref")


def known_of(targets: DataFrame, target_key: str, target_at: str, keys: DataFrame) -> DataFrame:
    """The targets among ``keys`` with their earliest time, one row per key."""
    return (
        targets.select(F.col(target_key).alias("ref_key"), F.col(target_at).alias("__since"))
        .join(F.broadcast(keys), "ref_key", "left_semi")
        .groupBy("ref_key")
        .agg(F.lit(True).alias("__known"), F.min("__since").alias("__since"))
    )


def all_orphans(evidence: DataFrame, embeddings: DataFrame, chunks: DataFrame, filings: DataFrame, deletions: DataFrame) -> DataFrame:
    """Orphans of the three reference columns of the chunk store, with ``source_table`` in front."""
    del_chunks = deletions.where(F.col("table_name") == "chunks")
    del_filings = deletions.where(F.col("table_name") == "filings")
    parts = [
        ("evidence", orphan_references(evidence, "chunk_id", "extracted_at", chunks, "chunk_id", "chunked_at", del_chunks, "key_value")),
        ("chunk_embeddings", orphan_references(embeddings, "chunk_id", "embedded_at", chunks, "chunk_id", "chunked_at", del_chunks, "key_value")),
        ("chunks", orphan_references(chunks, "accession_no", "chunked_at", filings, "accession_no", "loaded_at", del_filings, "key_value")),
    ]
    out = None
    for name, df in parts:
        named = df.select(F.lit(name).alias("source_table"), "*")
        out = named if out is None else out.unionByName(named)
    return out


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Per table, month and kind: number of orphan keys and of references."""
    return orphans.groupBy("source_table", "ref_month", "kind").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_refs").alias("n_refs"))
