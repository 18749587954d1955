"""The chunk store: filings, chunks and vectors as tables, their lookups, checks and keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILING_SUMMARY = ["accession_no", "cik", "company_name", "form_type", "fiscal_period", "report_date", "filing_date"]


def current_filings(filings: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per accession_no, the last load, with the named columns only (so that texts stay in the scan when nobody asks for them)."""
    rest = [c for c in columns or filings.columns if c != "accession_no"]
    row = F.struct(*rest)
    return filings.where("accession_no is not null").groupBy("accession_no").agg(F.max_by(row, F.struct(F.col("loaded_at"), row.alias("row"))).alias("row")).select("accession_no", "row.*")


def current_chunks(chunks: DataFrame) -> DataFrame:
    """One row per chunk_id, the last written, with the reference to its filing trimmed."""
    rest = [c for c in chunks.columns if c != "chunk_id"]
    last = chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.max_by(F.struct(*rest), F.struct("chunked_at", "ordinal", "char_start")).alias("row"))
    return last.select("chunk_id", "row.*").withColumn("accession_no", F.btrim("accession_no", F.lit(" \t")))


def stretch(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points; offsets outside the text are clipped, an empty stretch is ''."""
    low = F.greatest(start, F.lit(0))
    return F.substring(text, low + 1, F.greatest(end - low, F.lit(0)))


def chunk_texts(chunks: DataFrame, filings: DataFrame) -> DataFrame:
    """Each chunk with its exact text; chunks without a filing are left out."""
    texts = current_filings(filings, ["parsed_text"])
    return current_chunks(chunks).join(texts, "accession_no").withColumn("text", stretch(F.col("parsed_text"), F.col("char_start"), F.col("char_end"))).drop("parsed_text")


def passages(chunks: DataFrame, filings: DataFrame, context: int) -> DataFrame:
    """Each chunk's text with up to ``context`` characters before and after it."""
    texts = current_filings(filings, ["parsed_text"])
    t, a, b = F.col("parsed_text"), F.col("char_start"), F.col("char_end")
    return current_chunks(chunks).join(texts, "accession_no").select(
        "chunk_id", stretch(t, a - context, a).alias("before"), stretch(t, a, b).alias("text"), stretch(t, b, b + context).alias("after")
    )


def embedding_gaps(texts: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(chunks, missing, stale): chunks without a vector of ``model``, and with one of another text."""
    of_model = vectors.where(F.col("model") == model).groupBy("chunk_id").agg(F.max("text_sha256").alias("held"))
    joined = texts.join(of_model, "chunk_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("held").isNull()).alias("missing"), F.count_if(F.col("held") != F.sha2("text", 256)).alias("stale")
    )


def to_embed(texts: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """The chunks whose text has no vector of ``model`` yet, or one of another text: what a resumed run has to do."""
    of_model = vectors.where(F.col("model") == model).groupBy("chunk_id").agg(F.max("text_sha256").alias("held"))
    return texts.join(of_model, "chunk_id", "left").where(~F.col("held").eqNullSafe(F.sha2("text", 256))).select("chunk_id", F.sha2("text", 256).alias("text_sha256"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in place of those of equal ``keys``; rows of ``old`` with a null key are kept."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def section_extents(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """First and last offset per filing over the chunks in the (form_type, section) pairs of ``wanted``."""
    return chunks.join(F.broadcast(wanted), ["form_type", "section"], "left_semi").groupBy("accession_no").agg(F.min("char_start").alias("lo"), F.max("char_end").alias("hi"), F.count(F.lit(1)).alias("n_chunks"))


def manifest(filings: DataFrame, years: int) -> DataFrame:
    """The newest ``years`` annual reports of each company and the quarterly ones of their fiscal years; of several filings of one period the earliest.

    Columns accession_no, cik, form_type, fiscal_period.
    """
    first = Window.partitionBy("cik", "form_type", "fiscal_period").orderBy("filing_date", "accession_no")
    one = current_filings(filings, ["cik", "form_type", "fiscal_period", "filing_date", "report_date"]).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    newest = Window.partitionBy("cik").orderBy(F.desc("report_date"), F.desc("accession_no"))
    annual = one.where("form_type = '10-K'").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= years)
    kept = annual.select("accession_no", "cik", "form_type", "fiscal_period")
    quarterly = one.where("form_type = '10-Q'").withColumn("year", F.split_part("fiscal_period", F.lit("-"), F.lit(1)))
    wanted = annual.select("cik", F.col("fiscal_period").alias("year"))
    return kept.unionByName(quarterly.join(wanted, ["cik", "year"], "left_semi").select("accession_no", "cik", "form_type", "fiscal_period"))


def previous(filings: DataFrame, form: str | None = None) -> DataFrame:
    """(later, earlier): each filing with its company's most recent filing (of ``form``) of a strictly earlier report date; of several of one date the greatest accession_no.

    Filings of one date never pair, and filings without an earlier one are left out.  Filings are first brought down to one row per
    company and date, so the running maximum passes at most one row a day however many filings a company has, and no pairs are formed.
    """
    one = current_filings(filings, ["cik", "form_type", "report_date"]).where("report_date is not null")
    wanted = F.when(F.col("form_type") == form, F.col("accession_no")) if form else F.col("accession_no")
    days = one.groupBy("cik", "report_date").agg(F.max(wanted).alias("held"))
    before = Window.partitionBy("cik").orderBy("report_date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("earlier", F.last("held", ignorenulls=True).over(before)).where("earlier is not null").drop("held")
    return one.join(days, ["cik", "report_date"]).select(F.col("accession_no").alias("later"), "earlier")


def previous_annual(filings: DataFrame) -> DataFrame:
    """``previous`` among annual reports."""
    return previous(filings, "10-K")


def keyword_hits(texts: DataFrame, words: list[str], key: str, text: str) -> DataFrame:
    """(key, score): the texts that hold every word as the beginning of a token, with the number of hits."""
    counts = [F.regexp_count(F.lower(F.col(text)), F.lit(rf"(?:^|[^a-z0-9]){w}")) for w in words]
    hit = counts[0] > 0
    for c in counts[1:]:
        hit = hit & (c > 0)
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return texts.where(hit).select(key, total.alias("score"))
