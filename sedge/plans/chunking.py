"""Queries for chunking, tables and headings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sedge.book import Book
from sedge.operators import chunking as C
from sedge.operators import store as S
from sedge.plans.store import CUR_C, CUR_F
from sedge.session import table

book = Book()
QUERIES, SQL = book.queries, book.sql


def _texts(spark, d):
    return S.current_filings(table(spark, d, "filings"), ["parsed_text"])


@book.query()
def filing_chunks(spark, d):
    """Every filing cut anew: offsets, tokens and tables of its chunks."""
    return C.chunked(_texts(spark, d), "accession_no", "parsed_text", 160, 20)


_SECTIONS = f"with {CUR_C}, s as (select accession_no, section, min(char_start) as lo, max(char_end) as hi from cc where not contains_table and accession_no is not null group by 1, 2)"


@book.query(
    f"{_SECTIONS} select chunk_id, exists (select 1 from s where s.accession_no = cc.accession_no and s.lo <= cc.char_start and s.hi >= cc.char_end) as inside from cc where contains_table and accession_no is not null and char_start is not null and char_end is not null"
)
def tables_in_sections(spark, d):
    """Whether each table chunk lies within one section's stretch of prose."""
    c = S.current_chunks(table(spark, d, "chunks")).where("accession_no is not null")
    sections = c.where("not contains_table").groupBy("accession_no", "section").agg(F.min("char_start").alias("lo"), F.max("char_end").alias("hi"))
    tables = c.where("contains_table and char_start is not null and char_end is not null").select("chunk_id", "accession_no", F.col("char_start").alias("lo"), F.col("char_end").alias("hi"))
    return C.contained(tables, sections, "accession_no").select("chunk_id", "inside")



@book.query(
    f"""with {CUR_C}, c as (select accession_no, char_start as lo, char_end as hi, contains_table as f from cc where accession_no is not null and char_start is not null and char_end is not null and contains_table is not null),
t as (select accession_no, lo + 5 as lo, hi - 5 as hi from c where f and hi - lo > 20), ti as (select t.accession_no, count(*) as tables, count(*) filter (exists (select 1 from c where c.accession_no = t.accession_no and c.lo <= t.lo and c.hi >= t.hi)) as whole from t group by 1),
h as (select c.*, exists (select 1 from t where t.accession_no = c.accession_no and t.lo >= c.lo and t.lo < c.hi) as holds from c),
fl as (select accession_no, count(*) filter (f) as flagged, count(*) filter (f and not holds) as flagged_empty, count(*) filter (not f and holds) as unflagged from h group by 1)
select accession_no, coalesce(tables, 0) as tables, coalesce(whole, 0) as whole, coalesce(tables, 0) - coalesce(whole, 0) as cut, flagged, flagged_empty, unflagged from fl left join ti using (accession_no)"""
)
def table_reconciliation(spark, d):
    """Tables (the inner stretches of table chunks) against all chunks and their flags."""
    c = S.current_chunks(table(spark, d, "chunks")).where("accession_no is not null and char_start is not null and char_end is not null and contains_table is not null")
    c = c.select("accession_no", F.col("char_start").alias("lo"), F.col("char_end").alias("hi"), "contains_table")
    t = c.where("contains_table and hi - lo > 20").select("accession_no", (F.col("lo") + 5).alias("lo"), (F.col("hi") - 5).alias("hi"))
    return C.table_reconciliation(t, c, "accession_no")


@book.query(
    f"""with {CUR_F}, {CUR_C}, i as (select accession_no, string_agg(substr(parsed_text, greatest(char_start, 0) + 1, greatest(char_end - greatest(char_start, 0), 0)), '' order by ordinal, chunk_id) filter (section = 'Item 8') as item_8, coalesce(bool_or(section = 'Item 7A'), false) as has_15 from cf join cc using (accession_no) group by 1)
select accession_no, case when form_type <> '10-K' then 'Item 1' when length(coalesce(item_8, '')) < 2000 and contains(lower(coalesce(item_8, '')), 'revenue') and coalesce(has_15, false) then 'Item 15' else 'Item 8' end as section from cf left join i using (accession_no)"""
)
def statements_sections(spark, d):
    """Where each filing's statements are; here an Item 8 under 2,000 characters that speaks of revenue points on, if there is an Item 7A."""
    f = S.current_filings(table(spark, d, "filings"), ["form_type"])
    t = S.chunk_texts(table(spark, d, "chunks"), table(spark, d, "filings"))
    own = t.groupBy("accession_no").agg(F.sort_array(F.collect_list(F.when(F.col("section") == "Item 8", F.struct("ordinal", "chunk_id", "text")))).alias("x"), F.bool_or(F.col("section") == "Item 7A").alias("has"))
    joined = f.join(own.select("accession_no", F.array_join("x.text", "").alias("item_8"), "has"), "accession_no", "left")
    return joined.select("accession_no", C.statements_section(F.col("form_type"), F.coalesce("item_8", F.lit("")), F.coalesce("has", F.lit(False)), phrase="revenue").alias("section"))


@book.query(
    "select section, case when section = 'Preamble' then 'none' when section like '%A' then 'anchor' else 'heading' end as method, count(distinct trim(accession_no, ' ' || chr(9))) as filings from chunks where section in ('Preamble', 'Item 1', 'Item 1A', 'Item 7', 'Item 7A', 'Item 8') and accession_no is not null group by 1, 2"
)
def method_counts(spark, d):
    """How many filings have each required section, by the way it was found."""
    c = table(spark, d, "chunks").where("section in ('Preamble', 'Item 1', 'Item 1A', 'Item 7', 'Item 7A', 'Item 8') and accession_no is not null")
    method = F.when(F.col("section") == "Preamble", "none").when(F.col("section").like("%A"), "anchor").otherwise("heading")
    return c.groupBy("section", method.alias("method")).agg(F.count_distinct(F.btrim("accession_no", F.lit(" \t"))).alias("filings"))


@book.query()
def heading_bodies(spark, d):
    """The body below each short line that opens a paragraph of a filing."""
    t = _texts(spark, d)
    lines = t.select("accession_no", F.explode(F.regexp_extract_all("parsed_text", F.lit(r"(?m)^([A-Z][A-Za-z ]{4,60})$"), F.lit(1))).alias("heading"))
    return C.heading_bodies(t, lines, "accession_no", "parsed_text")


@book.query()
def cross_references(spark, d):
    return C.cross_references(_texts(spark, d), "accession_no", "parsed_text")


@book.query(
    f"with {CUR_F}, t as (select accession_no, parsed_text as x from cf where regexp_matches(parsed_text, '[^ \\t\\r\\n]')) select accession_no, (length(x) - length(ltrim(x, ' ' || chr(9) || chr(10) || chr(13))))::int as first, length(rtrim(x, ' ' || chr(9) || chr(10) || chr(13)))::int as last, true as ordered, 0::bigint as oversized, 0::bigint as long_overlaps, 0::bigint as gaps from t"
)
def chunk_checks(spark, d):
    """What has to hold of every filing's chunks: they reach from its first to its last character, in order, without gaps but blanks, none over 160 tokens but tables, overlaps of at most 20 tokens."""
    t = _texts(spark, d)
    c = C.chunked(t, "accession_no", "parsed_text", 160, 20)
    order = Window.partitionBy("accession_no").orderBy("ordinal")
    between = F.expr("substring(parsed_text, before + 1, greatest(char_start - before, 0))")
    shared = F.regexp_count(F.expr("substring(parsed_text, char_start + 1, greatest(before - char_start, 0))"), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))
    rows = c.withColumn("before", F.lag("char_end").over(order)).withColumn("earlier", F.lag("char_start").over(order)).join(t, "accession_no")
    rows = rows.select("accession_no", "char_start", "char_end", (F.col("tokens") > 160).alias("big"), "contains_table", (F.col("char_start") > F.col("earlier")).alias("after"), F.trim(F.regexp_replace(between, r"\s+", " ")).alias("between"), shared.alias("shared"))
    return rows.groupBy("accession_no").agg(
        F.min("char_start").alias("first"), F.max("char_end").alias("last"), F.bool_and(F.coalesce("after", F.lit(True))).alias("ordered"), F.count_if(F.col("big") & ~F.col("contains_table")).alias("oversized"), F.count_if(F.col("shared") > 20).alias("long_overlaps"), F.count_if(F.col("between") != "").alias("gaps")
    )
