"""Queries over the chunk store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.book import Book
from sedge.operators import store as S
from sedge.session import table

book = Book()
QUERIES, SQL = book.queries, book.sql
MODEL = "meridian-embed-3"

CUR_F = "cf as (select * from filings where accession_no is not null qualify row_number() over (partition by accession_no order by loaded_at desc, parsed_text desc) = 1)"
CUR_C = (
    "cc as (select * replace (trim(accession_no, ' ' || chr(9)) as accession_no) from chunks where chunk_id is not null "
    "qualify row_number() over (partition by chunk_id order by chunked_at desc, ordinal desc, char_start desc) = 1)"
)
TEXTS = (
    f"{CUR_F}, {CUR_C}, ct as (select cc.*, substr(cf.parsed_text, greatest(char_start, 0) + 1, greatest(char_end - greatest(char_start, 0), 0)) as text from cc join cf using (accession_no))"
)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return S.chunk_texts(table(spark, d, "chunks"), table(spark, d, "filings"))


@book.query(f"with {TEXTS} select chunk_id, sha256(text) as text_sha256, length(text)::bigint as n_chars from ct")
def chunk_resolve(spark, d):
    return _texts(spark, d).select("chunk_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


@book.query(f"with {TEXTS} select accession_no, string_agg(chunk_id, ',' order by ordinal, chunk_id) as ids, sum(length(text))::bigint as n_chars from ct group by 1")
def filing_chunk_texts(spark, d):
    per = _texts(spark, d).groupBy("accession_no").agg(F.sort_array(F.collect_list(F.struct("ordinal", "chunk_id"))).alias("rows"), F.sum(F.length("text")).cast("long").alias("n_chars"))
    return per.select("accession_no", F.array_join(F.transform("rows", lambda r: r["chunk_id"]), ",").alias("ids"), "n_chars")


@book.query("select distinct chunker_version from chunks")
def chunker_versions(spark, d):
    return table(spark, d, "chunks").select("chunker_version").distinct()


@book.query(f"with {CUR_F} select accession_no, cik, company_name, form_type, fiscal_period, report_date::varchar as report_date, filing_date::varchar as filing_date from cf")
def list_filings(spark, d):
    out = S.current_filings(table(spark, d, "filings"), S.FILING_SUMMARY)
    return out.withColumns({c: F.col(c).cast("string") for c in ("report_date", "filing_date")})


@book.query("select exists(select 1 from filings) as has_filings, exists(select 1 from chunks where token_count > 100000) as has_huge")
def existence_checks(spark, d):
    one = spark.range(1)
    return one.select(F.lit(not table(spark, d, "filings").isEmpty()).alias("has_filings"), F.lit(not table(spark, d, "chunks").where("token_count > 100000").isEmpty()).alias("has_huge"))


@book.query(
    f"with {CUR_F}, {CUR_C} select chunk_id, sha256(substr(parsed_text, greatest(greatest(char_start - 80, 0), 0) + 1, greatest(char_start - greatest(char_start - 80, 0), 0))) as before, "
    "sha256(substr(parsed_text, greatest(char_end, 0) + 1, 80)) as after from cc join cf using (accession_no)"
)
def source_passages(spark, d):
    return S.passages(table(spark, d, "chunks"), table(spark, d, "filings"), 80).select("chunk_id", F.sha2("before", 256).alias("before"), F.sha2("after", 256).alias("after"))


@book.query(
    f"with {TEXTS}, h as (select chunk_id, max(text_sha256) as held from chunk_embeddings where model = '{MODEL}' group by 1) "
    "select count(*) as chunks, count(*) filter (where held is null) as missing, count(*) filter (where held <> sha256(text)) as stale from ct left join h using (chunk_id)"
)
def embedding_gaps(spark, d):
    return S.embedding_gaps(_texts(spark, d), table(spark, d, "chunk_embeddings"), MODEL)


@book.query(
    f"with {TEXTS}, h as (select chunk_id, max(text_sha256) as held from chunk_embeddings where model = '{MODEL}' group by 1) "
    "select chunk_id, sha256(text) as text_sha256 from ct left join h using (chunk_id) where held is distinct from sha256(text)"
)
def resume_embedding(spark, d):
    return S.to_embed(_texts(spark, d), table(spark, d, "chunk_embeddings"), MODEL)


@book.query("select accession_no, min(char_start) as lo, max(char_end) as hi, count(*) as n_chunks from chunks where (form_type, section) in (('10-K', 'Item 7'), ('10-K', 'Item 1A'), ('10-Q', 'Item 2')) group by 1")
def section_extents(spark, d):
    wanted = spark.createDataFrame([("10-K", "Item 7"), ("10-K", "Item 1A"), ("10-Q", "Item 2")], "form_type string, section string")
    return S.section_extents(table(spark, d, "chunks"), wanted)


@book.query(
    f"""with {CUR_F}, one as (select * from cf qualify row_number() over (partition by cik, form_type, fiscal_period order by filing_date, accession_no) = 1),
annual as (select * from one where form_type = '10-K' qualify row_number() over (partition by cik order by report_date desc, accession_no desc) <= 2)
select accession_no, cik, form_type, fiscal_period from annual union all
select accession_no, cik, form_type, fiscal_period from one where form_type = '10-Q' and (cik, split_part(fiscal_period, '-', 1)) in (select (cik, fiscal_period) from annual)"""
)
def manifest_selection(spark, d):
    return S.manifest(table(spark, d, "filings"), 2)


@book.query(
    f"with {CUR_F} select l.accession_no as later, arg_max(e.accession_no, (e.report_date, e.accession_no)) as earlier from cf l join cf e on e.cik = l.cik and e.form_type = '10-K' and e.report_date < l.report_date group by 1"
)
def asof_previous(spark, d):
    return S.previous_annual(table(spark, d, "filings"))


@book.query(
    "with c as (select doc_id, len(regexp_extract_all(lower(text), '(?:^|[^a-z0-9])revenue')) as a, len(regexp_extract_all(lower(text), '(?:^|[^a-z0-9])cost')) as b from documents) "
    "select doc_id, (a + b)::int as score from c where a > 0 and b > 0 order by score desc, doc_id limit 25"
)
def keyword_search(spark, d):
    return S.keyword_hits(table(spark, d, "documents"), ["revenue", "cost"], "doc_id", "text").orderBy(F.desc("score"), "doc_id").limit(25)


@book.query("select count(*) as chunks, count(*) filter (where contains_table) as with_table, count(*) filter (where token_count > 160) as oversized, max(token_count) as most from chunks")
def chunk_counts(spark, d):
    return table(spark, d, "chunks").agg(F.count(F.lit(1)).alias("chunks"), F.count_if("contains_table").alias("with_table"), F.count_if(F.col("token_count") > 160).alias("oversized"), F.max("token_count").alias("most"))


@book.query("select accession_no, section, sum(char_end - char_start)::bigint as n_chars, count(*) as n, min(char_start) as first from chunks group by 1, 2")
def section_rows(spark, d):
    return table(spark, d, "chunks").groupBy("accession_no", "section").agg(F.sum(F.col("char_end") - F.col("char_start")).cast("long").alias("n_chars"), F.count(F.lit(1)).alias("n"), F.min("char_start").alias("first"))


@book.query(
    f"with {TEXTS} select accession_no, ordinal, chunk_id from ct where char_start is not null "
    "qualify count(*) over (partition by accession_no, ordinal) > 1"
)
def duplicate_ordinals(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("accession_no", "ordinal")
    return _texts(spark, d).where("char_start is not null").withColumn("n", F.count(F.lit(1)).over(w)).where("n > 1").select("accession_no", "ordinal", "chunk_id")


@book.query(
    "with n as (select chunk_id, model, any_value(text_sha256) as text_sha256 from chunk_embeddings group by 1, 2), p as (select * from n where model <> 'meridian-embed-3') "
    "select chunk_id, model, text_sha256 from n where (chunk_id, model) not in (select (chunk_id, model) from p) union all select chunk_id, model, upper(text_sha256) from p"
)
def upsert_vectors(spark, d):
    old = table(spark, d, "chunk_embeddings").groupBy("chunk_id", "model").agg(F.any_value("text_sha256").alias("text_sha256"))
    new = old.where("model <> 'meridian-embed-3'").withColumn("text_sha256", F.upper("text_sha256"))
    return S.upsert(old, new, ["chunk_id", "model"])


@book.query(
    f"with {CUR_F} select accession_no, text_sha256 = sha256(parsed_text) as hash_ok, regexp_full_match(accession_no, '[0-9]{{10}}-[0-9]{{2}}-[0-9]{{6}}') as id_ok, form_type in ('10-K', '10-Q') as form_ok, "
    "filing_date >= report_date as order_ok from cf"
)
def filing_checks(spark, d):
    f = S.current_filings(table(spark, d, "filings"))
    return f.select(
        "accession_no", (F.col("text_sha256") == F.sha2("parsed_text", 256)).alias("hash_ok"), F.col("accession_no").rlike(r"^[0-9]{10}-[0-9]{2}-[0-9]{6}$").alias("id_ok"),
        F.col("form_type").isin("10-K", "10-Q").alias("form_ok"), (F.col("filing_date") >= F.col("report_date")).alias("order_ok"),
    )
