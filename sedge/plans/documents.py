"""Queries for parsing, sections, windows of events and fiscal periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.book import Book
from sedge.operators import html as H
from sedge.operators.store import current_filings
from sedge.plans.store import CUR_F
from sedge.session import table
from sedge.streaming.log import event_rates as rates

book = Book()
QUERIES, SQL = book.queries, book.sql


@book.query()
def html_to_text(spark, d):
    """Every passage as a page and back: paragraphs, entities and a script that has to go."""
    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n\n"), F.lit("</p><p>"))
    pages = table(spark, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit("<html><head><title>x</title></head><body><script>var a;</script><p>"), text, F.lit("</p></body></html>")).alias("html"))
    return H.parsed_pages(pages, "doc_id", "html").select("doc_id", F.length("text").alias("n_chars"), F.size("sections").alias("sections"))


@book.query()
def filing_sections(spark, d):
    return H.filing_sections(current_filings(table(spark, d, "filings"), ["parsed_text"]), "accession_no", "parsed_text")


@book.query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by 1, 2")
def event_rates(spark, d):
    return rates(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@book.query(
    f"""with {CUR_F}, e as (select accession_no, form_type, report_date, case when report_date - make_date(year(report_date), 12, 31) > 15 then make_date(year(report_date) + 1, 12, 31) else make_date(year(report_date), 12, 31) end as fy from cf)
select accession_no, case when form_type = '10-K' then 'FY' || year(fy) else 'FY' || year(fy) || '-Q' || least(greatest(4 - round_even((fy - report_date) / 91.3125, 0)::int, 1), 3) end as period from e"""
)
def fiscal_periods(spark, d):
    f = current_filings(table(spark, d, "filings"), ["form_type", "report_date"])
    return f.select("accession_no", H.fiscal_period(F.col("form_type"), F.col("report_date"), F.lit("1231")).alias("period"))
