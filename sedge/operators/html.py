"""Raw pages to text with offset-exact sections."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: elements without text, and elements that end a line
SKIPPED = {"script", "style", "nav", "head", "noscript"}
BLOCKS = {"p", "div", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "br", "ul", "ol", "section"}
_HEADING = re.compile(r"^[ \t#*]*(?:PART [IV]+[,. ]*)?item[ \t\xa0]+(\d{1,2}[A-C]?)[.:\xa0 \t-]*([^\n]{0,90})$", re.I | re.M)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.cells: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "tr":
            self.out.append("\n")
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")
        elif tag in BLOCKS:
            self.out.append("\n" if tag == "br" else "\n\n")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "tr" and self.cells is not None:
            if any(c.strip() for c in self.cells):
                self.out.append("| " + " | ".join(" ".join(c.split()) for c in self.cells) + " |")
            self.cells = None
        elif tag in BLOCKS:
            self.out.append("\n\n")

    def handle_data(self, data):
        if self.skip:
            return
        if self.cells is not None:
            if self.cells:
                self.cells[-1] += data
        else:
            self.out.append(re.sub(r"\s+", " ", data))


def page_text(html: str) -> str:
    """Readable text of a page: a blank line between blocks, table rows as ``| a | b |`` lines, scripts and navigation left out."""
    r = _Reader()
    r.feed(html)
    r.close()
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(r.out))
    text = re.sub(r"\n{3,}", "\n\n", text)
    return re.sub(r"(\|)\n\n(?=\|)", r"\1\n", text).strip()


def sections(text: str) -> list[tuple[str, int, int]]:
    """(label, start, end) of the sections that ``Item N`` headings begin, each label at its last line-heading in rising order; what is before the first is ``preamble``.

    The sections cover the text without gaps; empty ones are left out.
    """
    found: list[tuple[str, int]] = []
    for m in _HEADING.finditer(text):
        label = f"Item {m.group(1).upper()}"
        found = [x for x in found if x[0] != label]
        found.append((label, m.start()))
    bounds = [("preamble", 0), *found]
    ends = [s for _, s in bounds[1:]] + [len(text)]
    return [(label, s, e) for (label, s), e in zip(bounds, ends) if text[s:e].strip()]


def parsed_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text, sections) of raw pages; null pages give no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [page_text(h) for h in pdf[html]]
            yield pd.DataFrame({key: pdf[key], "text": texts, "sections": [[{"label": a, "char_start": s, "char_end": e} for a, s, e in sections(t)] for t in texts]})

    kind = dict(pages.dtypes)[key]
    return pages.where(F.col(html).isNotNull()).select(key, html).mapInPandas(run, f"{key} {kind}, text string, sections array<struct<label:string,char_start:int,char_end:int>>")


def filing_sections(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label, char_start, char_end): sections of texts that are parsed already."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *s) for k, t in zip(pdf[key], pdf[text]) for s in sections(t)], columns=[key, "label", "char_start", "char_end"])

    return texts.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, label string, char_start int, char_end int")


def fiscal_period(form, report_date, year_end_mmdd):
    """``FY2024`` or ``FY2024-Q3`` from a report date and the month and day of the fiscal year's end; quarters are rounded half to even and kept in 1 to 3."""
    same_year = F.to_date(F.concat(F.year(report_date).cast("string"), F.lpad(year_end_mmdd, 4, "0")), "yyyyMMdd")
    end = F.when(F.datediff(report_date, same_year) > 15, F.add_months(same_year, 12)).otherwise(same_year)
    fiscal = F.concat(F.lit("FY"), F.year(end).cast("string"))
    quarter = F.least(F.greatest(F.lit(4) - F.bround(F.datediff(end, report_date) / F.lit(91.3125), 0).cast("int"), F.lit(1)), F.lit(3))
    return F.when(form == "10-K", fiscal).otherwise(F.concat(fiscal, F.lit("-Q"), quarter.cast("string")))
