"""Queries for text functions, citations and paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.book import Book
from sedge.functions import text as T
from sedge.operators.store import chunk_texts
from sedge.session import spread, table

book = Book()
QUERIES, SQL = book.queries, book.sql
_LF = T.LEGAL_FORMS
_KEY = f"regexp_replace(trim(regexp_replace(replace(regexp_replace(lower(regexp_replace(name, '\\\\([!-/:-@\\[-`{{-~])', '\\1', 'g')), '[.''’]', '', 'g'), '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '^([^ ]+(?: [^ ]+)*?)(?: (?:{_LF}))+$', '\\1')"
_IDS = r"list_distinct(list_filter(flatten(list_transform(regexp_extract_all(text, '\[([^\[\]\n]*)\]', 1), lambda x: list_transform(regexp_split_to_array(x, '[,;]'), lambda y: trim(y)))), lambda x: x <> ''))"


@book.query(f"select node_id, {_KEY} as match_key from resolve_nodes where label = 'Organization'")
def match_keys(spark, d):
    return table(spark, d, "resolve_nodes").where("label = 'Organization'").select("node_id", T.match_key(F.col("name")).alias("match_key"))


@book.query(f"select node_id, list_aggregate(list_transform(string_split({_KEY}, ' '), lambda w: w[1]), 'string_agg', '') as acronym from resolve_nodes where label = 'Organization'")
def acronyms(spark, d):
    return table(spark, d, "resolve_nodes").where("label = 'Organization'").select("node_id", T.acronym(T.match_key(F.col("name"))).alias("acronym"))


@book.query(r"select node_id, label || ':' || replace(replace(replace(trim(regexp_replace(lower(name), '[ \t\r\n]+', ' ', 'g')), '%', '%25'), ':', '%3A'), '|', '%7C') as node_key from resolve_nodes where regexp_full_match(name, '[ -~]*')")
def node_keys(spark, d):
    """Of the printable ASCII names only, as SQL has neither compatibility forms nor case folding; ``node_keys_all`` has every row."""
    return table(spark, d, "resolve_nodes").where(F.col("name").rlike("^[ -~]*$")).select("node_id", T.node_key(F.col("label"), T.norm_ascii(F.col("name"))).alias("node_key"))


@book.query()
def node_keys_all(spark, d):
    """The key of every named node, in any script."""
    return table(spark, d, "resolve_nodes").where("name is not null").select("node_id", T.node_key(F.col("label"), T.norm(F.col("name"))).alias("node_key"))


@book.query(f"select distinct answer_id, array_to_string(list_sort({_IDS}), ',') as ids, len({_IDS}) as n from answers")
def cited_chunks(spark, d):
    ids = T.cited_ids(F.col("text"))
    return table(spark, d, "answers").select("answer_id", F.array_join(F.array_sort(ids), ",").alias("ids"), F.size(ids).cast("long").alias("n")).distinct()


@book.query(r"select distinct answer_id, sha256(trim(regexp_replace(text, ' *\[[^\[\]\n]*\]', '', 'g'), ' ')) as plain from answers")
def stripped_citations(spark, d):
    return table(spark, d, "answers").select("answer_id", F.sha2(T.strip_citations(F.col("text")), 256).alias("plain")).distinct()


@book.query(
    r"with s as (select answer_id, lower(regexp_extract(raw_text, '^[ \t\r\n]*[Ss][Tt][Aa][Tt][Uu][Ss]:[ \t]*([A-Za-z_]+)', 1)) as s from answers) select distinct answer_id, case when s in ('answered', 'not_found', 'declined') then s else 'no_status' end as status from s"
)
def answer_status(spark, d):
    return table(spark, d, "answers").select("answer_id", T.status_of(F.col("raw_text")).alias("status")).distinct()


@book.query("select distinct chunk_id, regexp_replace(chunk_id, ':[^:]*$', '') as accession, regexp_replace(chunk_id, ':[^:]*$', '') || ':' || case when length(ordinal::varchar) < 4 then lpad(ordinal::varchar, 4, '0') else ordinal::varchar end as made from chunks")
def chunk_ids(spark, d):
    a = T.accession_of(F.col("chunk_id"))
    return table(spark, d, "chunks").select("chunk_id", a.alias("accession"), T.chunk_id(a, F.col("ordinal")).alias("made")).distinct()


@book.query(
    "select doc_id, sha256(substr(text, greatest(p - 30, 1), p - greatest(p - 30, 1)) || '**' || substr(text, p, 7) || '**' || substr(text, p + 7, 60)) as snippet from (select doc_id, text, instr(lower(text), 'revenue') as p from documents where text is not null) where p > 0"
)
def snippets(spark, d):
    s = T.snippet(F.col("text"), "revenue")
    return table(spark, d, "documents").select("doc_id", F.sha2(s, 256).alias("snippet")).where("snippet is not null")


@book.query(r"select distinct trim(regexp_replace(lower(question), '[ \t\r\n]+', ' ', 'g')) as question from answers where regexp_full_match(question, '[ -~]*')")
def question_keys(spark, d):
    """Of the printable ASCII questions only, as SQL has neither compatibility forms nor case folding; ``question_keys_all`` has every row."""
    return table(spark, d, "answers").where(F.col("question").rlike("^[ -~]*$")).select(T.question_key(F.col("question")).alias("question")).distinct()


@book.query()
def question_keys_all(spark, d):
    """Every distinct question for comparison, in any language."""
    return table(spark, d, "answers").where("question is not null").select("question").distinct().select(T.norm(F.col("question")).alias("question")).distinct()


@book.query("select node_id, replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as html from resolve_nodes")
def escaped_names(spark, d):
    return table(spark, d, "resolve_nodes").select("node_id", T.escape_html(F.col("name")).alias("html"))


@book.query(
    "with w as (select item_id, list_filter(string_split(lower(question), ' '), lambda x: x <> '') as w from eval_items) select item_id, greatest(len(w) - 2, 0)::bigint as n, array_to_string(w[1:3], ' ') as first from w where len(w) >= 3"
)
def question_ngrams(spark, d):
    g = T.ngrams(F.lower("question"), 3)
    return table(spark, d, "eval_items").select("item_id", F.size(g).cast("long").alias("n"), F.element_at(g, 1).alias("first")).where("n > 0")


@book.query()
def name_ratios(spark, d):
    """Fuzzy score of every named node against every filer entry; equal keys are scored once."""
    n = table(spark, d, "resolve_nodes").where("label = 'Organization'").select("node_id", T.match_key(F.col("name")).alias("a"))
    e = table(spark, d, "filer_entries").select("entry_id", T.match_key(F.col("name")).alias("b"))
    pairs = spread(n.select("a").where("a is not null").distinct()).crossJoin(F.broadcast(e.select("b").distinct()))
    scores = pairs.withColumn("score", F.round(T.token_set_ratio_of("a", "b"), 6)).where("score >= 85")
    return n.join(scores, "a").join(F.broadcast(e), "b").select("node_id", "entry_id", "score")


@book.query()
def evidence_spans(spark, d):
    """Offsets of every evidence span in the text of its chunk, found verbatim but for quotes, dashes and blanks."""
    own = F.btrim("chunk_id", F.lit(" \t")).alias("chunk_id")
    texts = chunk_texts(table(spark, d, "chunks"), table(spark, d, "filings")).select(own, "text")
    e = table(spark, d, "evidence").where("span is not null").select("evidence_id", own, "span").distinct()
    return e.join(texts, "chunk_id").withColumn("at", T.find_span_in("span", "text")).select("evidence_id", "at.start", "at.end").distinct()


@book.query("select (answer_id) as answer_id, count(*) as kept, count(*) filter (where len(s.citations) > 0) as cited, count(*) filter (where len(s.citations) > 0 and len(list_filter(s.citations, lambda c: not regexp_full_match(c, '[0-9]{10}-[0-9]{2}-[0-9]{6}:[0-9]{4,}'))) = 0) as sound from (select distinct answer_id, unnest(kept) as s, generate_subscripts(kept, 1) as k from (select distinct answer_id, kept from answers where kept is not null)) group by 1")
def kept_sentences(spark, d):
    s = table(spark, d, "answers").where("kept is not null").select("answer_id", "kept").distinct().select("answer_id", F.posexplode("kept").alias("k", "s")).distinct()
    c = F.col("s.citations")
    sound = (F.size(c) > 0) & F.forall(c, lambda x: x.rlike(r"^[0-9]{10}-[0-9]{2}-[0-9]{6}:[0-9]{4,}$"))
    return s.groupBy("answer_id").agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.size(c) > 0).alias("cited"), F.count_if(sound).alias("sound"))


@book.query("select answer_id, text_hash, array_to_string(list_transform(list_filter(kept, lambda s: len(s.citations) > 0 and len(list_filter(s.citations, lambda c: regexp_replace(c, ':[^:]*$', '') not like '00012%')) = 0), lambda s: s.text), ' ') as kept_text from (select distinct answer_id, kept, sha256(text) as text_hash from answers where kept is not null)")
def citation_filter(spark, d):
    """Keeps a sentence only if it cites something and all it cites is allowed (here: of filings 00012...)."""
    ok = F.filter("kept", lambda s: (F.size(s["citations"]) > 0) & F.forall(s["citations"], lambda c: T.accession_of(c).startswith("00012")))
    a = table(spark, d, "answers").where("kept is not null").select("answer_id", "kept", F.sha2("text", 256).alias("text_hash")).distinct()
    return a.select("answer_id", "text_hash", F.array_join(F.transform(ok, lambda s: s["text"]), " ").alias("kept_text"))


@book.query(r"select accession_no, len(p) as n, sha256(trim(p[1], chr(10) || ' ')) as first from (select distinct accession_no, list_filter(regexp_split_to_array(parsed_text, '\n[ \t]*\n'), lambda x: trim(x, ' ' || chr(10) || chr(9)) <> '') as p from filings)")
def paragraphs(spark, d):
    blanks = F.lit(" \n\t")
    p = F.filter(F.split("parsed_text", r"\n[ \t]*\n"), lambda x: F.btrim(x, blanks) != "")
    f = table(spark, d, "filings").select("accession_no", "parsed_text").distinct()
    return f.select("accession_no", F.size(p).cast("long").alias("n"), F.sha2(F.btrim(F.element_at(p, 1), F.lit("\n ")), 256).alias("first"))


@book.query(r"select accession_no, len(list_filter(string_split(parsed_text, chr(10)), lambda l: l like '|%')) as table_lines, len(regexp_extract_all(parsed_text, '(?:^|\n)\|[^\n]*(?:\n\|[^\n]*)*')) as tables from (select distinct accession_no, parsed_text from filings)")
def table_spans(spark, d):
    f = table(spark, d, "filings").select("accession_no", "parsed_text").distinct()
    lines = F.size(F.filter(F.split("parsed_text", "\n"), lambda x: x.startswith("|"))).cast("long")
    return f.select("accession_no", lines.alias("table_lines"), F.regexp_count("parsed_text", F.lit(r"(?:^|\n)\|[^\n]*(?:\n\|[^\n]*)*")).cast("long").alias("tables"))
