"""Readers and writers of the engine's files: parsed filings, JSON lines, snapshots, latest runs, once-only results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sedge.operators.store import upsert

PARSED = "accession_no string, cik string, form_type string, fiscal_period string, text string, text_sha256 string, sections array<struct<label:string,char_start:int,char_end:int>>"


class CorruptInput(ValueError):
    """A file that breaks its own contract."""


def write_parsed(filings: DataFrame, path: str) -> None:
    """Parsed filings as JSON lines, with the hash of their text; an existing folder is an error."""
    filings.withColumn("text_sha256", F.sha2("text", 256)).write.mode("errorifexists").json(path)


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Parsed filings; a text that does not match its hash is an error."""
    df = spark.read.schema(PARSED).json(path, mode="FAILFAST")
    bad = df.where(~F.col("text_sha256").eqNullSafe(F.sha2("text", 256))).select("accession_no").take(5)
    if bad:
        raise CorruptInput(f"text does not match its hash: {[r[0] for r in bad]}")
    return df


def read_lines(spark: SparkSession, path: str, schema: str, unique: str | None = None) -> DataFrame:
    """JSON lines of a strict schema; broken lines and repeated values of ``unique`` are errors that name examples."""
    full = StructType.fromDDL(schema).add("_corrupt", "string")
    df = spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").json(path).cache()
    try:
        bad = df.where("_corrupt is not null").select("_corrupt").take(3)
        if bad:
            raise CorruptInput(f"broken lines: {[r[0][:80] for r in bad]}")
        if unique:
            twice = df.groupBy(unique).count().where("count > 1").select(unique).take(3)
            if twice:
                raise CorruptInput(f"repeated {unique}: {[r[0] for r in twice]}")
    finally:
        df.unpersist()
    return df.drop("_corrupt")


def latest_runs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of the latest run file ``{accession}-run{N}.jsonl`` of every accession, with ``accession`` and ``run``."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    rows = spark.read.schema(schema).json(folder).withColumn("accession", F.regexp_extract(name, r"^(.*)-run(\d+)\.jsonl$", 1)).withColumn("run", F.regexp_extract(name, r"^(.*)-run(\d+)\.jsonl$", 2).cast("int"))
    rows = rows.where("accession <> ''")
    return rows.join(rows.groupBy("accession").agg(F.max("run").alias("run")), ["accession", "run"], "left_semi")


def write_snapshot(tables: dict[str, tuple[DataFrame, list[str]]], path: str, single: bool = False) -> None:
    """Tables as gzipped JSON lines, each sorted by its key over all its files, beside a header with counts and order-free hashes.

    Large tables stay in several files in key order; the same rows give the same header.  With ``single`` a table is one file, and the same
    rows under a unique key give the same bytes.
    """
    header = None
    for name, (df, key) in tables.items():
        line = df.orderBy(*key)
        (line.coalesce(1) if single else line).write.mode("errorifexists").option("compression", "gzip").json(f"{path}/{name}")
        own = _digest(df, name)
        header = own if header is None else header.unionByName(own)
    if header is not None:
        header.coalesce(1).write.json(f"{path}/_header")


def read_snapshot(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a snapshot; counts and hashes are checked against its header."""
    want = {r.table: (r.rows, r.digest) for r in spark.read.schema("table string, rows long, digest string").json(f"{path}/_header").collect()}
    out = {name: spark.read.schema(s).json(f"{path}/{name}") for name, s in schemas.items()}
    for name, df in out.items():
        got = _digest(df, name).first()
        if want.get(name) != (got.rows, got.digest):
            raise CorruptInput(f"{name}: {want.get(name)} in the header, {(got.rows, got.digest)} in the file")
    return out


def _digest(df: DataFrame, name: str) -> DataFrame:
    line = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(line).cast("string"), F.lit("0")).alias("digest")).select(F.lit(name).alias("table"), "rows", "digest")


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write ``df`` so that the partitions of its ``by`` values are replaced and all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_numbered(spark: SparkSession, path: str, schema: str, unique: str | None = None) -> DataFrame:
    """The rows of an evaluation set in JSON lines, with ``file`` and ``line``; broken lines and repeated values of ``unique`` are errors that name file and line.

    Files are read whole, one a row, so that lines can be counted: sets of questions are small.  Blank lines are left out.
    """
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("line", "value")).where(F.trim("value") != "").withColumn("line", F.col("line") + 1)
    full = StructType.fromDDL(schema).add("_corrupt", "string")
    rows = lines.withColumn("r", F.from_json("value", full, {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = rows.where("r._corrupt is not null").select("file", "line").orderBy("file", "line").take(3)
    if bad:
        raise CorruptInput(f"broken: {[f'{r.file}:{r.line}' for r in bad]}")
    out = rows.select("file", "line", "r.*").drop("_corrupt")
    if unique:
        places = F.array_sort(F.collect_list(F.concat_ws(":", "file", F.col("line").cast("string"))))
        twice = out.groupBy(unique).agg(places.alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(unique).take(3)
        if twice:
            raise CorruptInput(f"repeated {unique}: {[(r[0], r['at']) for r in twice]}")
    return out


CANDIDATE = "kind string, key string, label string, name string, type string, start string, end string, reason string, chunk_id string, span string, confidence string"


def read_candidates(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The node, edge and flag lines of extraction files, each with its ``file``; a line of another kind is an error."""
    rows = spark.read.schema(CANDIDATE).json(path, mode="FAILFAST").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    odd = rows.where("kind is null or kind not in ('node', 'edge', 'flag')").select("file", "kind").take(3)
    if odd:
        raise CorruptInput(f"lines of unknown kind: {[tuple(r) for r in odd]}")
    return {kind: rows.where(F.col("kind") == kind) for kind in ("node", "edge", "flag")}


def merged_nodes(nodes: DataFrame, order: list[str]) -> DataFrame:
    """(key, name, chunks): nodes of equal key of several files as one: the first name in ``order`` that is not null, all chunks once each in order of appearance."""
    at = F.struct(*order)
    first = nodes.where("key is not null").groupBy("key", "chunk_id").agg(F.min(at).alias("__at"))
    chunks = first.where("chunk_id is not null").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks"))
    names = nodes.where("key is not null").groupBy("key").agg(F.min_by("name", F.when(F.col("name").isNotNull(), at)).alias("name"))
    return names.join(chunks, "key", "left").select("key", "name", F.coalesce("chunks", F.array().cast("array<string>")).alias("chunks"))


COMMUNITIES = "input_hash string, communities array<struct<community_id:string,level:string,parent:string,members:array<string>,member_hash:string>>"
REPORTS = "input_hash string, reports array<struct<community_id:string,title:string,summary:string,findings:array<struct<text:string,chunk_ids:array<string>>>>>"


def read_communities(spark: SparkSession, path: str) -> DataFrame:
    """(input_hash, community_id, level, parent, members, member_hash) of a communities file; a hash that does not fit its members is an error."""
    rows = spark.read.schema(COMMUNITIES).json(path, multiLine=True, mode="FAILFAST").select("input_hash", F.explode("communities").alias("c")).select("input_hash", "c.*")
    own = F.sha2(F.to_json(F.array_sort("members")), 256)
    bad = rows.where(~F.col("member_hash").eqNullSafe(own)).select("community_id").take(3)
    if bad:
        raise CorruptInput(f"members do not match their hash: {[r[0] for r in bad]}")
    return rows


def read_reports(spark: SparkSession, path: str, communities: DataFrame) -> DataFrame:
    """(community_id, title, summary, findings) of a reports file; reports of other inputs, of unknown communities or twice of one are errors."""
    rows = spark.read.schema(REPORTS).json(path, multiLine=True, mode="FAILFAST").select("input_hash", F.explode("reports").alias("r")).select("input_hash", "r.*")
    known = communities.select("community_id", F.col("input_hash").alias("__hash")).distinct()
    bad = rows.join(known, "community_id", "left").where(~F.col("input_hash").eqNullSafe(F.col("__hash"))).select("community_id").take(3)
    twice = rows.groupBy("community_id").count().where("count > 1").take(3)
    if bad or twice:
        raise CorruptInput(f"of other communities: {[r[0] for r in bad]}, twice: {[r[0] for r in twice]}")
    return rows.drop("input_hash")


def read_results(spark: SparkSession, path: str, schema: str, format_version: int) -> DataFrame:
    """The rows of result files, one JSON document each with ``format`` and ``rows``; documents of another format are errors that name the file."""
    docs = spark.read.schema(f"format int, rows array<struct<{schema}>>").json(path, multiLine=True, mode="FAILFAST").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    bad = docs.where(~F.col("format").eqNullSafe(F.lit(format_version))).select("file").distinct().take(3)
    if bad:
        raise CorruptInput(f"not of format {format_version}: {[r[0] for r in bad]}")
    return docs.select("file", F.explode("rows").alias("r")).select("file", "r.*")


def swap(tables: dict[str, DataFrame], path: str) -> None:
    """Write all ``tables`` beside ``path`` and put them in its place by one rename, so that a reader sees the old ones or the new ones.

    The tables may be read from ``path`` itself.  What was there is deleted after the rename.
    """
    spark = next(iter(tables.values())).sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    new, old, at = (hadoop.Path(p) for p in (f"{path}.new", f"{path}.old", path))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(new, True), fs.delete(old, True)
    for name, df in tables.items():
        df.write.parquet(f"{path}.new/{name}")
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)


def rebuild_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The stored graph replaced by a new one."""
    swap({"nodes": nodes, "edges": edges}, path)


def upsert_graph(nodes: DataFrame, edges: DataFrame, violations: DataFrame, path: str, node_key: list[str], edge_key: list[str]) -> None:
    """Nodes and edges added to the stored graph, in place of those of equal keys; a batch with violations is refused whole."""
    bad = violations.take(3)
    if bad:
        raise CorruptInput(f"the batch breaks rules: {[tuple(r) for r in bad]}")
    spark = nodes.sparkSession
    old_nodes, old_edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    swap({"nodes": upsert(old_nodes, nodes, node_key), "edges": upsert(old_edges, edges, edge_key)}, path)


def load_filings(filings: DataFrame, chunks: DataFrame, path: str) -> None:
    """Filings put into a store (folder) in place of those of equal ``accession_no``, and their chunks in place of all chunks those had, in one step."""
    spark = filings.sparkSession
    try:
        old_filings, old_chunks = spark.read.parquet(f"{path}/filings"), spark.read.parquet(f"{path}/chunks")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old_filings, old_chunks = filings.where("false"), chunks.where("false")
    gone = filings.select("accession_no").distinct()
    swap({"filings": upsert(old_filings, filings, ["accession_no"]), "chunks": old_chunks.join(gone, "accession_no", "left_anti").select(old_chunks.columns).unionByName(chunks)}, path)


def write_once(df: DataFrame, path: str) -> None:
    """A result as JSON lines that is written once: an existing one is an error, and a failed write leaves none."""
    df.write.mode("errorifexists").json(path)


def import_snapshot(spark: SparkSession, path: str, schemas: dict[str, str], target: str, gaps: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> None:
    """A checked snapshot as the tables of an empty store; ``gaps`` gives the rows that would be wrong, of which there have to be none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(target)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise CorruptInput(f"{target} is not empty")
    tables = read_snapshot(spark, path, schemas)
    bad = gaps(tables).take(3) if gaps else []
    if bad:
        raise CorruptInput(f"gaps: {[tuple(r) for r in bad]}")
    swap(tables, target)
