"""Session helpers: reading tables and cutting lineage in a folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as a lazily scanned DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; a temporary one only where it is unset and the master is local (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sedge-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it again, so that later plans start from it.

    The table outlives any executor.  Unlike
    ``checkpoint()`` it carries no optimizer constraints over, which pile up in iterative plans,
    and it has sizes from which joins can be planned.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._sedge_path = path
    return stored


def drop(stored: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that no later plan reads."""
    sc = stored.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(stored._sedge_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Operators of a logical plan whose result comes out of a shuffle.
_WIDE = re.compile(r"^[\s:+|-]*(?:Aggregate|Distinct|Deduplicate|Join|Window|Sort|Repartition|RepartitionByExpression|RebalancePartitions|Intersect|Except|FlatMapGroups|FlatMapCoGroups)", re.M)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work in Python; a scan that has them already isn't shuffled.

    Nothing is run: only of a plan without shuffles is the number of partitions asked for, as that of
    an adaptive plan is known after its shuffles have run; any other is shuffled once more.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wide = _WIDE.search(df._jdf.queryExecution().optimizedPlan().toString()) is not None
    return df.repartition(cores) if wide or df.rdd.getNumPartitions() < cores else df


def slices(batches: Iterator[pd.DataFrame], column: str = "text", most: int = 8_000_000) -> Iterator[pd.DataFrame]:
    """The batches cut into slices of about ``most`` characters in ``column``, so that very long texts are worked on one by one."""
    for pdf in batches:
        size = pdf[column].str.len().cumsum().to_numpy()
        start = 0
        while start < len(pdf):
            before = size[start - 1] if start else 0
            end = max(start + 1, int(size.searchsorted(before + most, "right")))
            yield pdf.iloc[start:end]
            start = end
