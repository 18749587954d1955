"""The append-only merge log: batch replay, idempotent appends, and a stream that keeps the state current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "seq long, event string, merge_id string, member string, canonical string, count long"


class BrokenLog(ValueError):
    """A log whose splits do not name an active merge each."""


def new_events(log: DataFrame, events: DataFrame) -> DataFrame:
    """Events that the log does not hold yet, each once."""
    key = ["event", "merge_id", "member"]
    return events.dropDuplicates(key).join(log.select(*key), key, "left_anti")


def active_merges(log: DataFrame) -> DataFrame:
    """The merges that no later split takes back; a split of an unknown merge, and a second split of one, is an error."""
    merges, splits = log.where("event = 'merge'"), log.where("event = 'split'")
    unknown = splits.join(merges.select("merge_id").distinct(), "merge_id", "left_anti").take(3)
    twice = splits.groupBy("merge_id").count().where("count > 1").take(3)
    if unknown or twice:
        raise BrokenLog(f"unknown: {[r.merge_id for r in unknown]}, split twice: {[r.merge_id for r in twice]}")
    return merges.join(splits.select("merge_id"), "merge_id", "left_anti")


def aliases(log: DataFrame) -> DataFrame:
    """(member, canonical): the alias of every member of an active merge, by its latest event."""
    return active_merges(log).groupBy("member").agg(F.max_by("canonical", F.struct("seq", "canonical")).alias("canonical")).where("member <> canonical")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``; other failures to look are errors."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def keep_current(stream: DataFrame, log_path: str, alias_path: str, checkpoint: str):
    """Start a stream that appends every batch's new events to the log and rewrites the aliases from the whole log.

    A batch that is run again changes nothing, as events are compared with the log first.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        there = _exists(spark, log_path)
        log = spark.read.schema(LOG).parquet(log_path) if there else spark.createDataFrame([], LOG)
        new_events(log, batch.select(*[c.split()[0] for c in LOG.split(", ")])).write.mode("append").parquet(log_path)
        aliases(spark.read.schema(LOG).parquet(log_path)).write.mode("overwrite").parquet(alias_path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) per tumbling window of an event stream or table; events later than ``late`` are left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
