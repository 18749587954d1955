"""Calls of outside models behind caches keyed by a hash of the request; only misses reach the model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_key(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``request_key``, the SHA-256 of the named columns as JSON."""
    return df.withColumn("request_key", F.sha2(F.to_json(F.struct(*columns)), 256))


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct requests that the cache does not hold."""
    return requests.dropDuplicates(["request_key"]).join(cache.select("request_key").distinct(), "request_key", "left_anti")


def answered(requests: DataFrame, cache: DataFrame, call: Callable[[list[str]], list[str]], text: str, batch: int = 128) -> tuple[DataFrame, DataFrame]:
    """(requests with ``reply`` and ``cached``, new cache rows).

    ``call`` takes at most ``batch`` texts and gives one reply each; it runs once for every distinct missing request.
    The new rows should be stored before they are read twice.
    """

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for k in range(0, len(page), batch):
                part = page.iloc[k : k + batch]
                yield pd.DataFrame({"request_key": part["request_key"], "reply": call(part[text].tolist())})

    new = misses(requests, cache).select("request_key", text).mapInPandas(run, "request_key string, reply string")
    held = cache.select("request_key", "reply").dropDuplicates(["request_key"]).withColumn("cached", F.lit(True))
    return requests.join(held.unionByName(new.withColumn("cached", F.lit(False))), "request_key", "left"), new
