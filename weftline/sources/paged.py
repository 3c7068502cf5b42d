"""Paged remote sources with an on-disk cache (no client is shipped: a caller supplies ``fetch``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession


def split_ranges(first: date, last: date, count: Callable[[date, date], int], most: int) -> list[tuple[date, date]]:
    """Date ranges whose result counts stay at ``most`` or below: a range over it is halved down to single days."""
    if first > last:
        return []
    if first == last or count(first, last) <= most:
        return [(first, last)]
    middle = first + (last - first) // 2
    return split_ranges(first, middle, count, most) + split_ranges(middle + timedelta(days=1), last, count, most)


def fetch_missing(spark: SparkSession, wanted: DataFrame, cache: str, key: str, fetch: Callable[[list[str]], list[tuple[str, str]]], batch: int = 100, tries: int = 4, pause: float = 1.0) -> DataFrame:
    """Rows (key, body) for all wanted keys: those the Parquet cache lacks are fetched in batches on the executors,
    with growing pauses between tries, and appended to it."""
    shape = f"`{key}` string, body string"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    known = spark.read.schema(shape).parquet(cache) if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop) else spark.createDataFrame([], shape)
    todo = wanted.select(key).distinct().join(known.select(key), key, "left_anti")

    def work(frames: Iterator) -> Iterator:
        import time

        import pandas as pd

        for frame in frames:
            keys = frame[key].tolist()
            for s in range(0, len(keys), batch):
                for attempt in range(tries):
                    try:
                        got = fetch(keys[s : s + batch])
                        break
                    except OSError:
                        if attempt + 1 == tries:
                            raise
                        time.sleep(pause * 2**attempt)
                yield pd.DataFrame(got, columns=[key, "body"])

    todo.mapInPandas(work, shape).write.mode("append").parquet(cache)
    return spark.read.schema(shape).parquet(cache).join(wanted.select(key).distinct(), key, "left_semi")
