"""Windowed aggregates that run alike on batch and streaming frames (extension)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(rows: DataFrame, time: str, late: str | None) -> DataFrame:
    """Streams get a watermark; event times without a zone are read in the session's zone."""
    if dict(rows.dtypes)[time] == "timestamp_ntz":
        rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late) if rows.isStreaming and late else rows


def _flat(out: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    return out.select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *names)


def tumbling(rows: DataFrame, time: str, width: str, by: list[str], measures: dict[str, Column], late: str | None = "1 hour") -> DataFrame:
    out = _late(rows, time, late).groupBy(F.window(time, width).alias("window"), *by).agg(*[c.alias(n) for n, c in measures.items()])
    return _flat(out, by, list(measures))


def sliding(rows: DataFrame, time: str, width: str, step: str, by: list[str], measures: dict[str, Column], late: str | None = "1 hour") -> DataFrame:
    out = _late(rows, time, late).groupBy(F.window(time, width, step).alias("window"), *by).agg(*[c.alias(n) for n, c in measures.items()])
    return _flat(out, by, list(measures))


def sessions(rows: DataFrame, time: str, gap: str, by: list[str], measures: dict[str, Column], late: str | None = "1 hour") -> DataFrame:
    out = _late(rows, time, late).groupBy(F.session_window(time, gap).alias("window"), *by).agg(*[c.alias(n) for n, c in measures.items()])
    return _flat(out, by, list(measures))


def deduplicated(rows: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First arrival of each key; a stream forgets keys behind its watermark."""
    rows = _late(rows, time, late)
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)
