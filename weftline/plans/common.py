"""Shared by the query plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over all cores (by ``keys``, if any) where its scan has fewer tasks than there are cores: one row group
    is one task, however many words it holds.  A scan's task reads spark.sql.files.maxPartitionBytes at most, so no more
    than that a core is shuffled; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def r6(col: Column | str) -> Column:
    """Doubles are compared at six digits."""
    return F.round(F.col(col) if isinstance(col, str) else col, 6)
