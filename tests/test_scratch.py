"""Intermediate tables and the joins that watch the size of what they broadcast."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from weftline import scratch


def test_a_cluster_needs_a_shared_folder():
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="a", master="spark://host:7077"), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.scratch_root(cluster)


def test_values_are_measured_before_a_broadcast(spark, monkeypatch):
    wide = spark.range(40).select("id", F.repeat(F.lit("x"), 1000).alias("v"))
    assert scratch.small_enough(wide) and scratch.small_enough(wide.limit(0))
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 20_000)
    assert not scratch.small_enough(wide) and scratch.small_enough(wide.select("id"))
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 39)
    assert not scratch.small_enough(wide.select("id"))


@pytest.mark.parametrize("size", [16 << 20, 1])
def test_attach_alike_at_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", size)
    big = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("k"), "id")
    lookup = spark.range(0, 3000, 2).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v")).union(spark.createDataFrame([("hot", -1)], "k string, v long"))
    got = {r.id: r.v for r in scratch.attach(big, lookup, "k").collect()}
    want = {i: -1 if i % 3 else (2 * i if i % 7 and i % 2 == 0 else None) for i in range(3000)}
    assert got == want
