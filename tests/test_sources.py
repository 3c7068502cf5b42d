"""Readers, writers and streaming windows."""

from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.conftest import SMALL
from weftline.sources import files
from weftline.sources.paged import fetch_missing, split_ranges
from weftline.streaming.windows import deduplicated, tumbling


def test_jsonl_peek_and_overlay(spark, tmp_path):
    unit = lambda p, t: json.dumps({"pmcid": p, "uid": t, "text": t})
    (tmp_path / "a.jsonl").write_text("\n".join([unit("P1", "x"), unit("P2", "y")]))
    (tmp_path / "b.jsonl").write_text(unit("P2", "z"))
    keep = spark.createDataFrame([("P2",)], "pmcid string")
    a, b = str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")
    assert [r.uid for r in files.read_jsonl_peeked(spark, a, files.UNITS, keep).collect()] == ["y"]
    assert [r.uid for r in files.read_jsonl(spark, a, files.UNITS, keep).collect()] == ["y"]
    assert sorted(r.uid for r in files.read_patched(spark, a, b, files.UNITS).collect()) == ["x", "z"]


def test_occurrences(spark):
    child = {"id": "c1", "kind": "focal_he", "content_key": "k", "atoms": []}
    row = {"pmcid": "P", "sid": "S", "uid": "U", "parents": [{"id": "p1", "content_key": "q", "embedded_in": ["p0"], "children": [child]}], "cousins": [{"id": "K1", "kind": "cousin_he", "content_key": "k", "parents": ["V#p9"]}]}
    out = files.occurrences(spark.read.schema(files.UNITS).json(spark.sparkContext.parallelize([json.dumps(row)])))
    got = sorted((r.occ, r.role, r.link or "", r.target or "") for r in out.collect())
    assert got == [("U#K1", "cousin_he", "co_occurs", "V#p9"), ("U#c1", "focal_he", "contains", "U#p1"), ("U#p1", "parent", "", ""), ("U#p1", "parent", "embedded", "p0")]


def test_regions_tables_and_writers(spark, tmp_path):
    for name, body in {"A.txt": "one", "A.r1.txt": "two", "B.r2.txt": "b"}.items():
        (tmp_path / name).write_text(body)
    assert sorted((r.id, r.regions) for r in files.read_regions(spark, str(tmp_path / "*.txt")).collect()) == [("A", 2), ("B", 1)]
    (tmp_path / "t.tsv").write_text("a\tb\n1\t\n")
    assert files.read_table(spark, str(tmp_path / "t.tsv"), "\t").dtypes == [("a", "string"), ("b", "string")]
    target = str(tmp_path / "out")
    files.write_new(spark.range(3), target)
    with pytest.raises(AnalysisException):
        files.write_new(spark.range(3), target)
    files.commit_together({"x": spark.range(2), "y": spark.range(5)}, f"file://{tmp_path}/all")
    assert spark.read.parquet(f"{tmp_path}/all/y").count() == 5
    with pytest.raises(FileExistsError):
        files.commit_together({"x": spark.range(2)}, f"file://{tmp_path}/all")
    assert json.loads(files.manifest(spark, str(tmp_path / "t.tsv"), {"n": spark.range(4)}, {"tau": 0.4}))["rows"] == {"n": 4}


def test_paged_source(spark, tmp_path):
    count = lambda a, b: ((b - a).days + 1) * 10
    parts = split_ranges(date(2024, 1, 1), date(2024, 12, 31), count, 200)
    assert all(count(a, b) <= 200 for a, b in parts) and parts[0][0] == date(2024, 1, 1) and parts[-1][1] == date(2024, 12, 31)
    assert all((c - b).days == 1 for (_, b), (c, _) in zip(parts, parts[1:]))
    wanted = spark.createDataFrame([("a",), ("b",)], "id string")
    cache = f"file://{tmp_path}/cache"
    fetch = lambda keys: [(k, k * 2) for k in keys]
    assert sorted(r.body for r in fetch_missing(spark, wanted, cache, "id", fetch).collect()) == ["aa", "bb"]

    def never(keys):
        raise OSError("cached")

    assert fetch_missing(spark, wanted, cache, "id", never, tries=1).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    measures = {"n": F.count("*")}
    query = tumbling(stream, "ts", "1 day", ["event_type"], measures, late="60 days").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r["event_type"], r["start"], r["n"])
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, tumbling(events, "ts", "1 day", ["event_type"], measures).collect()))
    assert deduplicated(events, "ts", ["event_id"]).count() == events.count()
