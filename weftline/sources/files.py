"""Readers and writers with explicit schemas."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.relational import overlay

ATOM = T.StructType([T.StructField("atom", T.StringType()), T.StructField("src", T.ArrayType(T.ArrayType(T.StringType())))])
CHILD = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "hash", "kind", "edge", "content_key")] + [T.StructField("atoms", T.ArrayType(ATOM))])
PARENT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "hash", "edge", "content_key")] + [T.StructField("embedded_in", T.ArrayType(T.StringType())), T.StructField("children", T.ArrayType(CHILD))])
COUSIN = T.StructType([*CHILD.fields, T.StructField("parents", T.ArrayType(T.StringType()))])
#: Curated sentence units.
UNITS = T.StructType([T.StructField(n, T.StringType()) for n in ("pmcid", "sid", "hash_final", "uid", "unit_hash", "text")] + [T.StructField("parents", T.ArrayType(PARENT)), T.StructField("cousins", T.ArrayType(COUSIN))])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, keep: DataFrame | None = None, key: str = "pmcid") -> DataFrame:
    """JSON lines with a schema, never inferred; ``keep`` (one column, the key) restricts rows by a semi join."""
    rows = spark.read.schema(schema).json(path)
    return rows.join(keep.select(key), key, "left_semi") if keep is not None else rows


def read_jsonl_peeked(spark: SparkSession, path: str, schema: T.StructType, keep: DataFrame, key: str = "pmcid") -> DataFrame:
    """As ``read_jsonl``, but only kept lines are parsed: the key is cut from the raw line first."""
    raw = spark.read.text(path).withColumn(key, F.regexp_extract("value", rf'"{re.escape(key)}"\s*:\s*"([^"]*)"', 1))
    return raw.join(keep.select(key), key, "left_semi").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_patched(spark: SparkSession, base: str, patch: str, schema: T.StructType, key: str = "pmcid") -> DataFrame:
    return overlay(read_jsonl(spark, base, schema), read_jsonl(spark, patch, schema), key)


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """CSV or TSV with a header; every column is text."""
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, regions) of text files named <id>.txt or <id>.rN.txt, regions joined in order."""
    raw = spark.read.option("wholetext", True).text(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1))
    rows = raw.select(F.regexp_replace("file", r"\.r\d+$", "").alias("id"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("file", r"\.r(\d+)$", 1), F.lit("")), F.lit("999999")).cast("int"), F.lit(0)).alias("n"), F.col("value"))
    parts = F.array_sort(F.collect_list(F.struct("n", "value")))
    return rows.groupBy("id").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("text"), F.count("*").alias("regions"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def header_fields(text: str, fields: dict[str, str]) -> list:
    """Columns of regular-expression groups over a text, null where nothing matches."""
    return [F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).alias(name) for name, pattern in fields.items()]


def write_new(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write Parquet; an existing target is an error, never overwritten."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def commit_together(frames: dict[str, DataFrame], root: str) -> None:
    """Write several tables and make all of them visible at the end; on failure none stays."""
    spark = next(iter(frames.values())).sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    stage = f"{root.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    fs = path(root).getFileSystem(conf)
    taken = [n for n in frames if fs.exists(path(f"{root}/{n}"))]
    if taken:
        raise FileExistsError(f"{root}: {', '.join(taken)}")
    try:
        for name, df in frames.items():
            df.write.parquet(f"{stage}/{name}")
        for name in frames:
            if not fs.rename(path(f"{stage}/{name}"), path(f"{root}/{name}")):
                raise OSError(f"{root}/{name} can't be committed")
    finally:
        fs.delete(path(stage), True)


def manifest(spark: SparkSession, inputs: str, counts: dict[str, DataFrame], constants: dict) -> str:
    """JSON of input checksums, row counts and constants."""
    files = spark.read.format("binaryFile").load(inputs).select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path")
    return json.dumps({"inputs": [r.asDict() for r in files.toLocalIterator()], "rows": {n: d.count() for n, d in counts.items()}, "constants": constants}, sort_keys=True, indent=1)


def occurrences(units: DataFrame) -> DataFrame:
    """(occ, role, key, uid, sid, pmcid, link, target): hyperedge occurrences with typed links."""
    ids = ["uid", "sid", "pmcid"]
    occ = lambda p: F.concat_ws("#", "uid", p)
    p = units.select(*ids, F.explode("parents").alias("p"))
    c = p.select(*ids, "p", F.explode("p.children").alias("c"))
    k = units.select(*ids, F.explode("cousins").alias("k"))
    none = F.lit(None).cast("string")
    rows = [
        p.select(occ("p.id").alias("occ"), F.lit("parent").alias("role"), F.col("p.content_key").alias("key"), *ids, none.alias("link"), none.alias("target")),
        p.select(occ("p.id").alias("occ"), F.lit("parent").alias("role"), F.col("p.content_key").alias("key"), *ids, F.lit("embedded").alias("link"), F.explode("p.embedded_in").alias("target")),
        c.select(occ("c.id").alias("occ"), F.col("c.kind").alias("role"), F.col("c.content_key").alias("key"), *ids, F.lit("contains").alias("link"), occ("p.id").alias("target")),
        k.select(occ("k.id").alias("occ"), F.col("k.kind").alias("role"), F.col("k.content_key").alias("key"), *ids, F.lit("co_occurs").alias("link"), F.explode_outer("k.parents").alias("target")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
