"""The corpus pipeline: five stages over ``documents``, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import table
from weftline.llm.decontaminate import uncontaminated
from weftline.llm.langid import accepted
from weftline.llm.linededup import without_boilerplate
from weftline.llm.mixing import mixed_documents
from weftline.llm.simhash import without_near_duplicates
from weftline.scratch import materialise


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay; texts without a letter and those far from every language go.

    Null texts go, null sources and ids do not matter, texts of any length are read whole, rows that repeat go or stay
    alike, an empty table stays empty and one without any language keeps all rows; further columns stay."""
    return accepted(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources show are cut but for their first occurrence; no document goes.

    Null texts stay null, a null source counts as no source, of equal first places each keeps the line, texts of any
    length are read whole, an empty table stays empty; further columns stay."""
    return without_boilerplate(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest id.

    Texts without a word are one group, rows without an id stay, texts that differ under one id are documents of their
    own, of wholly repeated rows one stays, an empty table stays empty; further columns stay."""
    return without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go.

    Null and empty texts stay, null and empty items match nothing, rows that repeat go or stay alike, texts of any
    length are searched whole, an empty table stays empty; further columns stay."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; column copy counts from 1 and replaces one of that name.

    A null text has size 0, a null source is a source of its own, rows that repeat an id are drawn alike, an empty
    table stays empty; further columns stay."""
    return mixed_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_dedup", simhash_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: No stage before the mix can be said in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
