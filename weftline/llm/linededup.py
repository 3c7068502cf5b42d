"""Operator 7: line dedup by distinct-site spread.

Every line has a hash; a HyperLogLog sketch of the sites that show it is merged by aggregation.  Lines whose estimate
is clearly above the threshold are cross-site boilerplate, lines near it get an exact distinct count, and the first
occurrence of a boilerplate line (smallest id, then position) stays, so that no text is lost from the corpus.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import table
from weftline.scratch import attach, discard, materialise, small_enough

#: A line on this many sites is boilerplate.
SITES = 10
#: log2 of the sketch's registers, and the share around the threshold inside which counts are taken exactly: six
#: standard errors of 1.04 / sqrt(2 ** LG).
LG, BAND = 12, 0.1


def line_table(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, text_hash, site, pos, key) of every line that is not blank; key is XXH64 (seed 42) of the line without
    the spaces around it."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"), F.col(text_col).cast("string").alias("text"))
    lines = rows.select("id", "site", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.withColumn("line", F.trim("line")).where("line <> ''").select("id", "text_hash", "site", "pos", F.xxhash64("line").alias("key"))


def boilerplate(lines: DataFrame, sites: int = SITES, band: float = BAND) -> DataFrame:
    """(key, first_id, first_pos) of lines on ``sites`` distinct sites or more.  A null site counts as no site.

    Sketches and first places are partial aggregates, so a line that a third of all rows hold costs one row a task.
    """
    spread = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG)).alias("estimate"), F.min(F.struct("id", "pos")).alias("first"))
    wide = materialise(spread.where(F.col("estimate") >= sites * (1 - band)))
    sure = wide.where(F.col("estimate") > sites * (1 + band)).select("key", "first")
    near = wide.where(F.col("estimate") <= sites * (1 + band)).select("key", "first")
    picked = near.select("key")
    picked = F.broadcast(picked) if small_enough(picked, 16) else picked
    exact = lines.join(picked, "key", "left_semi").select("key", "site").distinct().groupBy("key").agg(F.count("site").alias("n")).where(F.col("n") >= sites).select("key")
    out = materialise(sure.unionByName(near.join(exact, "key", "left_semi")).select("key", F.col("first.id").alias("first_id"), F.col("first.pos").alias("first_pos")))
    discard(wide)
    return out


def _cut_by_broadcast(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # ids travel as text: a null among whole numbers would turn them into floats
    got = found.select("key", F.col("first_id").cast("string").alias("first_id"), "first_pos").orderBy("key").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((got.column("key").to_numpy(), got.column("first_id").to_pylist(), got.column("first_pos").to_pylist()))

    @F.pandas_udf("struct<text:string,n_lines:int,n_removed:int>")
    def cut(own, text):  # noqa: ANN001, ANN202
        import pandas as pd

        keys, first_id, first_pos = shared.value
        digest = xxhash.xxh64_intdigest
        out = []
        for i, t in zip(own.tolist(), text.tolist()):
            if not isinstance(t, str):
                out.append((None, 0, 0))
                continue
            lines = t.split("\n")
            keep = lines
            if len(keys):
                bare = [x.strip(" ") for x in lines]
                h = np.array([digest(x.encode("utf-8", "surrogatepass"), 42) for x in bare], dtype=np.uint64).view(np.int64)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == h).tolist()
                gone = {p for p in hit if bare[p] and not (first_pos[at[p]] == p and first_id[at[p]] == i)}
                if gone:
                    keep = [x for p, x in enumerate(lines) if p not in gone]
            out.append(("\n".join(keep), len(lines), len(lines) - len(keep)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"]).astype({"n_lines": "int32", "n_removed": "int32"})

    own = F.col(id_col).cast("string")
    return docs.withColumn("__cut", cut(own, F.col(text_col).cast("string")))


def _cut_by_shuffle(docs: DataFrame, lines: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    known = attach(lines, found.withColumn("hit", F.lit(True)), "key", 32)
    gone = known.where("hit and not (id <=> first_id and pos = first_pos)").groupBy("id", "text_hash").agg(F.collect_set("pos").alias("__gone"))
    gone = gone.withColumnsRenamed({"id": "__id", "text_hash": "__hash"})
    text = F.col(text_col).cast("string")
    joined = docs.withColumn("__h", F.xxhash64(text)).join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left")
    lines_of = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines_of, lambda x, i: ~F.array_contains(F.coalesce("__gone", F.array().cast("array<int>")), i)), "\n")
    n, removed = F.coalesce(F.size(lines_of), F.lit(0)), F.coalesce(F.size("__gone"), F.lit(0))
    made = F.struct(kept.alias("text"), F.when(text.isNull(), 0).otherwise(n).alias("n_lines"), F.when(F.col("__gone").isNull(), 0).otherwise(removed).alias("n_removed"))
    return joined.withColumn("__cut", made).drop("__id", "__hash", "__gone", "__h")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, by_shuffle: bool = False) -> DataFrame:
    """``docs`` with the text less its cross-site boilerplate lines, and columns n_lines and n_removed.

    Every row stays; a text may become empty.  Null texts stay null with 0 lines.  Blank lines are never boilerplate.
    Of equal first places (repeated rows of one id) each keeps the line.  The boilerplate table is broadcast below
    the engine's bounds, and joined by a shuffle beyond them (or with ``by_shuffle``), with the same result.
    """
    lines = materialise(line_table(docs, id_col, text_col, site_col))
    found = boilerplate(lines, sites)
    if by_shuffle or not small_enough(found, 32):
        cut = _cut_by_shuffle(docs, lines, found, id_col, text_col)
    else:
        discard(lines)
        cut = _cut_by_broadcast(docs, found, id_col, text_col)
    own = [cut["__cut"]["text"].alias(c) if c == text_col else cut[c] for c in docs.columns if c not in ("n_lines", "n_removed")]
    return cut.select(*own, cut["__cut"]["n_lines"].alias("n_lines"), cut["__cut"]["n_removed"].alias("n_removed"))


def without_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", length_col: str = "n_chars") -> DataFrame:
    """The documents with boilerplate lines cut and the length column, if there is one, brought up to date."""
    out = dedup_lines(docs, id_col, text_col, site_col)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col("n_removed") > 0, F.char_length(text_col).cast(dict(docs.dtypes)[length_col])).otherwise(F.col(length_col)))
    return out.select(*docs.columns)


def op7_lines(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
), spread AS (
  SELECT trim(line) AS bare FROM lines WHERE trim(line) <> '' GROUP BY trim(line) HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT l.*, s.bare IS NOT NULL AND row_number() OVER (PARTITION BY trim(l.line) ORDER BY doc_id, pos) > 1 AS gone
  FROM lines l LEFT JOIN spread s ON trim(l.line) = s.bare
), cut AS (
  SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (gone) AS INTEGER) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, text FROM cut
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""
