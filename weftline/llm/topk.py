"""Operator 8: exact top-k inner products by dual-tree cover-tree search.

Queries are taken in blocks of bounded size.  For each block the driver grows the query tree and a first floor for
every query's kth score from a bounded sample of candidates; tasks grow cover trees over their rows and search both
trees together.  A task returns at most k rows a query, and the floor removes most of those before the merge.  Each
block's rows are written before the next block starts, so neither plan nor driver grows with the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.llm.common import table
from weftline.llm.covertree import LOWEST, Best, cover_tree, dual_search
from weftline.scratch import discard, materialise, reserve

#: Queries a block, candidates sampled for the first floor, candidates under one data tree, and in one task at most.
BLOCK, SAMPLE, ROWS, TASK = 16_384, 4_096, 4_096, 65_536


def integer_vectors(frame: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, x): x = floor(scale * component) as doubles; vectors null or holding null or non-finite components and
    rows without an id are left out."""
    ok = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = frame.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(ok & F.col("id").isNotNull()).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("x"))


def dense(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows as a matrix of ``width``; shorter vectors are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    values = np.asarray(column.flatten(), dtype=np.float64)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def top_inner_products(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, scale: int = 64, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each row whose id is divisible by
    ``every`` with all rows of another id; ties go to the smaller id.

    Shorter vectors count as filled with zeros.  Rows that repeat an id are candidates each.  With fewer than k
    candidates all are returned.  An empty table gives no rows.  Scores are exact while width * max**2 < 2**53.
    """
    spark = frame.sparkSession
    rows = materialise(integer_vectors(frame, id_col, vector_col, scale))
    n, width, first, last = rows.agg(F.count("*"), F.max(F.size("x")), F.min(F.when(F.col("id") % every == 0, F.col("id"))), F.max(F.when(F.col("id") % every == 0, F.col("id")))).first()
    shape = "query_id long, vec_id long, score long"
    if not n or first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = rows.where(F.col("id") % every == 0).dropDuplicates(["id"])
    parts = max(-(-n // TASK), min(-(-n // ROWS), 4 * spark.sparkContext.defaultParallelism))
    dealt = rows.repartition(parts)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(1.0, SAMPLE / n) * (1 << 30)).limit(2 * SAMPLE).toArrow()
    sx, sid = dense(sample.column("x"), width), sample.column("id").to_numpy()
    pieces = -(-asked.count() // block)
    folder, found = reserve(spark), None
    for piece in range(pieces):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(pieces)) == piece).toArrow()
        if not some.num_rows:
            continue
        qx, qid = dense(some.column("x"), width), some.column("id").to_numpy()
        first_best = Best(len(qid), k)
        if len(sid):
            dual_search(cover_tree(qx), qx, qid, cover_tree(sx), sx, sid, first_best)
        shared = spark.sparkContext.broadcast((qx.astype(np.float32) if np.abs(qx).max(initial=0) < 1 << 23 else qx, qid, first_best.kth))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qx, qid, floor = shared.value
            qx = qx.astype(np.float64)
            tree, best, held = None, Best(len(qid), k, floor), []

            def drain() -> None:
                nonlocal tree
                tree = tree or cover_tree(qx)
                part = pa.Table.from_batches(held)
                dx, did = dense(part.column("x"), width), part.column("id").to_numpy()
                held.clear()
                for s in range(0, len(did), ROWS):
                    dual_search(tree, qx, qid, cover_tree(dx[s : s + ROWS]), dx[s : s + ROWS], did[s : s + ROWS], best)

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                if sum(b.num_rows for b in held) >= ROWS:
                    drain()
            if held:
                drain()
            row, col = np.nonzero(best.scores > LOWEST)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(best.ids[row, col]), pa.array(best.scores[row, col])], ["query_id", "vec_id", "score"])

        found = dealt.mapInArrow(search, shape)
        if pieces > 1:
            found.write.mode("append").parquet(folder)
            shared.unpersist()
    if pieces > 1:
        found = spark.read.schema(shape).parquet(folder)
        discard(rows)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
