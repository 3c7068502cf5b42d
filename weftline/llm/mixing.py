"""Operator 2: mix sources to target weights.

Tokens are aggregated per source, a water-filling over the source totals gives each source its target, and a
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the fraction.

The draws of a source are coupled so that its words meet the target: its documents lie on a circle in the order of
their hashes, each as long as its words, and an arc of the fraction's length from a hash-seeded start gives a copy to
those whose middle it holds.  Over seeds each document's chance is the fraction; the words differ from the target by
half a document at either end of the arc.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.llm.common import fresh, table
from weftline.scratch import attach, discard, materialise, small_enough

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED = 1.5, 2, "mix-1"
#: Lower bits of a hash: places are found among the 4,096 stretches of the upper bits, then inside one stretch.
LOWER = 20


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bits(text: Column, seed: str) -> Column:
    """A number from 0 to 2 ** 32 - 1 that depends on the text and the seed only."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), text)), 1, 8), 16, 10).cast("long")


def draw(id_col: str, seed: str = SEED) -> Column:
    return bits(F.coalesce(F.col(id_col).cast("string"), F.lit("")), seed)


def source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources are ranked by code point, null last, without gathering them in one task: a range sort gives each row
    its place in its partition, and the few partition counts give the offsets.  The water level is found by
    aggregates over the source table alone: a source whose weight times the level exceeds its cap stops at the cap,
    and the rest is shared again, until none is above.  Sources of size 0 get target 0.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    ranked = materialise(ordered.select("source", "source_size", F.shiftright("at", 33).alias("part"), (F.col("at").bitwiseAND((1 << 33) - 1)).alias("place")))
    parts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    offsets = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") + F.col("before")) % len(weights) + 1).cast("int"))
    weighed = ranked.join(F.broadcast(offsets), "part").select("source", "source_size", weight.cast("double").alias("weight"), (F.lit(most) * F.col("source_size")).cast("double").alias("cap"))
    weighed = materialise(weighed)
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        low = F.col("cap") <= F.col("weight") * level if capped >= 0 else F.lit(False)
        n, used, left = weighed.agg(F.count_if(low), F.sum(F.when(low, F.col("cap")).otherwise(0.0)), F.sum(F.when(low, 0.0).otherwise(F.col("weight")))).first()
        if n == capped:
            break
        capped = n
        if not left:
            level = float("inf")
            break
        level = (total - used) / left
    target = F.least("cap", F.col("weight") * F.lit(level)) if level != float("inf") else F.col("cap")
    discard(ranked)
    return weighed.select("source", "source_size", target.alias("target"))


def arcs(sized: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """(key, source_size, target, whole, low, high, wraps) from rows (key, source, size, h): copies beyond ``whole``
    go to h in [low, high), or outside [high, low) where the arc wraps.

    The place of an arc's end among a source's hashes is found in two steps, by the upper and then the lower half of
    the hash; both are aggregates that each task starts on its own rows, so a source of any share gathers nowhere.
    """
    total = F.col("source_size").cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    begin = bits(F.col("key"), f"{seed}/start") / F.lit(4294967296.0) * total
    state = targets.withColumn("key", key).withColumn("whole", F.floor(rate)).withColumn("begin", begin)
    state = state.withColumn("stop", F.col("begin") + F.col("target") - F.col("whole") * F.col("source_size"))
    state = materialise(state.withColumn("wraps", F.col("stop") >= total).withColumn("stop", F.when(F.col("stop") >= total, F.col("stop") - total).otherwise(F.col("stop"))))
    points = state.where("source_size > 0").select("key", F.explode(F.create_map(F.lit("low"), "begin", F.lit("high"), "stop")).alias("which", "p"))
    upper = sized.groupBy("key", F.shiftright("h", LOWER).alias("b")).agg(F.sum("size").alias("n"))
    upper = materialise(upper.withColumn("upto", F.sum("n").over(W.partitionBy("key").orderBy("b"))))
    hint = F.broadcast if small_enough(points) else lambda df: df
    hit = upper.join(hint(points), "key").where("upto - n <= p and p < upto").select("key", "which", "p", "b", (F.col("upto") - F.col("n")).alias("before"))
    hit = materialise(hit)
    hint = F.broadcast if small_enough(hit) else lambda df: df
    lower = sized.withColumn("b", F.shiftright("h", LOWER)).join(hint(hit), ["key", "b"]).groupBy("key", "which", "p", "b", "before", "h").agg(F.sum("size").alias("n"))
    middle = F.col("before") + F.sum("n").over(W.partitionBy("key", "which").orderBy("h")) - F.col("n") / 2
    at = F.coalesce(F.min(F.when(F.col("middle") >= F.col("p"), F.col("h"))), (F.max("b") + 1) * (1 << LOWER))
    ends = lower.withColumn("middle", middle).groupBy("key", "which").agg(at.alias("at"))
    ends = ends.groupBy("key").agg(F.max(F.when(F.col("which") == "low", F.col("at"))).alias("low"), F.max(F.when(F.col("which") == "high", F.col("at"))).alias("high"))
    out = materialise(state.select("key", "source_size", "target", "whole", "wraps").join(ends, "key", "left"))
    discard(state, upper, hit)
    return out


def copies(h: Column, whole: str, low: str, high: str, wraps: str) -> Column:
    inside = F.when(F.col(wraps), (h >= F.col(low)) | (h < F.col(high))).otherwise((h >= F.col(low)) & (h < F.col(high)))
    return (F.col(whole) + F.coalesce(inside, F.lit(False)).cast("long")).cast("long")


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), source_key(source_col).alias("key"), n_words(text_col).alias("size"), draw(id_col, seed).alias("h")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(id, size, source_size, target, copies, taken) for every row of ``docs``.

    The text is read once; what follows works on (id, source, size).  Null text has size 0; a null source is a
    source of its own, ranked last; a null id draws as the empty id; rows that repeat an id draw alike.  An empty
    table gives an empty result.  Other columns are not looked at.
    """
    sized = sizes(docs, id_col, text_col, source_col, seed)
    lookup = arcs(sized, source_targets(sized, weights, share, most), seed)
    out = attach(sized, lookup, "key").withColumn("copies", copies(F.col("h"), "whole", "low", "high", "wraps"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, copy_name: str = "copy") -> DataFrame:
    """The documents as the mix takes them: each row as often as its copies, numbered from 1 in column ``copy``.

    The arcs are joined to the documents as a small table; texts are not shuffled.  A document of size 0 takes part
    like any other of its source; nulls, repeats and empty tables are as in ``mix``.  A column of the number's name is
    replaced, others stay whatever their names.
    """
    sized = sizes(docs, id_col, text_col, source_col, seed)
    key, whole, low, high, wraps, n = fresh(docs, "key", "whole", "low", "high", "wraps", "n")
    lookup = arcs(sized, source_targets(sized, weights, share, most), seed)
    lookup = materialise(lookup.select(*[F.col(a).alias(b) for a, b in (("key", key), ("whole", whole), ("low", low), ("high", high), ("wraps", wraps))]))
    discard(sized)
    out = attach(docs.withColumn(key, source_key(source_col)), lookup, key).withColumn(n, copies(draw(id_col, seed), whole, low, high, wraps).cast("int")).where(F.col(n) > 0)
    return out.select(*[F.col(c) for c in docs.columns if c != copy_name], F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy_name))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM totals
), filled AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS used, sum(weight) OVER rest AS remaining, (SELECT sum(source_size) * 1.5::DOUBLE FROM totals) AS total
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                      rest AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), water AS (
  SELECT max((total - used) / remaining) AS level FROM filled WHERE (total - used) / remaining < cap / weight
), targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM water)) AS target FROM weighed
), placed AS (
  SELECT s.doc_id, s.size, t.source, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h,
         CAST(('0x' || substr(md5('mix-1/start:' || coalesce('=' || t.source, '-')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE * t.source_size AS first
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), middles AS (
  SELECT *, first + target - floor(rate) * source_size AS stop,
         sum(size) OVER (PARTITION BY source ORDER BY h) - sum(size) OVER (PARTITION BY source, h) / 2.0::DOUBLE AS middle
  FROM placed
), drawn AS (
  SELECT *, floor(rate) + CASE WHEN source_size > 0 AND CASE WHEN stop >= source_size THEN middle >= first OR middle < stop - source_size ELSE middle >= first AND middle < stop END THEN 1 ELSE 0 END AS n
  FROM middles
)
SELECT doc_id, size, source_size, target, CAST(n AS BIGINT) AS copies, CAST(n * size AS BIGINT) AS taken FROM drawn
"""
