"""Evaluation of fits and archives of fits: folds, held-out scores, placed entities, comparisons."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.operators.aggregate import partial_row_norm, tf_idf_table
from weftline.operators.factor import FLOOR
from weftline.operators.similarity import hungarian


def fold_values(ties: DataFrame, groups: int, row: str = "row", col: str = "col", tf: str = "tf") -> DataFrame:
    """(fold, row, col, v): for each fold the weights computed from its visible ties alone.  ``ties`` carries
    ``group`` (-1 is never hidden); every statistic is per fold, so nothing of a hidden tie leaks."""
    folds = ties.sparkSession.range(groups).select(F.col("id").cast("int").alias("fold"))
    seen = ties.crossJoin(F.broadcast(folds)).where(F.col("group") != F.col("fold"))
    n = seen.groupBy("fold").agg(F.countDistinct(row).alias("n"))
    df = seen.select("fold", row, col).distinct().groupBy("fold", col).agg(F.count("*").alias("df"))
    v = seen.join(df, ["fold", col]).join(F.broadcast(n), "fold")
    v = v.select("fold", row, col, (F.log1p(F.col(tf).cast("double")) * (F.log(F.col("n") / (F.col("df") + 1)) + 1)).alias("v"))
    n2 = F.sum(F.col("v") * F.col("v")).over(W.partitionBy("fold", row))
    return v.withColumn("v", F.when(n2 > 0, F.col("v") * F.pow(n2, -0.25)).otherwise(F.col("v")))


def all_values(ties: DataFrame, row: str = "row", col: str = "col", tf: str = "tf") -> DataFrame:
    return partial_row_norm(tf_idf_table(ties, row, col, tf), row)


def heldout_scores(cells: DataFrame, by: list[str]) -> DataFrame:
    """Captured share, Kullback-Leibler error and share over-predicted of held-out ties (v, xhat)."""
    x, p = F.col("v"), F.greatest(F.col("xhat"), F.lit(FLOOR))
    return cells.groupBy(*by).agg((1 - F.sum((x - F.col("xhat")) ** 2) / F.sum(x * x)).alias("captured"), F.sum(F.when(x > 0, x * F.log(x / p) - x + p).otherwise(p)).alias("kl"), F.avg((F.col("xhat") > x).cast("double")).alias("over"))


def error_parts(cells: DataFrame) -> DataFrame:
    """Squared error on ties and on empty cells, and the calibration (sum predicted by sum true)."""
    e = (F.col("v") - F.col("xhat")) ** 2
    return cells.agg(F.sum(F.when(F.col("v") > 0, e).otherwise(0.0)).alias("ties"), F.sum(F.when(F.col("v") == 0, e).otherwise(0.0)).alias("empty"), (F.sum("xhat") / F.sum("v")).alias("calibration"))


def placed(shares: DataFrame, entity: str, share: str, baseline: str) -> DataFrame:
    """(entity, gain, placed): mean gain over the baseline exceeds its spread across seeds."""
    gain = F.col(share) - F.col(baseline)
    return shares.groupBy(entity).agg(F.avg(gain).alias("gain"), (F.avg(gain) > F.coalesce(F.stddev_samp(share), F.lit(0.0))).alias("placed"))


def sampled_negatives(entities: DataFrame, ties: DataFrame, n_cols: int, each: int = 200, seed: int = 0) -> DataFrame:
    """(row, col): ``each`` draws of columns a row that are no ties, by a hash of row and draw."""
    draws = entities.select("row").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(each))))
    cells = draws.select("row", F.pmod(F.xxhash64("row", "k", F.lit(seed)), F.lit(n_cols)).alias("col")).distinct()
    return cells.join(ties.select("row", "col"), ["row", "col"], "left_anti")


def detached_pairs(presence: DataFrame, tied: DataFrame, high: float = 0.5, low: float = 0.1) -> DataFrame:
    """(k, f, g): components present in facet f and nearly absent from a facet g tied to it directly.
    ``presence``: facet, k, p; ``tied``: f, g."""
    a, b = presence.select(F.col("facet").alias("f"), "k", F.col("p").alias("pf")), presence.select(F.col("facet").alias("g"), "k", F.col("p").alias("pg"))
    both = tied.select("f", "g").unionByName(tied.select(F.col("g").alias("f"), F.col("f").alias("g"))).distinct()
    return a.join(both, "f").join(b, ["g", "k"]).where((F.col("pf") >= high) & (F.col("pg") < low)).select("k", "f", "g")


def diagonal_rule(core: DataFrame) -> DataFrame:
    """(k, ratio): a component's own cell by the largest other in its row or column.  ``core``: k, l, z."""
    off = core.where("k <> l")
    big = off.select("k", "z").unionByName(off.select(F.col("l").alias("k"), "z")).groupBy("k").agg(F.max("z").alias("m"))
    return core.where("k = l").join(big, "k").select("k", (F.col("z") / F.col("m")).alias("ratio"))


def anchor_guard(parts: DataFrame) -> DataFrame:
    """One row (within, n, over_half, share_over_half) of a table of parts k, l, z: the diagonal's share of all, and the
    components (with half their row's and column's weight) whose own cell is over half of their row and of their column."""
    own = parts.groupBy("k", "l").agg(F.sum("z").alias("z"))
    sides = own.select("k", "z", F.lit(0.0).alias("c"), F.when(F.col("k") == F.col("l"), F.col("z")).otherwise(0.0).alias("d"))
    sides = sides.unionByName(own.select(F.col("l").alias("k"), F.lit(0.0).alias("z"), F.col("z").alias("c"), F.lit(0.0).alias("d")))
    each = sides.groupBy("k").agg(F.sum("z").alias("row"), F.sum("c").alias("col"), F.sum("d").alias("own"))
    over = (F.col("own") > 0.5 * F.col("row")) & (F.col("own") > 0.5 * F.col("col"))
    total = F.sum("row")
    return each.agg((F.sum("own") / total).alias("within"), F.count("*").alias("n"), F.count_if(over).alias("over_half"), (F.sum(F.when(over, F.col("row") + F.col("col")).otherwise(0.0)) / (2 * total)).alias("share_over_half"))


def paired_difference(results: DataFrame, arm: str, seed: str, value: str, one: str, two: str) -> DataFrame:
    """(n, mean, sd) of value under arm two less arm one over the seeds both have."""
    a, b = results.where(F.col(arm) == one).select(seed, F.col(value).alias("x")), results.where(F.col(arm) == two).select(seed, F.col(value).alias("y"))
    return a.join(b, seed).agg(F.count("*").alias("n"), F.avg(F.col("y") - F.col("x")).alias("mean"), F.stddev_samp(F.col("y") - F.col("x")).alias("sd"))


def band_harm(rows: DataFrame, band: str, exposed: str, value: str) -> DataFrame:
    """Difference of exposed and other rows' means within bands, weighted by the exposed."""
    b = rows.groupBy(band).agg(F.count_if(F.col(exposed)).alias("n"), F.avg(F.when(F.col(exposed), F.col(value))).alias("e"), F.avg(F.when(~F.col(exposed), F.col(value))).alias("o"))
    b = b.where("n > 0 and o is not null")
    return b.agg((F.sum(F.col("n") * (F.col("e") - F.col("o"))) / F.sum("n")).alias("harm"))


def recurrence(failures: DataFrame, n_seeds: int) -> DataFrame:
    """(item, share): share of the other seeds a failure recurs in.  ``failures``: seed, item."""
    return failures.select("seed", "item").distinct().groupBy("item").agg(((F.count("*") - 1) / F.lit(max(1, n_seeds - 1))).alias("share"))


def total_variation(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 2


def strength_choice(results: list[dict]) -> float:
    """Largest strength within the best score's band: score >= best - se(best), value guard passed, stability not
    below that of strength 0."""
    base = next(r for r in results if r["strength"] == 0)
    best = max(results, key=lambda r: r["score"])
    good = [r["strength"] for r in results if r["score"] >= best["score"] - best["se"] and r["guard"] and r["stability"] >= base["stability"]]
    return max(good, default=0.0)


def align_chain(cores: list[np.ndarray]) -> list[list[int]]:
    """Numberings of facets along a chain of relations: each core's columns matched to its rows, carried forward."""
    out, order = [], list(range(len(cores[0]))) if cores else []
    for z in cores:
        match = [c for _, c in hungarian((-z[order]).tolist())]
        out.append(match)
        order = match
    return out


def permutation_test(core: np.ndarray, rounds: int = 200, seed: int = 0) -> float:
    """Share of random matchings whose least matched cell reaches that of the best one."""
    best = min(core[r, c] for r, c in hungarian((-core).tolist()))
    rng = np.random.default_rng(seed)
    return sum(min(core[i, j] for i, j in enumerate(rng.permutation(len(core)))) >= best for _ in range(rounds)) / rounds


def smoothness(memberships: DataFrame, similar: DataFrame) -> DataFrame:
    """Word-similarity penalty: mean over rows of sum of W_ij / d_i times the squared distance of memberships.
    ``memberships``: idx, p; ``similar``: i, j, w (both triangles)."""
    d = F.sum("w").over(W.partitionBy("i"))
    e = similar.withColumn("s", F.col("w") / d).join(memberships.select(F.col("idx").alias("i"), F.col("p").alias("pi")), "i").join(memberships.select(F.col("idx").alias("j"), F.col("p").alias("pj")), "j")
    gap = F.aggregate(F.zip_with("pi", "pj", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    n = memberships.agg(F.count("*").alias("n"))
    return e.agg(F.sum(F.col("s") * gap).alias("t")).crossJoin(F.broadcast(n)).select((F.coalesce("t", F.lit(0.0)) / F.col("n")).alias("penalty"))


def entropy_floor(p: np.ndarray, floor: float) -> float:
    """Mean hinge of membership entropies below a floor (natural logarithm)."""
    q = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
    h = -np.where(q > 0, q * np.log(np.where(q > 0, q, 1)), 0).sum(axis=1)
    return float(np.maximum(floor - h, 0).mean())


def off_diagonal_share(core: np.ndarray) -> float:
    return float(1 - np.trace(core) / max(core.sum(), 1e-300))


def hypervolume(points: list[tuple[float, float]], reference: tuple[float, float]) -> float:
    """Area two smaller-is-better objectives dominate up to the reference."""
    area, ceiling = 0.0, reference[1]
    for x, y in sorted(p for p in points if p[0] < reference[0] and p[1] < reference[1]):
        if y < ceiling:
            area += (reference[0] - x) * (ceiling - y)
            ceiling = y
    return area


def bonferroni(p_values: list[float]) -> list[float]:
    return [min(1.0, p * len(p_values)) for p in p_values]


def effective_rank(s: np.ndarray) -> float:
    """(sum of squares)^2 by the sum of fourth powers of singular values."""
    return float((s**2).sum() ** 2 / (s**4).sum())


def two_proportion_z(a: int, n: int, b: int, m: int) -> float:
    p = (a + b) / (n + m)
    return (a / n - b / m) / math.sqrt(p * (1 - p) * (1 / n + 1 / m))
