"""Rank metrics, sampling and hold-outs.  Four conventions for ties coexist; each function names its own."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.expressions import hash_order


def grouped_auc(rows: DataFrame, group: str, score: str, positive: str, order: str) -> DataFrame:
    """(group, auc): Mann-Whitney with ranks in sorted order; ``order`` settles equal scores.  Null for one class."""
    ranked = rows.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy(score, order)))
    n = ranked.groupBy(group).agg(F.sum(positive).alias("p"), F.count("*").alias("n"), F.sum(F.when(F.col(positive) == 1, F.col("__r"))).alias("s"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return n.select(group, F.when((p > 0) & (q > 0), (F.col("s") - p * (p + 1) / 2) / (p * q)).alias("auc"))


def average_rank(score: Column, by: list[str]) -> Column:
    """Average of the ranks that equal scores share."""
    return F.rank().over(W.partitionBy(*by).orderBy(score)) + (F.count("*").over(W.partitionBy(*by, score)) - 1) / 2.0


def auc(rows: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """AUC with average ranks."""
    ranked = rows.withColumn("__r", average_rank(F.col(score), by))
    n = ranked.groupBy(*by).agg(F.sum(positive).alias("p"), F.count("*").alias("n"), F.sum(F.when(F.col(positive) == 1, F.col("__r"))).alias("s"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return n.select(*by, F.when((p > 0) & (q > 0), (F.col("s") - p * (p + 1) / 2) / (p * q)).alias("auc"))


def weighted_ap(rows: DataFrame, by: list[str], score: str, positive: str, weight: float) -> DataFrame:
    """Average precision with negatives weighted; ties count against the positive."""
    # scores are added up first, so a window sees one row a distinct score
    at = rows.groupBy(*by, score).agg(F.sum(F.col(positive)).alias("p"), F.sum(1 - F.col(positive)).alias("q"))
    w = W.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    at = at.withColumn("__p", F.sum("p").over(w)).withColumn("__q", F.sum("q").over(w))
    return at.groupBy(*by).agg((F.sum(F.when(F.col("p") > 0, F.col("p") * F.col("__p") / (F.col("__p") + weight * F.col("__q")))) / F.sum("p")).alias("ap"))


def log2_band(degree: Column) -> Column:
    return F.floor(F.log2(degree.cast("double") + 1)).cast("int")


def within_class_ap(rows: DataFrame, row_degree: str, col_degree: str, score: str, positive: str, weight: float) -> DataFrame:
    """(ap, chance, covered): AP inside classes of equal log2 bands of both degrees, weighted by their positives;
    classes without a negative are left out and their share of positives is what ``covered`` lacks."""
    classed = rows.withColumn("__a", log2_band(F.col(row_degree))).withColumn("__b", log2_band(F.col(col_degree)))
    ap = weighted_ap(classed, ["__a", "__b"], score, positive, weight)
    n = classed.groupBy("__a", "__b").agg(F.sum(positive).alias("n"), F.sum(1 - F.col(positive)).alias("m"))
    x = ap.join(n, ["__a", "__b"]).where("n > 0")
    ok = F.col("m") > 0
    pos = F.sum(F.when(ok, F.col("n")))
    return x.agg((F.sum(F.when(ok, F.col("ap") * F.col("n"))) / pos).alias("ap"), (F.sum(F.when(ok, F.col("n") * F.col("n") / (F.col("n") + weight * F.col("m")))) / pos).alias("chance"), (pos / F.sum("n")).alias("covered"))


def degree_weights(rows: DataFrame, band: str, positive: str) -> DataFrame:
    """(band, w): weight of a band's negatives so that they match the positives' bands."""
    n = rows.groupBy(band).agg(F.sum(positive).alias("p"), F.sum(1 - F.col(positive)).alias("q"))
    t = n.agg(F.sum("p").alias("tp"), F.sum(F.when(F.col("p") >= 0, F.col("q"))).alias("tq"))
    return n.where("q > 0").crossJoin(F.broadcast(t)).select(band, ((F.col("p") / F.col("tp")) / (F.col("q") / F.col("tq"))).alias("w"))


def effective_sample_size(w: Column) -> Column:
    return F.pow(F.sum(w), 2) / F.sum(w * w)


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    ranked = rows.withColumn("__x", average_rank(F.col(x), by)).withColumn("__y", average_rank(F.col(y), by))
    return ranked.groupBy(*by).agg(F.corr("__x", "__y").alias("rho"))


def partial_spearman(rows: DataFrame, by: list[str], x: str, y: str, z: str) -> DataFrame:
    """Spearman of x and y with the ranks of one covariate taken out of both."""
    ranked = rows
    for name, col in (("__x", x), ("__y", y), ("__z", z)):
        ranked = ranked.withColumn(name, average_rank(F.col(col), by))
    r = ranked.groupBy(*by).agg(F.corr("__x", "__y").alias("xy"), F.corr("__x", "__z").alias("xz"), F.corr("__y", "__z").alias("yz"))
    return r.select(*by, ((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))).alias("rho"))


def shuffled(rows: DataFrame, key: str, value: str, strata: list[str], seed: str) -> DataFrame:
    """``value`` dealt anew inside each stratum by a portable random order; column ``shuffled``."""
    w = W.partitionBy(*strata)
    a = rows.withColumn("__i", F.row_number().over(w.orderBy(key)))
    b = rows.withColumn("__i", F.row_number().over(w.orderBy(hash_order(F.col(key), seed)))).select(*strata, "__i", F.col(value).alias("shuffled"))
    return a.join(b, [*strata, "__i"]).drop("__i")


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def stratified_sample(rows: DataFrame, strata: list[str], key: str, n: int, seed: str, used: DataFrame | None = None) -> DataFrame:
    """n rows a stratum without replacement, none of those used before."""
    left = rows.join(used.select(key).distinct(), key, "left_anti") if used is not None else rows
    return top_k(left, strata, [hash_order(F.col(key), seed), F.col(key)], n).drop("rank")


def first_occurrence(rows: DataFrame, keys: list[str], order: list[str], item: str) -> DataFrame:
    """The first row of each key by ``order``, with the items of the others in order as ``also_in``."""
    w = W.partitionBy(*keys).orderBy(*order)
    every = F.collect_list(item).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.withColumn("also_in", every).withColumn("__r", F.row_number().over(w)).where("__r = 1").withColumn("also_in", F.slice("also_in", 2, F.greatest(F.size("also_in") - 1, F.lit(0)))).drop("__r")


def adjacency_runs(rows: DataFrame, group: str, position: str, opens: Column, most: int = 10) -> DataFrame:
    """Rows that continue an open run: a run starts where ``opens`` holds after a row where it does not, and covers
    up to ``most`` rows of consecutive positions.  Columns run (number in the group) and step (place in the run)."""
    w = W.partitionBy(group).orderBy(position)
    gap = F.coalesce(F.col(position) - F.lag(position).over(w) != 1, F.lit(True))
    start = opens & (gap | ~F.coalesce(F.lag(opens).over(w), F.lit(False)))
    run = F.sum(start.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = rows.withColumn("run", run).withColumn("__open", opens).where("__open")
    step = F.row_number().over(W.partitionBy(group, "run").orderBy(position))
    return marked.withColumn("step", step).where(F.col("step") <= most).drop("__open")


def continuations(rows: DataFrame, group: str, position: str, text: Column, labels: Column, opens: str = "\u201c", closes: str = "\u201d", most: int = 10) -> DataFrame:
    """Rows that ``labels`` marks (step 0) and those that continue a quotation they leave open, in column ``step``.

    A quotation is open behind a row if its opening marks (and the one it began in) outnumber its closing ones; it goes
    on at the next position only, for ``most`` rows at most, and a labelled row starts anew.  What a row is depends on
    the ``most`` rows before it, so a window of that many is folded and no group is gathered."""
    marks = lambda m: F.char_length(text) - F.char_length(F.replace(text, F.lit(m), F.lit("")))
    row = F.struct(F.col(position).cast("long").alias("p"), F.coalesce(labels, F.lit(False)).alias("l"), F.coalesce(marks(opens) - marks(closes), F.lit(0)).alias("b"))
    near = rows.withColumn("__near", F.collect_list(row).over(W.partitionBy(group).orderBy(position).rowsBetween(-most, 0)))

    def fold(state: Column, x: Column) -> Column:
        goes_on = ~x["l"] & state["open"] & (x["p"] == state["p"] + 1) & (state["step"] < most)
        step = F.when(x["l"], 0).when(goes_on, state["step"] + 1).otherwise(-1)
        return F.struct(x["p"].alias("p"), step.alias("step"), F.coalesce((step >= 0) & (F.when(x["l"], 0).otherwise(1) + x["b"] > 0), F.lit(False)).alias("open"))

    start = F.struct(F.lit(None).cast("long").alias("p"), F.lit(-1).alias("step"), F.lit(False).alias("open"))
    return near.withColumn("step", F.aggregate("__near", start, fold, lambda state: state["step"])).where("step >= 0").drop("__near")


def draw_tie_groups(ties: list[tuple[int, int]], groups: int = 10, seed: str = "0") -> list[int]:
    """A group for each tie, or -1: a tie is eligible if both ends have two ties or more; in one group an entity
    loses min(max(1, n // 3), n - 1) of its n ties at most.

    The caps are sequential state, so one relation is drawn in one place, in the hash order of its ties; relations
    run side by side as jobs."""
    import hashlib

    rows, cols = defaultdict(int), defaultdict(int)
    for r, c in ties:
        rows[r] += 1
        cols[c] += 1
    cap = lambda n: min(max(1, n // 3), n - 1)
    out, used_r, used_c = [-1] * len(ties), defaultdict(int), defaultdict(int)
    order = sorted(range(len(ties)), key=lambda i: hashlib.md5(f"{ties[i][0]},{ties[i][1]}|{seed}".encode()).hexdigest())
    for i in order:
        r, c = ties[i]
        if rows[r] < 2 or cols[c] < 2:
            continue
        first = int(hashlib.md5(f"g{r},{c}|{seed}".encode()).hexdigest(), 16) % groups
        for k in range(groups):
            g = (first + k) % groups
            if used_r[r, g] < cap(rows[r]) and used_c[c, g] < cap(cols[c]):
                out[i] = g
                used_r[r, g] += 1
                used_c[c, g] += 1
                break
    return out


def empty_cells(ties: DataFrame, rows: DataFrame, n_cols: int, n: int, seed: int) -> DataFrame:
    """(row, col) of about n empty cells without rejection: ranks among the empty cells are drawn, and a rank is
    mapped to its cell by the row's running count and its ties.  ``rows``: row; ``ties``: row, col in 0..n_cols-1."""
    own = ties.groupBy("row").agg(F.array_sort(F.collect_set("col")).alias("full"))
    r = rows.select("row").distinct().join(own, "row", "left").withColumn("full", F.coalesce("full", F.array().cast("array<bigint>")))
    r = r.withColumn("free", F.lit(n_cols) - F.size("full"))
    total = r.agg(F.sum("free")).first()[0] or 0
    share = min(1.0, n / total) if total else 0.0
    # a row draws its part of the ranks, the fraction by chance, and each draw lies in a stretch of its own: no rank
    # that is not drawn is ever made
    u = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.least(F.col("free"), (F.floor(F.col("free") * share) + (u(F.lit("n"), F.col("row")) < F.col("free") * share - F.floor(F.col("free") * share)).cast("int"))).cast("int")
    ranks = r.withColumn("draws", wanted).where("draws > 0").withColumn("d", F.explode(F.sequence(F.lit(0), F.col("draws") - 1)))
    low, high = F.floor(F.col("d") * F.col("free") / F.col("draws")), F.floor((F.col("d") + 1) * F.col("free") / F.col("draws"))
    ranks = ranks.withColumn("k", (low + F.floor(u(F.lit("k"), F.col("row"), F.col("d")) * (high - low))).cast("long"))
    # the rank moves up by one for every full column at or below it
    col = F.aggregate("full", F.col("k").cast("bigint"), lambda s, x: F.when(x <= s, s + 1).otherwise(s))
    return ranks.select("row", col.alias("col"))
