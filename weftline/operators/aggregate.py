"""Weights, norms, persistence, purity and summary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.expressions import cooccurrence, ladder, tf_idf


def tf_idf_table(pairs: DataFrame, row: str, col: str, tf: str) -> DataFrame:
    """(row, col, v) with v = ln(1 + tf) * (ln(N / (df + 1)) + 1); df counts distinct pairs, N distinct rows."""
    n = pairs.select(row).distinct().count()
    df = pairs.select(row, col).distinct().groupBy(col).agg(F.count("*").alias("df"))
    return pairs.join(df, col).select(row, col, tf_idf(F.col(tf), F.lit(n), F.col("df")).alias("v"))


def cooccurrence_table(pairs: DataFrame, row: str, col: str, primary: str, secondary: str) -> DataFrame:
    n = pairs.select(row).distinct().count()
    df = pairs.select(row, col).distinct().groupBy(col).agg(F.count("*").alias("df"))
    return pairs.join(df, col).select(row, col, cooccurrence(F.col(primary), F.col(secondary), F.lit(n), F.col("df")).alias("v"))


def partial_row_norm(ties: DataFrame, row: str, value: str = "v") -> DataFrame:
    """v over the square root of its row's norm."""
    n2 = F.sum(F.col(value) * F.col(value)).over(W.partitionBy(row))
    return ties.withColumn(value, F.when(n2 > 0, F.col(value) * F.pow(n2, -0.25)).otherwise(F.col(value)))


def row_norm(ties: DataFrame, row: str, value: str = "v") -> DataFrame:
    n2 = F.sum(F.col(value) * F.col(value)).over(W.partitionBy(row))
    return ties.withColumn(value, F.when(n2 > 0, F.col(value) / F.sqrt(n2)).otherwise(F.col(value)))


def shared_credit(rows: DataFrame, unit: str, holder: str, target: str) -> DataFrame:
    """(holder, target, v): each unit gives 1 / k to its k distinct targets, rows scaled to norm 1.  Holders without
    a target are missing rows: ``missing_rows`` names them."""
    pairs = rows.where(F.col(target).isNotNull()).select(unit, holder, target).distinct()
    k = F.count("*").over(W.partitionBy(unit, holder))
    return row_norm(pairs.withColumn("v", 1.0 / k).groupBy(holder, target).agg(F.sum("v").alias("v")), holder)


def missing_rows(entities: DataFrame, ties: DataFrame, key: str) -> DataFrame:
    return entities.select(key).distinct().join(ties.select(key).distinct(), key, "left_anti")


def team_weight(bylines: DataFrame, team: str, person: str) -> DataFrame:
    """(person, team, v): one over the root of the team's bylines; a person counts once a team."""
    n = F.count("*").over(W.partitionBy(team))
    return bylines.withColumn("v", 1.0 / F.sqrt(n)).select(person, team, "v").distinct()


def frobenius(ties: DataFrame, hidden: DataFrame | None = None, masked_diagonal: bool = False) -> float:
    """Root of the sum of squares over observed cells (row, col, v)."""
    rows = ties.join(hidden.select("row", "col").distinct(), ["row", "col"], "left_anti") if hidden is not None else ties
    rows = rows.where("row <> col") if masked_diagonal else rows
    return rows.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)))).first()[0]


def damp(ties: DataFrame, row: str, col: str, value: str = "v") -> DataFrame:
    """v * log1p(d) / d by the row's and column's number of ties, rescaled so that the total mass is kept."""
    d = lambda key: F.count("*").over(W.partitionBy(key)).cast("double")
    damped = ties.withColumn("__d", F.col(value) * (F.log1p(d(row)) / d(row)) * (F.log1p(d(col)) / d(col)))
    mass = damped.agg(F.sum(value).alias("__a"), F.sum("__d").alias("__b"))
    return damped.crossJoin(F.broadcast(mass)).withColumn(value, F.col("__d") * F.col("__a") / F.col("__b")).drop("__d", "__a", "__b")


def relation_weights(domains: dict[str, list[str]], split: dict[str, float] | None = None) -> dict[str, float]:
    """Weight of each relation: domains share one equally, relations share their domain by ``split`` or equally."""
    out = {}
    for relations in domains.values():
        part = [(split or {}).get(r, 1.0) for r in relations]
        out |= {r: p / sum(part) / len(domains) for r, p in zip(relations, part)}
    return out


def best_spelling(forms: DataFrame, group: str, form: str, count: str) -> DataFrame:
    """(group, form): the most frequent form; ties prefer one with a joiner, then the shorter, then the first."""
    total = forms.groupBy(group, form).agg(F.sum(count).alias("__c"))
    order = F.struct((-F.col("__c")).alias("a"), (~F.col(form).contains("_")).alias("b"), F.length(form).alias("c"), F.col(form).alias("d"))
    return total.groupBy(group).agg(F.min(order).alias("__o")).select(group, F.col("__o.d").alias(form))


def keep_majority(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Rows of each key's largest label group; if two are largest none stays."""
    size = F.count("*").over(W.partitionBy(key, label))
    sized = rows.withColumn("__n", size)
    top = sized.withColumn("__m", F.max("__n").over(W.partitionBy(key))).where("__n = __m")
    one = F.size(F.collect_set(label).over(W.partitionBy(key))) == 1
    return top.withColumn("__one", one).where("__one").drop("__n", "__m", "__one")


def drop_repeated(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The label is void where it stands twice within the keys."""
    n = F.count(label).over(W.partitionBy(*keys, label))
    return rows.withColumn(label, F.when(n <= 1, F.col(label)))


def quantiles(rows: DataFrame, value: str, by: list[str], points: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Linear (inclusive) quantiles, the maximum and the count."""
    cols = [F.expr(f"percentile({value}, {p})").alias(f"p{round(100 * p)}") for p in points]
    return rows.groupBy(*by).agg(*cols, F.max(value).alias("max"), F.count(value).alias("n"))


def exclusive_quantile(values: str, p: float) -> Column:
    """Quantile at p(n+1) of a sorted array column (the exclusive definition), clamped to its ends."""
    a, n = F.col(values), F.size(values)
    pos = F.greatest(F.lit(1.0), F.least(n.cast("double"), F.lit(p) * (n + 1)))
    low = F.floor(pos).cast("int")
    at = lambda i: F.element_at(a, F.least(i, n).cast("int"))
    return F.when(n > 0, at(low) + (pos - low) * (at(low + 1) - at(low)))


def banded(rows: DataFrame, value: str, bands: list[tuple[float, float, str]], measures: dict[str, Column]) -> DataFrame:
    """Aggregates by band; a band is [low, high)."""
    band = ladder([((F.col(value) >= lo) & (F.col(value) < hi), name) for lo, hi, name in bands], "other")
    return rows.withColumn("band", band).groupBy("band").agg(*[c.alias(n) for n, c in measures.items()])


def confusion(rows: DataFrame, truth: str, answer: str) -> DataFrame:
    return rows.groupBy(truth, answer).agg(F.count("*").alias("n"))


def pair_purity(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(group, n, purity): share of a group's pairs with equal labels, in closed form; null for a single row."""
    c = rows.groupBy(group, label).agg(F.count("*").alias("c")).groupBy(group).agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("s"))
    n = F.col("n")
    return c.select(group, "n", F.when(n > 1, F.col("s") / (n * (n - 1))).alias("purity"))


def persistence(old: DataFrame, new: DataFrame, row: str, col: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Shares of the new slice's rows, columns, ties and tie mass that persist from the old one, for each ``by`` (such as
    the pair of facets): a tie whose two ends persist gives each half its mass, one with a single persisting end gives
    that end all.  A tie's mass is the sum of ``weight`` over its rows, or 1."""
    by = by or []
    a_row, a_col = old.select(*by, row).distinct().withColumn("__r", F.lit(1)), old.select(*by, col).distinct().withColumn("__c", F.lit(1))
    a_tie = old.select(*by, row, col).distinct().withColumn("__t", F.lit(1))
    t = new.groupBy(*by, row, col).agg((F.sum(weight).cast("double") if weight else F.lit(1.0)).alias("__m"))
    t = t.join(a_row, [*by, row], "left").join(a_col, [*by, col], "left").join(a_tie, [*by, row, col], "left")
    r, c = F.col("__r").isNotNull(), F.col("__c").isNotNull()
    mass = lambda share: F.sum(F.col("__m") * share) / F.sum("__m")
    return t.groupBy(*by).agg(
        (F.countDistinct(F.when(r, F.col(row))) / F.countDistinct(row)).alias("rows"),
        (F.countDistinct(F.when(c, F.col(col))) / F.countDistinct(col)).alias("cols"),
        (F.count("__t") / F.count("*")).alias("ties"),
        mass(F.when(r & c, 0.5).when(r, 1.0).otherwise(0.0)).alias("row_mass"),
        mass(F.when(r & c, 0.5).when(c, 1.0).otherwise(0.0)).alias("col_mass"),
        mass(F.when(r | c, 1.0).otherwise(0.0)).alias("any_mass"),
    )


def effective_number(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """exp of the entropy of the values' shares."""
    p = F.col(value) / F.sum(value).over(W.partitionBy(*by))
    return rows.where(F.col(value) > 0).withColumn("__p", p).groupBy(*by).agg(F.exp(-F.sum(F.col("__p") * F.log("__p"))).alias("effective"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(community, inside, total, part): contributions of each community; the sum of part is the modularity.
    ``edges``: a, b, w with a < b; ``membership``: node, community."""
    m = membership.select(F.col("node").alias("a"), F.col("community").alias("ca")), membership.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    e = edges.join(m[0], "a").join(m[1], "b")
    inside = e.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("w").alias("inside"))
    ends = e.select(F.col("ca").alias("community"), "w").unionByName(e.select(F.col("cb").alias("community"), "w"))
    total = ends.groupBy("community").agg(F.sum("w").alias("total"))
    two_m = edges.agg((2 * F.sum("w")).alias("two_m"))
    out = total.join(inside, "community", "left").crossJoin(F.broadcast(two_m))
    ins = F.coalesce("inside", F.lit(0.0))
    part = 2 * ins / F.col("two_m") - F.pow(F.col("total") / F.col("two_m"), 2)
    return out.select("community", ins.alias("inside"), "total", part.alias("part"))
