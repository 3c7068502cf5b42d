"""Rank metrics, vector functions, sparse losses and fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.expressions import cohens_h, cosine, entropy_bits, js_distance, shares
from weftline.operators.factor import fit_jobs, masked_loss, pareto_front, predicted
from weftline.operators.ranking import auc, degree_weights, grouped_auc, log2_band, partial_spearman, shuffled, spearman, weighted_ap, within_class_ap
from weftline.plans.common import r6, table


def scored(spark, sf_dir: str) -> DataFrame:
    """Line items with a score (discounted price, two digits) and returned as positive."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("pos"))


SCORED = "sc AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(l_extendedprice * (1 - l_discount), 2) AS score, CAST(l_returnflag = 'R' AS INTEGER) AS pos FROM lineitem)"


def grouped_auc_by_supplier(spark, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("o", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    return grouped_auc(s, "l_suppkey", "score", "pos", "o").select("l_suppkey", r6("auc").alias("auc"))


GROUPED_AUC = f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score, l_orderkey, l_linenumber, l_partkey) AS r FROM sc) SELECT l_suppkey, CASE WHEN sum(pos) > 0 AND sum(pos) < count(*) THEN round((sum(CASE WHEN pos = 1 THEN r ELSE 0 END) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (count(*) - sum(pos))), 6) END AS auc FROM r GROUP BY 1"


def auc_average_ranks(spark, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("score", F.round(F.col("score") / 1000)).withColumn("g", F.col("l_suppkey") % 10)
    return auc(s, ["g"], "score", "pos").select("g", r6("auc").alias("auc"))


AUC = f"WITH {SCORED}, s AS (SELECT round(score / 1000) AS score, pos, l_suppkey % 10 AS g FROM sc), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY score) + (count(*) OVER (PARTITION BY g, score) - 1) / 2.0::DOUBLE AS r FROM s) SELECT g, round((sum(CASE WHEN pos = 1 THEN r END) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (count(*) - sum(pos))), 6) AS auc FROM r GROUP BY g"


def weighted_average_precision(spark, sf_dir: str) -> DataFrame:
    return weighted_ap(scored(spark, sf_dir), ["l_suppkey"], "score", "pos", 3.0).select("l_suppkey", r6("ap").alias("ap"))


AP = f"WITH {SCORED}, r AS (SELECT *, sum(pos) OVER w AS p, sum(1 - pos) OVER w AS q FROM sc WINDOW w AS (PARTITION BY l_suppkey ORDER BY score DESC RANGE UNBOUNDED PRECEDING)) SELECT l_suppkey, round(sum(CASE WHEN pos = 1 THEN p / (p + 3.0::DOUBLE * q) END) / sum(pos), 6) AS ap FROM r GROUP BY 1"


def class_average_precision(spark, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    rows = s.withColumn("dr", F.count("*").over(W.partitionBy("l_suppkey"))).withColumn("dc", F.count("*").over(W.partitionBy("l_partkey")))
    out = within_class_ap(rows, "dr", "dc", "score", "pos", 2.0)
    return out.select(*[r6(c).alias(c) for c in out.columns])


CLASS_AP = f"""
WITH {SCORED}, d AS (SELECT *, CAST(floor(log2(count(*) OVER (PARTITION BY l_suppkey) + 1)) AS INTEGER) AS a, CAST(floor(log2(count(*) OVER (PARTITION BY l_partkey) + 1)) AS INTEGER) AS b FROM sc),
r AS (SELECT *, sum(pos) OVER w AS p, sum(1 - pos) OVER w AS q FROM d WINDOW w AS (PARTITION BY a, b ORDER BY score DESC RANGE UNBOUNDED PRECEDING)),
c AS (SELECT a, b, sum(CASE WHEN pos = 1 THEN p / (p + 2.0::DOUBLE * q) END) AS s, sum(pos) AS n, sum(1 - pos) AS m FROM r GROUP BY a, b HAVING sum(pos) > 0)
SELECT round(sum(s) FILTER (m > 0) / sum(n) FILTER (m > 0), 6) AS ap, round(sum(n * n / (n + 2.0::DOUBLE * m)) FILTER (m > 0) / sum(n) FILTER (m > 0), 6) AS chance, round(sum(n) FILTER (m > 0) / sum(n), 6) AS covered FROM c
"""


def band_weights(spark, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("band", log2_band(F.count("*").over(W.partitionBy("l_partkey"))))
    return degree_weights(s, "band", "pos").select("band", r6("w").alias("w"))


BAND_WEIGHTS = f"WITH {SCORED}, d AS (SELECT pos, CAST(floor(log2(count(*) OVER (PARTITION BY l_partkey) + 1)) AS INTEGER) AS band FROM sc), n AS (SELECT band, sum(pos) AS p, sum(1 - pos) AS q FROM d GROUP BY 1) SELECT band, round((p / sum(p) OVER ()) / (q / sum(q) OVER ()), 6) AS w FROM n QUALIFY q > 0"


def spearman_prices(spark, sf_dir: str) -> DataFrame:
    return spearman(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", r6("rho").alias("rho"))


RANKS = "rank() OVER (PARTITION BY l_returnflag ORDER BY {0}) + (count(*) OVER (PARTITION BY l_returnflag, {0}) - 1) / 2.0::DOUBLE"
SPEARMAN = f"WITH r AS (SELECT l_returnflag, {RANKS.format('l_quantity')} AS x, {RANKS.format('l_extendedprice')} AS y FROM lineitem) SELECT l_returnflag, round(corr(x, y), 6) AS rho FROM r GROUP BY 1"


def partial_spearman_prices(spark, sf_dir: str) -> DataFrame:
    return partial_spearman(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_discount", "l_extendedprice", "l_quantity").select("l_returnflag", r6("rho").alias("rho"))


PARTIAL = f"WITH r AS (SELECT l_returnflag, {RANKS.format('l_discount')} AS x, {RANKS.format('l_extendedprice')} AS y, {RANKS.format('l_quantity')} AS z FROM lineitem), c AS (SELECT l_returnflag, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r GROUP BY 1) SELECT l_returnflag, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS rho FROM c"


def permutation_null(spark, sf_dir: str) -> DataFrame:
    """Agreement of brand and shuffled brand within types: a null for alignment, by portable random order."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    out = shuffled(p, "p_partkey", "p_brand", ["p_type"], "n1")
    return out.groupBy("p_type").agg(F.count("*").alias("n"), F.count_if(F.col("p_brand") == F.col("shuffled")).alias("kept"))


NULL_SHUFFLE = "WITH a AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS i, row_number() OVER (PARTITION BY p_type ORDER BY md5(p_partkey || '|n1')) AS j FROM part) SELECT x.p_type, count(*) AS n, count(*) FILTER (x.p_brand = y.p_brand) AS kept FROM a x JOIN a y ON x.p_type = y.p_type AND x.i = y.j GROUP BY 1"


def centroids(spark, sf_dir: str) -> DataFrame:
    """(label, c): mean absolute vector of each label, by position."""
    e = table(spark, sf_dir, "embeddings").where("label is not null").select("label", F.posexplode("embedding").alias("d", "x"))
    m = e.groupBy("label", "d").agg(F.avg(F.abs(F.col("x").cast("double"))).alias("x"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("c"))


CENTROIDS = "c AS (SELECT label, list(x ORDER BY d) AS c FROM (SELECT label, d, avg(abs(CAST(x AS DOUBLE))) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings WHERE label IS NOT NULL) GROUP BY 1, 2) GROUP BY 1), p AS (SELECT label, c, list_transform(c, lambda x: x / list_sum(c)) AS p FROM c)"


def label_distances(spark, sf_dir: str) -> DataFrame:
    """Cosine and Jensen-Shannon distance of the labels' mean vectors."""
    c = centroids(spark, sf_dir).withColumn("p", shares(F.col("c")))
    a, b = c.alias("a"), c.alias("b")
    return a.join(b, F.col("a.label") < F.col("b.label")).select(F.col("a.label").alias("i"), F.col("b.label").alias("j"), r6(cosine(F.col("a.c"), F.col("b.c"))).alias("cosine"), r6(js_distance(F.col("a.p"), F.col("b.p"))).alias("js"))


DISTANCES = f"WITH {CENTROIDS} SELECT a.label AS i, b.label AS j, round(list_cosine_similarity(a.c, b.c), 6) AS cosine, round(sqrt(greatest(list_sum(list_transform(range(1, len(a.p) + 1), lambda k: a.p[k] * ln(a.p[k] / ((a.p[k] + b.p[k]) / 2)) + b.p[k] * ln(b.p[k] / ((a.p[k] + b.p[k]) / 2)))) / 2, 0)), 6) AS js FROM p a JOIN p b ON a.label < b.label"


def vector_entropy(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", shares(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("p"))
    return e.select("vec_id", r6(entropy_bits(F.col("p"))).alias("bits"))


ENTROPY = "WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS a FROM embeddings), p AS (SELECT vec_id, list_transform(a, lambda x: x / list_sum(a)) AS p FROM a) SELECT vec_id, round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * log2(x) ELSE 0 END)), 6) AS bits FROM p"


def effect_size(spark, sf_dir: str) -> DataFrame:
    """Cohen's h of the returned share of each ship year against all."""
    li = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("year"), (F.col("l_returnflag") == "R").cast("int").alias("r"))
    total = li.agg(F.avg("r").alias("t"))
    return li.groupBy("year").agg(F.avg("r").alias("p")).crossJoin(F.broadcast(total)).select("year", r6(cohens_h(F.col("p"), F.col("t"))).alias("h"))


EFFECT = "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(2 * asin(sqrt(avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END))) - 2 * asin(sqrt((SELECT avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) FROM lineitem))), 6) AS h FROM lineitem GROUP BY 1"

CORE = np.array([[0.8, 0.1], [0.05, 0.6]])


def factor_table(ids: DataFrame, key: str) -> DataFrame:
    """Fixed two-component factors from an id, for the loss query."""
    return ids.select(F.col(key).alias("idx")).distinct().withColumn("u", F.array((F.col("idx") % 7 + 1) / 7.0, (F.col("idx") % 5 + 1) / 5.0))


def sparse_loss(spark, sf_dir: str) -> DataFrame:
    """Squared and Kullback-Leibler loss of the supplier-part matrix, two of its columns of ties hidden."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).agg((F.sum("l_quantity") / 50.0).alias("v"))
    rows, cols = factor_table(li, "row"), factor_table(li, "col")
    hidden = li.where("col % 97 = 3").select("row", "col")
    two, one = (masked_loss(li, rows, cols, CORE, hidden, beta=b) for b in (2, 1))
    return spark.createDataFrame([("kl", float(one)), ("square", float(two))], "kind string, loss double").select("kind", F.round("loss", 3).alias("loss"))


LOSS = """
WITH t AS (SELECT l_suppkey AS r, l_partkey AS c, sum(l_quantity) / 50.0::DOUBLE AS v FROM lineitem GROUP BY 1, 2),
a AS (SELECT DISTINCT r, (r % 7 + 1) / 7.0::DOUBLE AS u1, (r % 5 + 1) / 5.0::DOUBLE AS u2 FROM t), b AS (SELECT DISTINCT c, (c % 7 + 1) / 7.0::DOUBLE AS w1, (c % 5 + 1) / 5.0::DOUBLE AS w2 FROM t),
x AS (SELECT a.r, b.c, coalesce(v, 0) AS v, (u1 * 0.8::DOUBLE + u2 * 0.05::DOUBLE) * w1 + (u1 * 0.1::DOUBLE + u2 * 0.6::DOUBLE) * w2 AS h, v IS NOT NULL AND b.c % 97 = 3 AS hidden FROM a CROSS JOIN b LEFT JOIN t ON a.r = t.r AND b.c = t.c)
SELECT 'square' AS kind, round(sum((v - h) * (v - h)), 3) AS loss FROM x WHERE NOT hidden UNION ALL SELECT 'kl', round(sum(CASE WHEN v > 0 THEN v * ln(v / h) - v ELSE 0 END + h), 3) FROM x WHERE NOT hidden
"""


def cell_errors(spark, sf_dir: str) -> DataFrame:
    """Reproduced share and error of each supplier's ties under the fixed factors."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).agg((F.sum("l_quantity") / 50.0).alias("v"))
    p = predicted(li, factor_table(li, "row"), factor_table(li, "col"), CORE)
    return p.groupBy("row").agg(r6(F.sum(F.least("v", "xhat")) / F.sum("v")).alias("reproduced"), r6(F.avg(F.abs(F.col("v") - F.col("xhat")))).alias("error"), F.count("*").alias("n"))


CELLS = """
WITH t AS (SELECT l_suppkey AS "row", l_partkey AS c, sum(l_quantity) / 50.0::DOUBLE AS v FROM lineitem GROUP BY 1, 2),
x AS (SELECT *, ((("row" % 7 + 1) / 7.0::DOUBLE) * 0.8::DOUBLE + (("row" % 5 + 1) / 5.0::DOUBLE) * 0.05::DOUBLE) * ((c % 7 + 1) / 7.0::DOUBLE) + ((("row" % 7 + 1) / 7.0::DOUBLE) * 0.1::DOUBLE + (("row" % 5 + 1) / 5.0::DOUBLE) * 0.6::DOUBLE) * ((c % 5 + 1) / 5.0::DOUBLE) AS h FROM t)
SELECT "row", round(sum(least(v, h)) / sum(v), 6) AS reproduced, round(avg(abs(v - h)), 6) AS error, count(*) AS n FROM x GROUP BY 1
"""


def pareto_parts(spark, sf_dir: str) -> DataFrame:
    """Part sizes that are not dominated in price and number, with distance to the knee."""
    p = table(spark, sf_dir, "part").groupBy("p_size").agg(F.round(F.avg("p_retailprice"), 2).alias("price"), F.count("*").cast("double").alias("n"))
    return pareto_front(p, "p_size", ["price", "n"]).select("p_size", "price", "n", r6("knee").alias("knee"))


PARETO = """
WITH p AS (SELECT p_size, round(avg(p_retailprice), 2) AS price, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY 1), b AS (SELECT min(price) AS a, max(price) AS z, min(n) AS c, max(n) AS y FROM p)
SELECT p_size, price, n, round(sqrt(pow(CASE WHEN z > a THEN (price - a) / (z - a) ELSE 0 END, 2) + pow(CASE WHEN y > c THEN (n - c) / (y - c) ELSE 0 END, 2)), 6) AS knee FROM p, b
WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.price <= p.price AND q.n <= p.n AND (q.price < p.price OR q.n < p.n))
"""


def nmf_fit(spark, sf_dir: str) -> DataFrame:
    """Fits of the nation-by-month order matrix for three ranks, one task each."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    ties = o.groupBy(F.col("c_nationkey").cast("long").alias("row"), F.month("o_orderdate").cast("long").alias("col")).agg(F.log1p(F.count("*")).alias("v"))
    jobs = spark.createDataFrame([(f"k{k}", k, 1) for k in (2, 3, 5)], "job string, k int, seed int")
    return fit_jobs(jobs, ties).select("job", "k", "epochs", F.round("loss", 4).alias("loss"))


QUERIES = {f.__name__: f for f in (grouped_auc_by_supplier, auc_average_ranks, weighted_average_precision, class_average_precision, band_weights, spearman_prices, partial_spearman_prices, permutation_null, label_distances, vector_entropy, effect_size, sparse_loss, cell_errors, pareto_parts, nmf_fit)}
ORACLES = {
    "grouped_auc_by_supplier": GROUPED_AUC, "auc_average_ranks": AUC, "weighted_average_precision": AP, "class_average_precision": CLASS_AP, "band_weights": BAND_WEIGHTS, "spearman_prices": SPEARMAN, "partial_spearman_prices": PARTIAL, "permutation_null": NULL_SHUFFLE, "label_distances": DISTANCES, "vector_entropy": ENTROPY, "effect_size": EFFECT, "sparse_loss": LOSS, "cell_errors": CELLS, "pareto_parts": PARETO,
}
