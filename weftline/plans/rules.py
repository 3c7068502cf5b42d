"""Queries of quotations, categories, places, tie mass and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.aggregate import persistence
from weftline.operators.evaluation import anchor_guard
from weftline.operators.ranking import continuations
from weftline.operators.relational import longest_contained, roll_up_by_category
from weftline.plans.common import r6, table


def open_quotations(spark, sf_dir: str) -> DataFrame:
    """Labelled turns and those that continue them while more commas than stops were seen (commas open, stops close)."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    out = continuations(turns, "conv_id", "turn", F.col("text"), F.char_length("text") % 3 == 0, ",", ".")
    return out.select("conv_id", "turn", "step")


QUOTATIONS = """
WITH RECURSIVE t AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2),
m AS (SELECT conv_id, turn, coalesce(length(text) % 3 = 0, false) AS label, coalesce(length(replace(text, '.', '')) - length(replace(text, ',', '')), 0) AS balance FROM t),
f AS (SELECT conv_id, turn, 0 AS step, balance > 0 AS open FROM m WHERE label
  UNION ALL SELECT m.conv_id, m.turn, f.step + 1, 1 + m.balance > 0 FROM f JOIN m ON m.conv_id = f.conv_id AND m.turn = f.turn + 1 WHERE f.open AND f.step < 10 AND NOT m.label)
SELECT conv_id, turn, step FROM f
"""


def organisation_categories(spark, sf_dir: str) -> DataFrame:
    """Customers, nations and regions: regions absorb nations only, nations any building or automobile customer; some
    customers also hang on the next nation."""
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    key = lambda mark, col: F.concat(F.lit(mark), F.col(col).cast("string"))
    units = c.select(key("c", "c_custkey").alias("unit"), F.lit("customer").alias("category"), F.col("c_mktsegment").alias("kind"))
    units = units.unionByName(n.select(key("n", "n_nationkey").alias("unit"), F.lit("nation").alias("category"), F.lit("nation").alias("kind")))
    units = units.unionByName(r.select(key("r", "r_regionkey").alias("unit"), F.lit("region").alias("category"), F.lit("region").alias("kind")))
    parents = c.select(key("c", "c_custkey").alias("unit"), key("n", "c_nationkey").alias("parent")).unionByName(n.select(key("n", "n_nationkey").alias("unit"), key("r", "n_regionkey").alias("parent")))
    parents = parents.unionByName(c.where("c_custkey % 3 = 0").select(key("c", "c_custkey").alias("unit"), F.concat(F.lit("n"), ((F.col("c_nationkey") + 1) % 25).cast("string")).alias("parent")))
    absorbs = spark.createDataFrame([("region", "nation"), ("nation", "BUILDING"), ("nation", "AUTOMOBILE")], "category string, kind string")
    found = roll_up_by_category(units, parents, "unit", "category", "kind", absorbs)
    return found.groupBy("root", "how").agg(F.count("*").alias("n"), F.min("unit").alias("first"))


CATEGORIES = """
WITH p AS (SELECT c_custkey, c_mktsegment, unnest(CASE WHEN c_custkey % 3 = 0 THEN [c_nationkey, (c_nationkey + 1) % 25] ELSE [c_nationkey] END) AS nationkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')),
t AS (SELECT c_custkey, count(DISTINCT n_regionkey) AS k, min('r' || n_regionkey) AS top FROM p JOIN nation ON nationkey = n_nationkey GROUP BY 1),
u AS (
  SELECT 'c' || c.c_custkey AS unit, CASE WHEN k = 1 THEN top ELSE 'c' || c.c_custkey END AS root, CASE WHEN k = 1 THEN 'merged' WHEN k > 1 THEN 'joint' ELSE 'itself' END AS how FROM customer c LEFT JOIN t ON t.c_custkey = c.c_custkey
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'merged' FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey, 'itself' FROM region)
SELECT root, how, count(*) AS n, min(unit) AS first FROM u GROUP BY root, how
"""


def name_in_place(spark, sf_dir: str) -> DataFrame:
    """The longest nation name an order's text contains, only names of the text's own region counting."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", ((F.col("c_custkey") + F.col("c_nationkey")) % 5).cast("int").alias("place"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    texts = o.select("o_orderkey", F.concat_ws(" ", F.lit("order of"), "n_name", F.lit("at"), "o_orderpriority").alias("text"), "place")
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation"), F.col("n_regionkey").cast("int").alias("place"))
    out = longest_contained(texts, names, "o_orderkey", "text", "name", "nation", "place")
    return out.groupBy("nation").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


PLACED_NAMES = """
WITH o AS (SELECT o_orderkey, lower('order of ' || n_name || ' at ' || o_orderpriority) AS text, (c_custkey + c_nationkey) % 5 AS place FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT o_orderkey, n_nationkey AS nation, rank() OVER (PARTITION BY o_orderkey ORDER BY length(n_name) DESC) AS r FROM o JOIN nation ON n_regionkey = place AND contains(text, lower(n_name))),
b AS (SELECT o_orderkey, min(nation) AS nation FROM h WHERE r = 1 GROUP BY 1 HAVING count(DISTINCT nation) = 1)
SELECT nation, count(*) AS n, min(o_orderkey) AS first FROM b GROUP BY nation
"""


def persistence_mass(spark, sf_dir: str) -> DataFrame:
    """Suppliers and parts of the later years that were there before, by return flag, ties weighing their quantity."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_partkey", F.col("l_quantity").cast("double").alias("q"), (F.year("l_shipdate") < 1998).alias("early"))
    out = persistence(li.where("early"), li.where("not early"), "l_suppkey", "l_partkey", "q", ["l_returnflag"])
    return out.select("l_returnflag", *[r6(c).alias(c) for c in out.columns if c != "l_returnflag"])


MASS = """
WITH e AS (SELECT l_returnflag, l_suppkey, l_partkey, sum(l_quantity) AS q, year(l_shipdate) < 1998 AS early FROM lineitem GROUP BY ALL),
o AS (SELECT * FROM e WHERE early), n AS (SELECT * FROM e WHERE NOT early), rs AS (SELECT DISTINCT l_returnflag, l_suppkey FROM o), cs AS (SELECT DISTINCT l_returnflag, l_partkey FROM o),
t AS (SELECT n.*, rs.l_suppkey IS NOT NULL AS r, cs.l_partkey IS NOT NULL AS c, o.l_suppkey IS NOT NULL AS t FROM n LEFT JOIN rs USING (l_returnflag, l_suppkey) LEFT JOIN cs ON cs.l_returnflag = n.l_returnflag AND cs.l_partkey = n.l_partkey
  LEFT JOIN o ON o.l_returnflag = n.l_returnflag AND o.l_suppkey = n.l_suppkey AND o.l_partkey = n.l_partkey)
SELECT l_returnflag, round(count(DISTINCT CASE WHEN r THEN l_suppkey END) / count(DISTINCT l_suppkey), 6) AS rows, round(count(DISTINCT CASE WHEN c THEN l_partkey END) / count(DISTINCT l_partkey), 6) AS cols, round(count(*) FILTER (t) / count(*), 6) AS ties,
  round(sum(CASE WHEN r AND c THEN 0.5 * q WHEN r THEN q ELSE 0 END) / sum(q), 6) AS row_mass, round(sum(CASE WHEN r AND c THEN 0.5 * q WHEN c THEN q ELSE 0 END) / sum(q), 6) AS col_mass, round(sum(CASE WHEN r OR c THEN q ELSE 0 END) / sum(q), 6) AS any_mass FROM t GROUP BY l_returnflag
"""


def trade_anchors(spark, sf_dir: str) -> DataFrame:
    """Guard of the nations' own trade: parts are sums of quantities between a supplier's and a customer's region, own
    trade counting fourfold."""
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("k"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_regionkey").alias("l"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("double").alias("q"))
    parts = li.join(s, "l_suppkey").join(o, "l_orderkey").groupBy("k", "l").agg(F.sum("q").alias("z"))
    parts = parts.withColumn("z", F.when(F.col("k") == F.col("l"), 4 * F.col("z")).otherwise(F.col("z")))
    return anchor_guard(parts).select(r6("within").alias("within"), "n", "over_half", r6("share_over_half").alias("share_over_half"))


ANCHORS = """
WITH p AS (SELECT a.n_regionkey AS k, b.n_regionkey AS l, sum(l_quantity) * CASE WHEN a.n_regionkey = b.n_regionkey THEN 4 ELSE 1 END AS z FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation b ON c_nationkey = b.n_nationkey GROUP BY 1, 2),
r AS (SELECT k, sum(z) AS rw, sum(CASE WHEN k = l THEN z ELSE 0 END) AS d FROM p GROUP BY k), c AS (SELECT l AS k, sum(z) AS cw FROM p GROUP BY l)
SELECT round(sum(d) / sum(rw), 6) AS within, count(*) AS n, count(*) FILTER (d > 0.5 * rw AND d > 0.5 * cw) AS over_half, round(sum(CASE WHEN d > 0.5 * rw AND d > 0.5 * cw THEN rw + cw ELSE 0 END) / (2 * sum(rw)), 6) AS share_over_half FROM r JOIN c USING (k)
"""

_PAIRS = ((open_quotations, QUOTATIONS), (organisation_categories, CATEGORIES), (name_in_place, PLACED_NAMES), (persistence_mass, MASS), (trade_anchors, ANCHORS))
QUERIES = {f.__name__: f for f, _ in _PAIRS}
ORACLES = {f.__name__: sql for f, sql in _PAIRS}
