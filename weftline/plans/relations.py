"""Queries over the star schema and events: joins, linking, graphs, hierarchies, weights and persistence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.expressions import SECONDARY
from weftline.operators.aggregate import banded, confusion, cooccurrence_table, damp, effective_number, missing_rows, modularity, pair_purity, partial_row_norm, persistence, quantiles, shared_credit, team_weight
from weftline.operators.graph import connected_components
from weftline.operators.relational import dense_ids, enough_evidence, exactly_one, fallback_join, longest_contained, newman_weights, only_new, roll_up, scoped_lookup, stable_ids, two_hops
from weftline.plans.common import r6, table
from weftline.scratch import attach, materialise, small_enough

#: Namesakes from which two customers need a shared nation besides shared parts.
MANY = 5


def supply(spark, sf_dir: str) -> DataFrame:
    """Distinct (supplier, part) of line items, with how often."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


def author_pairs_newman(spark, sf_dir: str) -> DataFrame:
    """Co-membership ties: users as persons, (day, type) of their events as articles."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("/", F.date_format("ts", "yyyy-MM-dd"), "event_type").alias("item"), F.col("user_id").alias("person")).distinct()
    return newman_weights(e, "person", "item").select("a", "b", r6("w").alias("w"))


NEWMAN = """
WITH m AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') || '/' || event_type AS item, user_id AS person FROM events),
n AS (SELECT person, count(*) AS n FROM m GROUP BY person), d AS (SELECT item, count(*) AS d FROM m GROUP BY item),
p AS (SELECT x.item AS a, y.item AS b, sum(1.0::DOUBLE / (n - 1)) AS s, count(*) AS shared FROM m x JOIN m y ON x.person = y.person AND x.item < y.item JOIN n ON x.person = n.person GROUP BY 1, 2),
w AS (SELECT a, b, s / (x.d + y.d - shared) AS w FROM p JOIN d x ON a = x.item JOIN d y ON b = y.item),
r AS (SELECT a, sqrt(sum(w * w)) AS s FROM (SELECT a, w FROM w UNION ALL SELECT b, w FROM w) GROUP BY a)
SELECT w.a, w.b, round(w / pow(x.s * y.s, 0.25), 6) AS w FROM w JOIN r x ON w.a = x.a JOIN r y ON w.b = y.a
"""


def two_hop_paths(spark, sf_dir: str) -> DataFrame:
    """Suppliers tied through the parts both ship."""
    e = supply(spark, sf_dir).select(F.col("l_suppkey").alias("end"), F.col("l_partkey").alias("middle"), F.col("n").cast("double").alias("w"))
    return two_hops(e).select("a", "b", "paths", r6("w").alias("w"))


TWO_HOPS = """
WITH e AS (SELECT l_suppkey AS "end", l_partkey AS middle, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2), s AS (SELECT middle FROM e GROUP BY middle HAVING count(*) <= 200)
SELECT x."end" AS a, y."end" AS b, count(*) AS paths, round(sum(x.w * y.w), 6) AS w FROM e x JOIN e y ON x.middle = y.middle AND x."end" < y."end" WHERE x.middle IN (SELECT middle FROM s) GROUP BY 1, 2
"""


def exactly_one_match(spark, sf_dir: str) -> DataFrame:
    """Suppliers linked to the one customer of equal last two digits that lives in their nation."""
    key = lambda c: F.substring(c, -2, 2)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", key("s_name").alias("key"), "s_nationkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", key("c_name").alias("key"), "c_nationkey")
    out = exactly_one(s, c, "key", "s_suppkey", "c_custkey", F.col("s_nationkey") == F.col("c_nationkey"))
    return out.select("s_suppkey", "status", F.coalesce("match", F.lit(-1)).alias("match"))


EXACTLY_ONE = """
WITH m AS (SELECT s_suppkey, count(DISTINCT c_custkey) AS n, min(c_custkey) AS m FROM supplier JOIN customer ON right(s_name, 2) = right(c_name, 2) AND s_nationkey = c_nationkey GROUP BY 1)
SELECT s.s_suppkey, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS status, CASE WHEN n = 1 THEN m ELSE -1 END AS "match" FROM (SELECT DISTINCT s_suppkey FROM supplier) s LEFT JOIN m ON s.s_suppkey = m.s_suppkey
"""


def evidence_links(spark, sf_dir: str) -> DataFrame:
    """Pairs of customers of equal last two digits, with evidence: parts they both bought and a shared nation."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.substring("c_name", -2, 2).alias("key"), "c_nationkey").where("key is not null")
    names = c.groupBy("key").agg(F.count("*").alias("names"))
    # one row each, with how often it stands there; keys that repeat are told apart by rows
    c = c.groupBy("c_custkey", "key", "c_nationkey").agg(F.count("*").alias("m")).join(F.broadcast(names) if small_enough(names) else names, "key")
    repeated = c.groupBy("c_custkey").agg(F.count("*").alias("r")).where("r > 1").select("c_custkey", F.lit(True).alias("repeats"))
    # every pair asks for a shared part, and with many namesakes for a shared nation too
    c = attach(c, materialise(repeated), "c_custkey").withColumn("loose", F.coalesce("repeats", F.lit(False)) | (F.col("names") < MANY)).drop("repeats")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").where("o_custkey is not null")
    bought = orders.join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct()
    bought = materialise(bought.where("l_partkey is not null").join(c, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey"))
    x, y = bought.alias("x"), bought.alias("y")
    met = (F.col("x.key") == F.col("y.key")) & (F.col("x.l_partkey") == F.col("y.l_partkey")) & (F.col("x.c_custkey") < F.col("y.c_custkey"))
    near = x.where("not loose").join(y.where("not loose"), met & (F.col("x.c_nationkey") == F.col("y.c_nationkey")))
    columns = [F.col("x.c_custkey").alias("a"), F.col("y.c_custkey").alias("b"), F.col("x.key").alias("key"), F.col("x.names").alias("names"), F.col("x.c_nationkey").alias("u"), F.col("y.c_nationkey").alias("v"), (F.col("x.m") * F.col("y.m")).alias("m")]
    some = [near.select(*columns), x.where("loose").join(y, met).select(*columns), x.where("not loose").join(y.where("loose"), met).select(*columns)]
    pairs = reduce(DataFrame.unionByName, some).groupBy("a", "b", "key", "names", "u", "v", "m").agg(F.count("*").alias("n"))
    out = pairs.withColumn("common", F.sum(F.col("n") * F.col("m")).over(W.partitionBy("a", "b"))).withColumn("places", (F.col("u") == F.col("v")).cast("int"))
    out = out.where(enough_evidence(F.col("names"), F.col("common"), F.col("places"), MANY))
    return out.withColumn("each", F.explode(F.sequence(F.lit(1), F.col("m")))).select("a", "b", "common", "places")


EVIDENCE = """
WITH c AS (SELECT c_custkey, right(c_name, 2) AS key, c_nationkey, count(*) OVER (PARTITION BY right(c_name, 2)) AS names FROM customer),
t AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
p AS (SELECT x.c_custkey AS a, y.c_custkey AS b, x.names, CAST(x.c_nationkey = y.c_nationkey AS INTEGER) AS places FROM c x JOIN c y ON x.key = y.key AND x.c_custkey < y.c_custkey),
s AS (SELECT a, b, count(*) AS common FROM p JOIN t u ON u.o_custkey = a JOIN t v ON v.o_custkey = b AND v.l_partkey = u.l_partkey GROUP BY a, b)
SELECT p.a, p.b, coalesce(common, 0) AS common, places FROM p LEFT JOIN s ON p.a = s.a AND p.b = s.b
WHERE CASE WHEN names >= 5 THEN coalesce(common, 0) >= 2 AND places >= 1 ELSE coalesce(common, 0) >= 2 OR (coalesce(common, 0) >= 1 AND places >= 1) END
"""


def components_by_keys(spark, sf_dir: str) -> DataFrame:
    """Orders as components over shared keys: those of a customer's month, and those of a day, priority and status."""
    o = table(spark, sf_dir, "orders")
    keys = F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "-yyyyMM")), F.concat(F.lit("d"), F.date_format("o_orderdate", "yyyyMMdd"), "o_orderpriority", "o_orderstatus"))
    edges = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"), F.explode(keys).alias("dst"))
    found = connected_components(edges)
    return found.where("node like 'o%'").groupBy("component").agg(F.count("*").alias("n"), F.max("node").alias("last"))


COMPONENTS = """
WITH RECURSIVE e AS (SELECT 'o' || o_orderkey AS o, unnest(['c' || o_custkey || strftime(o_orderdate, '-%Y%m'), 'd' || strftime(o_orderdate, '%Y%m%d') || o_orderpriority || o_orderstatus]) AS k FROM orders),
edges AS (SELECT o AS a, k AS b FROM e UNION SELECT k, o FROM e),
reach(a, b) USING KEY (a) AS (
  SELECT a, a AS b FROM (SELECT DISTINCT a FROM edges)
  UNION
  SELECT e.a, min(r.b) AS b FROM edges e JOIN reach r ON e.b = r.a JOIN recurring.reach o ON o.a = e.a WHERE r.b < o.b GROUP BY e.a)
SELECT b AS component, count(*) AS n, max(a) AS last FROM reach WHERE a LIKE 'o%' GROUP BY b
"""


def hierarchy_rollup(spark, sf_dir: str) -> DataFrame:
    """Customers to nations to regions; a nation that two regions claim stays itself."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer")
    unit = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    links = c.select(unit("c", "c_custkey").alias("id"), unit("n", "c_nationkey").alias("parent")).unionByName(n.select(unit("n", "n_nationkey").alias("id"), unit("r", "n_regionkey").alias("parent")))
    links = links.unionByName(n.where("n_nationkey % 5 = 0").select(unit("n", "n_nationkey").alias("id"), F.lit("r9").alias("parent")))
    units = links.select("id").unionByName(links.select(F.col("parent").alias("id")))
    return roll_up(units, links, "id").groupBy("root").agg(F.count("*").alias("n"), F.min("id").alias("first"))


ROLLUP = """
WITH own AS (SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 AND n_regionkey <> 9 THEN 'n' || n_nationkey ELSE 'r' || n_regionkey END AS root FROM nation),
u AS (SELECT 'c' || c_custkey AS id, root FROM customer JOIN own ON c_nationkey = n_nationkey UNION SELECT 'n' || n_nationkey, root FROM own UNION SELECT 'r' || n_regionkey, 'r' || n_regionkey FROM nation UNION SELECT 'r9', 'r9')
SELECT root, count(*) AS n, min(id) AS first FROM u GROUP BY root
"""


def lookup_fallback(spark, sf_dir: str) -> DataFrame:
    """Two-key lookup: an order's segment by customer, else by the order's own key."""
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey")).alias("k1"), (F.col("c_custkey") * 7).alias("k2"), "c_mktsegment")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    out = fallback_join(o, c, "c_mktsegment", ("a", "k1"), ("b", "k2"), F.col("o_orderkey") % 5 == 0)
    return out.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


FALLBACK = """
WITH c AS (SELECT CASE WHEN c_custkey % 3 > 0 THEN c_custkey END AS k1, c_custkey * 7 AS k2, c_mktsegment AS s FROM customer),
x AS (SELECT o_orderkey, u.s AS one, v.s AS two FROM orders LEFT JOIN c u ON o_custkey = u.k1 LEFT JOIN c v ON o_orderkey = v.k2)
SELECT CASE WHEN o_orderkey % 5 = 0 THEN coalesce(two, one) ELSE coalesce(one, two) END AS c_mktsegment, count(*) AS n, min(o_orderkey) AS first FROM x GROUP BY 1
"""


def scope_precedence(spark, sf_dir: str) -> DataFrame:
    """Decisions by scope: own nation, then ``*other``, then everywhere."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("scope"), "c_mktsegment")
    seg = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    own = seg.where("c_mktsegment < 'C'").select(F.lit("3").alias("scope"), "c_mktsegment", F.lit("own").alias("decision"))
    other = seg.where("c_mktsegment < 'F'").select(F.lit("*other").alias("scope"), "c_mktsegment", F.lit("other").alias("decision"))
    world = seg.where("c_mktsegment > 'B'").select(F.lit(None).cast("string").alias("scope"), "c_mktsegment", F.lit("world").alias("decision"))
    return scoped_lookup(rows, own.unionByName(other).unionByName(world), "scope", "c_mktsegment", "decision").groupBy("decision").agg(F.count("*").alias("n"), F.max("c_custkey").alias("last"))


SCOPES = "SELECT CASE WHEN c_nationkey = 3 AND c_mktsegment < 'C' THEN 'own' WHEN c_mktsegment < 'F' THEN 'other' WHEN c_mktsegment > 'B' THEN 'world' END AS decision, count(*) AS n, max(c_custkey) AS last FROM customer GROUP BY 1"


def stable_cluster_ids(spark, sf_dir: str) -> DataFrame:
    """New clusters of parts (by size and brand) keep the ids of the old clusters (by brand)."""
    p = table(spark, sf_dir, "part")
    brands = dense_ids(p.select("p_brand").distinct(), ["p_brand"], "old").withColumn("old", F.col("old") + 1)
    old = p.where("p_partkey % 4 <> 1").join(F.broadcast(brands), "p_brand").select("p_partkey", "old")
    new = p.select("p_partkey", F.concat_ws("|", "p_brand", (F.col("p_size") > 25).cast("string")).alias("cluster"))
    return stable_ids(new, old, "p_partkey", "cluster", "old").select("cluster", "id")


STABLE = """
WITH RECURSIVE b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS old FROM (SELECT DISTINCT p_brand FROM part)),
p AS (SELECT p_partkey, p_brand || '|' || CAST(p_size > 25 AS VARCHAR) AS cluster, CASE WHEN p_partkey % 4 <> 1 THEN old END AS old FROM part JOIN b USING (p_brand)),
c AS (SELECT cluster, list_sort(list_distinct(list(old) FILTER (old IS NOT NULL))) AS claims, row_number() OVER (ORDER BY count(*) DESC, cluster) AS r FROM p GROUP BY cluster),
g AS (
  SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS VARCHAR) AS cluster, CAST(NULL AS BIGINT) AS id, CAST([] AS BIGINT[]) AS taken
  UNION ALL
  SELECT c.r, c.cluster, list_filter(c.claims, lambda x: NOT list_contains(g.taken, x))[1], list_concat(g.taken, list_filter(c.claims, lambda x: NOT list_contains(g.taken, x))[1:1]) FROM g JOIN c ON c.r = g.r + 1)
SELECT cluster, CAST(coalesce(id, (SELECT max(old) FROM p) + row_number() OVER (PARTITION BY id IS NULL ORDER BY cluster)) AS BIGINT) AS id FROM g WHERE r > 0
"""


def name_in_text(spark, sf_dir: str) -> DataFrame:
    """The longest nation or segment name an order's text contains, if unique (text made of names)."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.concat_ws(" ", F.lit("order of"), "n_name", F.lit("for"), "c_mktsegment", "o_orderpriority")
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.lit("segment").alias("kind")).distinct())
    out = longest_contained(o.select("o_orderkey", text.alias("text")), names, "o_orderkey", "text", "name", "kind")
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


NAMES = """
WITH o AS (SELECT o_orderkey, lower('order of ' || n_name || ' for ' || c_mktsegment || ' ' || o_orderpriority) AS text FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT DISTINCT lower(n_name) AS name, 'nation' AS kind FROM nation UNION SELECT DISTINCT lower(c_mktsegment), 'segment' FROM customer),
h AS (SELECT o_orderkey, kind, rank() OVER (PARTITION BY o_orderkey ORDER BY length(name) DESC) AS r FROM o JOIN n ON contains(text, name)),
b AS (SELECT o_orderkey, min(kind) AS kind FROM h WHERE r = 1 GROUP BY 1 HAVING count(DISTINCT kind) = 1)
SELECT kind, count(*) AS n, min(o_orderkey) AS first FROM b GROUP BY kind
"""


def purity_by_brand(spark, sf_dir: str) -> DataFrame:
    return pair_purity(table(spark, sf_dir, "part"), "p_brand", "p_type").select("p_brand", "n", r6("purity").alias("purity"))


PURITY = "SELECT p_brand, CAST(sum(c) AS BIGINT) AS n, CASE WHEN sum(c) > 1 THEN round(sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)), 6) END AS purity FROM (SELECT p_brand, p_type, count(*) AS c FROM part GROUP BY 1, 2) GROUP BY 1"


def entity_persistence(spark, sf_dir: str) -> DataFrame:
    """Users and event types of the second half-month that persist from the first."""
    e = table(spark, sf_dir, "events").select("user_id", F.concat_ws("/", "event_type", F.hour("ts").cast("string")).alias("kind"), (F.dayofmonth("ts") <= 15).alias("early"))
    out = persistence(e.where("early"), e.where("not early"), "user_id", "kind")
    return out.select(*[r6(c).alias(c) for c in out.columns])


PERSISTENCE = """
WITH e AS (SELECT DISTINCT user_id, event_type || '/' || hour(ts) AS kind, day(ts) <= 15 AS early FROM events), o AS (SELECT * FROM e WHERE early), n AS (SELECT * FROM e WHERE NOT early),
t AS (SELECT n.user_id, n.kind, n.user_id IN (SELECT user_id FROM o) AS r, n.kind IN (SELECT kind FROM o) AS c, o.kind IS NOT NULL AS t FROM n LEFT JOIN o ON n.user_id = o.user_id AND n.kind = o.kind)
SELECT round(count(DISTINCT CASE WHEN r THEN user_id END) / count(DISTINCT user_id), 6) AS rows, round(count(DISTINCT CASE WHEN c THEN kind END) / count(DISTINCT kind), 6) AS cols, round(count(*) FILTER (t) / count(*), 6) AS ties,
  round(sum(CASE WHEN r AND c THEN 0.5 WHEN r THEN 1 ELSE 0 END) / count(*), 6) AS row_mass, round(sum(CASE WHEN r AND c THEN 0.5 WHEN c THEN 1 ELSE 0 END) / count(*), 6) AS col_mass, round(count(*) FILTER (r OR c) / count(*), 6) AS any_mass FROM t
"""


def supplier_cooccurrence(spark, sf_dir: str) -> DataFrame:
    """Weighted co-occurrence of suppliers and parts: full lines as primary, returned ones as secondary ties."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("b"))
    v = partial_row_norm(cooccurrence_table(li, "l_suppkey", "l_partkey", "a", "b"), "l_suppkey")
    return v.groupBy("l_suppkey").agg(F.count("*").alias("n"), r6(F.sum("v")).alias("total"), r6(F.max("v")).alias("largest"))


COOCCURRENCE = f"""
WITH t AS (SELECT l_suppkey, l_partkey, count(*) FILTER (l_returnflag <> 'R') AS a, count(*) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY 1, 2), d AS (SELECT l_partkey, count(*) AS df FROM t GROUP BY 1),
v AS (SELECT l_suppkey, (ln(CAST((SELECT count(DISTINCT l_suppkey) FROM t) AS DOUBLE) / (df + 1)) + 1) * ln(1 + a + {SECONDARY!r} * b) AS v FROM t JOIN d USING (l_partkey)),
n AS (SELECT l_suppkey, sum(v * v) AS s FROM v GROUP BY 1)
SELECT l_suppkey, count(*) AS n, round(sum(CASE WHEN s > 0 THEN v * pow(s, -0.25) ELSE v END), 6) AS total, round(max(CASE WHEN s > 0 THEN v * pow(s, -0.25) ELSE v END), 6) AS largest FROM v JOIN n USING (l_suppkey) GROUP BY 1
"""


def organisation_shares(spark, sf_dir: str) -> DataFrame:
    """Each order gives its customer's suppliers equal shares; a customer's row has norm 1."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    s = shared_credit(li, "o_orderkey", "o_custkey", "l_suppkey")
    return s.groupBy("o_custkey").agg(F.count("*").alias("n"), r6(F.max("v")).alias("largest"), r6(F.sum("v")).alias("total"))


SHARES = """
WITH p AS (SELECT DISTINCT o_orderkey, o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey), k AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY o_orderkey, o_custkey) AS v FROM p),
s AS (SELECT o_custkey, l_suppkey, sum(v) AS v FROM k GROUP BY 1, 2), n AS (SELECT o_custkey, sqrt(sum(v * v)) AS n FROM s GROUP BY 1)
SELECT o_custkey, count(*) AS n, round(max(v / n.n), 6) AS largest, round(sum(v / n.n), 6) AS total FROM s JOIN n USING (o_custkey) GROUP BY 1
"""


def customers_without_orders(spark, sf_dir: str) -> DataFrame:
    """Missing rows: entities without a tie."""
    return missing_rows(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id")


MISSING = "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"


def team_weights(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return team_weight(li, "l_orderkey", "l_suppkey").groupBy("l_suppkey").agg(r6(F.sum("v")).alias("total"), F.count("*").alias("n"))


TEAMS = "SELECT l_suppkey, round(sum(v), 6) AS total, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey, 1.0::DOUBLE / sqrt(count(*) OVER (PARTITION BY l_orderkey)) AS v FROM lineitem) GROUP BY 1"


def damped_mass(spark, sf_dir: str) -> DataFrame:
    """Log damping by degrees with the mass restored."""
    t = supply(spark, sf_dir).select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("q").alias("v"))
    return damp(t, "row", "col").groupBy("row").agg(r6(F.sum("v")).alias("mass"), F.count("*").alias("n"))


DAMPED = """
WITH t AS (SELECT l_suppkey AS "row", l_partkey AS col, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), d AS (SELECT *, CAST(count(*) OVER (PARTITION BY "row") AS DOUBLE) AS a, CAST(count(*) OVER (PARTITION BY col) AS DOUBLE) AS b FROM t),
e AS (SELECT *, v * (ln(1 + a) / a) * (ln(1 + b) / b) AS w FROM d)
SELECT "row", round(sum(w) * (SELECT sum(v) / sum(w) FROM e), 6) AS mass, count(*) AS n FROM e GROUP BY 1
"""


def band_summary(spark, sf_dir: str) -> DataFrame:
    bands = [(0.0, 10.0, "small"), (10.0, 30.0, "medium"), (30.0, 1e9, "large")]
    return banded(table(spark, sf_dir, "lineitem"), "l_quantity", bands, {"n": F.count("*"), "price": r6(F.avg("l_extendedprice")), "discount": r6(F.avg("l_discount"))})


BANDS = "SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS band, count(*) AS n, round(avg(l_extendedprice), 6) AS price, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1"


def confusion_labels(spark, sf_dir: str) -> DataFrame:
    """Quality labels against a length rule."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return confusion(j.withColumn("answer", (F.col("n_chars") > 400).cast("int")), "quality", "answer")


CONFUSION = "SELECT quality, CAST(n_chars > 400 AS INTEGER) AS answer, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2"


def quantile_summary(spark, sf_dir: str) -> DataFrame:
    out = quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", r6("p10").alias("p10"), r6("p50").alias("p50"), r6("p90").alias("p90"), r6("max").alias("max"), "n")


QUANTILES = "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(max(l_extendedprice), 6) AS max, count(l_extendedprice) AS n FROM lineitem GROUP BY 1"


def effective_parts(spark, sf_dir: str) -> DataFrame:
    """Effective number of parts of each supplier by quantity."""
    return effective_number(supply(spark, sf_dir), ["l_suppkey"], "q").select("l_suppkey", r6("effective").alias("effective"))


EFFECTIVE = "WITH t AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), p AS (SELECT l_suppkey, q / sum(q) OVER (PARTITION BY l_suppkey) AS p FROM t WHERE q > 0) SELECT l_suppkey, round(exp(-sum(p * ln(p))), 6) AS effective FROM p GROUP BY 1"


def supplier_modularity(spark, sf_dir: str) -> DataFrame:
    """Modularity parts of nations as communities of the supplier graph."""
    e = two_hops(supply(spark, sf_dir).select(F.col("l_suppkey").alias("end"), F.col("l_partkey").alias("middle"), F.lit(1.0).alias("w"))).select("a", "b", "w")
    m = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("community"))
    out = modularity(e, m)
    return out.select("community", r6("inside").alias("inside"), r6("total").alias("total"), r6("part").alias("part"))


MODULARITY = """
WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS k FROM lineitem), g AS (SELECT k FROM p GROUP BY k HAVING count(*) <= 200),
e AS (SELECT x.s AS a, y.s AS b, CAST(count(*) AS DOUBLE) AS w FROM p x JOIN p y ON x.k = y.k AND x.s < y.s WHERE x.k IN (SELECT k FROM g) GROUP BY 1, 2),
c AS (SELECT e.*, u.s_nationkey AS ca, v.s_nationkey AS cb FROM e JOIN supplier u ON a = u.s_suppkey JOIN supplier v ON b = v.s_suppkey),
i AS (SELECT ca AS community, sum(w) AS inside FROM c WHERE ca = cb GROUP BY 1), t AS (SELECT community, sum(w) AS total FROM (SELECT ca AS community, w FROM c UNION ALL SELECT cb, w FROM c) GROUP BY 1), m AS (SELECT 2 * sum(w) AS m FROM e)
SELECT t.community, round(coalesce(inside, 0), 6) AS inside, round(total, 6) AS total, round(2 * coalesce(inside, 0) / m - pow(total / m, 2), 6) AS part FROM t LEFT JOIN i ON t.community = i.community, m
"""


def delta_rows(spark, sf_dir: str) -> DataFrame:
    """Only rows that are new or changed since the last run, by key and digest."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus")).alias("digest"))
    done = o.where("o_orderkey % 3 <> 0").withColumn("digest", F.when(F.col("o_orderkey") % 10 == 1, F.lit("")).otherwise(F.col("digest")))
    return only_new(o, done, ["o_orderkey", "digest"])


DELTA = "SELECT o_orderkey, md5(o_custkey || '|' || o_orderstatus) AS digest FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 10 = 1"

QUERIES = {f.__name__: f for f in (author_pairs_newman, two_hop_paths, exactly_one_match, evidence_links, components_by_keys, hierarchy_rollup, lookup_fallback, scope_precedence, stable_cluster_ids, name_in_text, purity_by_brand, entity_persistence, supplier_cooccurrence, organisation_shares, customers_without_orders, team_weights, damped_mass, band_summary, confusion_labels, quantile_summary, effective_parts, supplier_modularity, delta_rows)}
ORACLES = {
    "stable_cluster_ids": STABLE,
    "author_pairs_newman": NEWMAN, "two_hop_paths": TWO_HOPS, "exactly_one_match": EXACTLY_ONE, "evidence_links": EVIDENCE, "components_by_keys": COMPONENTS, "hierarchy_rollup": ROLLUP, "lookup_fallback": FALLBACK, "scope_precedence": SCOPES, "name_in_text": NAMES, "purity_by_brand": PURITY, "entity_persistence": PERSISTENCE,
    "supplier_cooccurrence": COOCCURRENCE, "organisation_shares": SHARES, "customers_without_orders": MISSING, "team_weights": TEAMS, "damped_mass": DAMPED, "band_summary": BANDS, "confusion_labels": CONFUSION, "quantile_summary": QUANTILES, "effective_parts": EFFECTIVE, "supplier_modularity": MODULARITY, "delta_rows": DELTA,
}
