"""Queries of shares, names, partitions, memberships, selection rules and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.expressions import day_of, masked, rewrite, tokens
from weftline.functions.names import fold, name_key, name_similarity, text_udf, token_spans
from weftline.operators import aggregate, curation, measures, related
from weftline.operators.blockjoin import joined
from weftline.operators.graph import connected_components
from weftline.operators.ranking import spearman
from weftline.operators.relational import dense_ids
from weftline.plans.common import r6, table
from weftline.plans.text import NEAR_DUP, SETS, document_bags, near_dup_knn_ties
from weftline.scratch import materialise, reserve
from weftline.sources.records import load_matrix, parsed_byline, save_matrix


def near_dup_side_ties(spark, sf_dir: str) -> DataFrame:
    """The flagship's pairs at 0.5, each side's three best on its own."""
    bags, h = document_bags(table(spark, sf_dir, "documents"))
    return measures.side_ties(joined(bags, 0.5, h), 3, 0.5).select("i", "j", r6("sim").alias("sim"))


SIDE_TIES = f"""
WITH {SETS},
pairs AS (SELECT a.i AS i, b.i AS j, sum(a.idf) AS o FROM w a JOIN w b ON a.token = b.token AND a.i < b.i WHERE a.idf > 0 GROUP BY a.i, b.i),
sims AS (SELECT p.i, p.j, round(o / (x.weight + y.weight - o), 9) AS sim FROM pairs p JOIN ws x ON p.i = x.i JOIN ws y ON p.j = y.i WHERE x.weight + y.weight - o > 0),
sides AS (SELECT i, j, sim FROM sims WHERE sim >= 0.5 UNION ALL SELECT j, i, sim FROM sims WHERE sim >= 0.5)
SELECT i, j, round(sim, 6) AS sim FROM sides QUALIFY rank() OVER (PARTITION BY i ORDER BY sim DESC) <= 3
"""


def persistence_weighted(spark, sf_dir: str) -> DataFrame:
    """Share of parts ordered in the later years that were ordered before, a status each: unweighted, by rarity, of parts on
    several orders, and both."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), "l_partkey", F.year("l_shipdate").alias("y"))
    mid = li.agg(F.avg("y").alias("mid"))
    li = li.crossJoin(F.broadcast(mid))
    df = li.groupBy("l_partkey").agg(F.count("*").alias("df"))
    old = li.where("y < mid").select("status", "l_partkey").distinct()
    new = li.where("y >= mid").groupBy("status", "l_partkey").agg(F.count("*").alias("k")).join(df, "l_partkey")
    idf, many = 1 / F.col("df"), F.when(F.col("k") > 1, 1.0).otherwise(0.0)
    out = measures.weighted_persistence(old, new, ["status"], "l_partkey", {"plain": F.lit(1.0), "rare": idf, "repeated": many, "rare_repeated": idf * many})
    return out.select("status", "n", *[r6(c).alias(c) for c in ("plain", "rare", "repeated", "rare_repeated")])


PERSISTENCE_WEIGHTED = """
WITH li AS (SELECT l_linestatus AS status, l_partkey, year(l_shipdate) AS y, avg(year(l_shipdate)) OVER () AS mid FROM lineitem),
df AS (SELECT l_partkey, count(*) AS df FROM li GROUP BY 1), old AS (SELECT DISTINCT status, l_partkey FROM li WHERE y < mid),
new AS (SELECT status, l_partkey, count(*) AS k FROM li WHERE y >= mid GROUP BY 1, 2),
j AS (SELECT n.*, 1.0::DOUBLE / df AS idf, CASE WHEN k > 1 THEN 1.0::DOUBLE ELSE 0 END AS many, CASE WHEN o.l_partkey IS NULL THEN 0.0::DOUBLE ELSE 1 END AS p FROM new n JOIN df USING (l_partkey) LEFT JOIN old o ON o.status = n.status AND o.l_partkey = n.l_partkey)
SELECT status, count(*) AS n, round(avg(p), 6) AS plain, round(sum(idf * p) / sum(idf), 6) AS rare, round(sum(many * p) / sum(many), 6) AS repeated, round(sum(idf * many * p) / sum(idf * many), 6) AS rare_repeated FROM j GROUP BY status
"""


def yearly_shares(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    size = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.least(F.count("*"), F.lit(4)).alias("items"))
    cases = {"urgent": F.col("o_orderpriority").startswith("1"), "open": F.col("o_orderstatus") == "O", "urgent_if_open": F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority").startswith("1"))}
    out = measures.share_table(o.join(size, "o_orderkey"), ["year", "items"], cases)
    return out.select("year", "items", "n", *[r6(c).alias(c) for c in cases])


YEARLY = """
WITH s AS (SELECT l_orderkey AS o_orderkey, least(count(*), 4) AS items FROM lineitem GROUP BY 1)
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, items, count(*) AS n, round(avg(CAST(o_orderpriority LIKE '1%' AS DOUBLE)), 6) AS urgent, round(avg(CAST(o_orderstatus = 'O' AS DOUBLE)), 6) AS open,
  round(avg(CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderpriority LIKE '1%' AS DOUBLE) END), 6) AS urgent_if_open FROM orders JOIN s USING (o_orderkey) GROUP BY 1, 2
"""


def eligible_orders(spark, sf_dir: str) -> DataFrame:
    """Orders above a total with a returned item, none of whose items is still open."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return measures.eligible(o, "o_orderkey", [li.where("l_returnflag = 'R'")], [li.where("l_linestatus = 'O'")], F.col("o_totalprice") > 1000).select("o_orderkey", "o_orderpriority")


ELIGIBLE = "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 1000 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')"


def order_tag_classes(spark, sf_dir: str) -> DataFrame:
    tagged = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("tags"))
    kind = measures.tag_ladder("tags", [(["R"], "returned"), (["A", "X"], "accepted")], "other")
    return tagged.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


TAG_CLASSES = "WITH t AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS tags FROM lineitem GROUP BY 1) SELECT CASE WHEN list_contains(tags, 'R') THEN 'returned' WHEN list_has_any(tags, ['A', 'X']) THEN 'accepted' ELSE 'other' END AS kind, count(*) AS n FROM t GROUP BY 1"

#: Set phrase, denial, statement, its author and what marks research, of the disclosure queries.
PHRASES = ("(?i)licensed under", "(?i)not (be )?licensed", "(?i)licen[cs]e", "(?i)(this|our) (work|file|software)", "(?i)public domain")
OPENING = "^(This|Licensed|Released)"


def disclosure_lines(spark, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    found = lines.select("lang", measures.disclosure(F.col("line"), *PHRASES).alias("a"), measures.strict_disclosure(F.col("line"), PHRASES[0], PHRASES[1], OPENING).alias("b"))
    return found.groupBy("lang").agg(F.count("*").alias("lines"), F.count_if("a").alias("statements"), F.count_if("b").alias("strict"))


DISCLOSURE = """
WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT lang, regexp_matches(line, '{0}') OR regexp_matches(line, '{1}') AS a, regexp_matches(line, '{2}') AND regexp_matches(line, '{3}') AND NOT regexp_matches(line, '{4}') AS b, regexp_matches(line, '{5}') AS o FROM l)
SELECT lang, count(*) AS lines, count(*) FILTER (a OR b) AS statements, count(*) FILTER (a AND o) AS strict FROM f GROUP BY lang
""".format(*PHRASES, OPENING)

#: Ordered rewrites of part types to canonical names.
TYPE_RULES = (("[^A-Za-z0-9]+", "_"), ("_(ANODIZED|BURNISHED)", "_treated"), ("^(ECONOMY|STANDARD)_", "basic_"), ("_(TIN|NICKEL)$", "_light"))


def canonical_types(spark, sf_dir: str) -> DataFrame:
    """Part types by ordered rewrites, then by a map with a brand's own entries; void names go."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("scope"), F.lower(rewrite(F.col("p_type"), TYPE_RULES)).alias("name"))
    names = p.select("name").distinct()
    canon = names.where("name like 'basic%'").select("name", F.regexp_replace("name", "_(steel|copper)$", "_heavy").alias("canonical"))
    own = p.select("scope", "name").distinct().where("scope like '%3' and name like 'promo%'").select("scope", "name", F.lit("basic_plated_steel").alias("canonical"))
    void = p.select("scope", "name").distinct().where("scope like '%1' and name like '%brass'")
    return measures.mapped_names(p, "name", "scope", canon, own, void).groupBy("name").agg(F.count("*").alias("n"))


CANONICAL = """
WITH p AS (SELECT p_brand AS scope, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g'), '_(ANODIZED|BURNISHED)', '_treated', 'g'), '^(ECONOMY|STANDARD)_', 'basic_', 'g'), '_(TIN|NICKEL)$', '_light', 'g')) AS name FROM part),
m AS (SELECT CASE WHEN scope LIKE '%3' AND name LIKE 'promo%' THEN 'basic_plated_steel' ELSE name END AS name FROM p WHERE NOT (scope LIKE '%1' AND name LIKE '%brass')),
k AS (SELECT DISTINCT name FROM p)
SELECT CASE WHEN name LIKE 'basic%' AND name IN (SELECT name FROM k) THEN regexp_replace(name, '_(steel|copper)$', '_heavy') ELSE name END AS name, count(*) AS n FROM m GROUP BY 1
"""

#: Tier words of the name ladder.
TIERS = ("steel", "copper", "brass", "tin", "nickel")


def name_ladder(spark, sf_dir: str) -> DataFrame:
    """Similarity of all pairs of part lines: <line>_<size class>_<material>, size class 0 left out; pairs are formed
    inside a line, as other lines are never alike."""
    p = table(spark, sf_dir, "part").select(F.lower(F.substring_index("p_type", " ", 1)).alias("line"), F.lower(F.substring_index("p_type", " ", -1)).alias("tier"), (F.col("p_size") % 3).alias("s"))
    names = p.select("line", F.concat_ws("_", "line", F.when(F.col("s") > 0, F.col("s").cast("string")), "tier").alias("name")).distinct()
    tiers = frozenset(TIERS)

    @F.pandas_udf("double")
    def alike(a, b):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([name_similarity(x, y, tiers) for x, y in zip(a, b)], dtype=float)

    a, b = names.alias("a"), names.alias("b")
    pairs = a.join(b, (F.col("a.line") == F.col("b.line")) & (F.col("a.name") < F.col("b.name"))).select(F.col("a.name").alias("a"), F.col("b.name").alias("b"))
    return pairs.withColumn("sim", alike("a", "b")).where("sim > 0").select("a", "b", "sim")


LADDER = f"""
WITH n AS (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS line, p_size % 3 AS s, lower(split_part(p_type, ' ', -1)) AS tier FROM part),
k AS (SELECT *, line || CASE WHEN s > 0 THEN '_' || s ELSE '' END || '_' || tier AS name, line || CASE WHEN s > 0 THEN '_' || s ELSE '' END || CASE WHEN tier IN {TIERS} THEN '' ELSE '_' || tier END AS version, line || CASE WHEN tier IN {TIERS} THEN '' ELSE '_' || tier END AS family FROM n)
SELECT a.name AS a, b.name AS b, CASE WHEN a.version = b.version THEN 0.95::DOUBLE WHEN a.family IN (a.name, b.name) THEN 0.66::DOUBLE ELSE 0.8::DOUBLE END AS sim FROM k a JOIN k b ON a.line = b.line AND a.name < b.name WHERE a.family = b.family
"""


def unlisted_names(spark, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(tokens("text", "[a-z0-9_-]+"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    kind = measures.unlisted_name(F.col("token"), "(tion|heit|ment)", "[-_](based|like|only)$", "^(nation|station)", "^[0-9_]|^the", "(tion|heit|ment)[0-9]{1,2}$")
    return words.withColumn("kind", kind).where("kind is not null").groupBy("kind").agg(F.count("*").alias("names"), F.sum("n").alias("uses"))


UNLISTED = """
WITH w AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_-]+'))) AS token FROM documents) GROUP BY 1),
k AS (SELECT n, regexp_replace(token, '[-_](based|like|only)$', '') AS b FROM w)
SELECT CASE WHEN regexp_matches(b, '^(nation|station)') THEN 'tool' WHEN regexp_matches(b, '^[0-9_]|^the') THEN 'excluded' WHEN regexp_matches(b, '(tion|heit|ment)[0-9]{1,2}$') THEN 'glued' ELSE 'name' END AS kind, count(*) AS names, CAST(sum(n) AS BIGINT) AS uses
FROM k WHERE regexp_matches(b, '(tion|heit|ment)') GROUP BY 1
"""


def shipping_delays(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderpriority", F.datediff("l_shipdate", "o_orderdate").cast("double").alias("days"))
    out = aggregate.quantiles(d, "days", ["o_orderpriority"])
    return out.select("o_orderpriority", *[r6(c).alias(c) for c in ("p10", "p50", "p90", "max")], "n")


DELAYS = "WITH d AS (SELECT o_orderpriority, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT o_orderpriority, round(quantile_cont(days, 0.1), 6) AS p10, round(quantile_cont(days, 0.5), 6) AS p50, round(quantile_cont(days, 0.9), 6) AS p90, max(days) AS max, count(days) AS n FROM d GROUP BY 1"


def dense_part_ids(spark, sf_dir: str) -> DataFrame:
    """Facets numbered from 0 in key order."""
    p = table(spark, sf_dir, "part")
    brands, types = dense_ids(p.select("p_brand").distinct(), ["p_brand"], "brand"), dense_ids(p.select("p_type").distinct(), ["p_type"], "type")
    return p.select("p_partkey", "p_brand", "p_type").join(F.broadcast(brands), "p_brand").join(F.broadcast(types), "p_type").select("p_partkey", "brand", "type")


DENSE = "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS brand, dense_rank() OVER (ORDER BY p_type) - 1 AS type FROM part"


def first_articles(spark, sf_dir: str) -> DataFrame:
    """The first hundred documents by source and id (the limit is the feature)."""
    return measures.first_n(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"], 100)


FIRST = "SELECT source, doc_id FROM documents ORDER BY source NULLS FIRST, doc_id NULLS FIRST LIMIT 100"


def lineage_tops(spark, sf_dir: str) -> DataFrame:
    """Suppliers in a tree of thirds: the way up and its top; those that 7 divides have no parent."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when((F.col("s_suppkey") > 2) & (F.col("s_suppkey") % 7 > 0), F.floor(F.col("s_suppkey") / 3).cast("long")).alias("parent"))
    return measures.lineage(s, "id", "parent").select("id", F.size("ancestors").alias("depth"), "top")


LINEAGE = """
WITH RECURSIVE p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey > 2 AND s_suppkey % 7 > 0 THEN s_suppkey // 3 END AS parent FROM supplier),
up AS (SELECT id, id AS now, 0 AS steps FROM p UNION ALL SELECT up.id, p.parent, up.steps + 1 FROM up JOIN p ON up.now = p.id WHERE p.parent IS NOT NULL)
SELECT id, CAST(max(steps) AS INTEGER) AS depth, arg_max(now, steps) AS top FROM up GROUP BY id
"""


def part_hops(spark, sf_dir: str) -> DataFrame:
    """Hops from part 1 on a graph that links every part to those of a half and a third of its key."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"))
    e = p.select("a", F.floor(F.col("a") / 2).cast("long").alias("b")).unionByName(p.where("a % 3 = 0").select("a", F.floor(F.col("a") / 3).cast("long").alias("b"))).where("b >= 1")
    return measures.hops(e, spark.createDataFrame([(1,)], "node long"))


HOPS = """
WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey >= 2 UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey % 3 = 0),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS hops UNION SELECT d.b, r.hops + 1 FROM r JOIN d ON d.a = r.node WHERE r.hops < 24)
SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY node
"""


def trade_partition(spark, sf_dir: str) -> DataFrame:
    """Regions as a partition of the nations' trade: weight inside, cut and conductance."""
    c, s, o, li = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders", "lineitem"))
    t = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    e = t.where("c_nationkey <> s_nationkey").groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.count("*").cast("double").alias("w"))
    m = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    return measures.partition_scores(e, m).select("community", "inside", "cut", "volume", r6("conductance").alias("conductance"))


PARTITION = """
WITH e AS (SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
j AS (SELECT w, x.n_regionkey AS ca, y.n_regionkey AS cb FROM e JOIN nation x ON a = x.n_nationkey JOIN nation y ON b = y.n_nationkey),
s AS (SELECT ca AS community, w, ca = cb AS same FROM j UNION ALL SELECT cb, w, ca = cb FROM j),
g AS (SELECT community, CAST(coalesce(sum(w) FILTER (same), 0) AS DOUBLE) / 2 AS inside, CAST(coalesce(sum(w) FILTER (NOT same), 0) AS DOUBLE) AS cut, CAST(sum(w) AS DOUBLE) AS volume FROM s GROUP BY 1)
SELECT *, round(cut / nullif(least(volume, (SELECT sum(w) FROM s) - volume), 0), 6) AS conductance FROM g
"""


def weighted_loss(spark, sf_dir: str) -> DataFrame:
    """Squared error of discounts against their flag's mean, weighed by flag."""
    li = table(spark, sf_dir, "lineitem")
    mean = li.groupBy("l_returnflag").agg(F.avg("l_discount").alias("m"))
    loss = li.join(F.broadcast(mean), "l_returnflag").groupBy(F.col("l_returnflag").alias("relation")).agg(F.sum((F.col("l_discount") - F.col("m")) ** 2).alias("loss"))
    return measures.total_loss(loss, aggregate.relation_weights({"goods": ["A", "N"], "returns": ["R"]})).select(r6("total").alias("total"))


LOSS = "WITH m AS (SELECT l_returnflag, l_discount, avg(l_discount) OVER (PARTITION BY l_returnflag) AS m FROM lineitem), s AS (SELECT l_returnflag AS r, sum((l_discount - m) ** 2) AS loss FROM m GROUP BY 1) SELECT round(sum(CASE r WHEN 'R' THEN 0.5 ELSE 0.25 END * loss), 6) AS total FROM s"


def memberships(spark, sf_dir: str) -> DataFrame:
    """Parts and suppliers as two facets of three communities: quantities by return flag, as shares."""
    li = table(spark, sf_dir, "lineitem")
    k = F.ascii("l_returnflag").cast("int")
    rows = [li.groupBy(F.lit(f).alias("facet"), F.col(c).alias("entity"), k.alias("k")).agg(F.sum("l_quantity").alias("q")) for f, c in (("part", "l_partkey"), ("supplier", "l_suppkey"))]
    both = rows[0].unionByName(rows[1])
    whole = both.groupBy("facet", "entity").agg(F.sum("q").alias("all"))
    return materialise(both.join(whole, ["facet", "entity"]).select("facet", "entity", "k", (F.col("q") / F.col("all")).alias("u")))


def membership_weights(spark, sf_dir: str) -> DataFrame:
    cores = spark.createDataFrame([("ps", "part", "supplier", k, m, 1.0 if k == m else 0.1) for k in (65, 78, 82) for m in (65, 78, 82)], "relation string, rows string, cols string, k int, l int, z double")
    return measures.column_weights(memberships(spark, sf_dir), cores, 0.2).select("facet", "k", r6("w").alias("w"))


MEMBERSHIPS = """m AS (SELECT 'part' AS facet, l_partkey AS entity, ascii(l_returnflag) AS k, sum(l_quantity) AS q FROM lineitem GROUP BY ALL UNION ALL SELECT 'supplier', l_suppkey, ascii(l_returnflag), sum(l_quantity) FROM lineitem GROUP BY ALL),
u AS (SELECT facet, entity, k, q / sum(q) OVER (PARTITION BY facet, entity) AS u FROM m)"""
WEIGHTS_CTE = f"""{MEMBERSHIPS},
g AS (SELECT a.facet, a.k, b.k AS l, sum(a.u * b.u) AS g FROM u a JOIN u b ON a.facet = b.facet AND a.entity = b.entity GROUP BY 1, 2, 3),
z AS (SELECT x AS k, y AS l, CASE WHEN x = y THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS z FROM (SELECT unnest([65, 78, 82]) AS x), (SELECT unnest([65, 78, 82]) AS y)),
q AS (SELECT CASE g.facet WHEN 'part' THEN 'supplier' ELSE 'part' END AS facet, a.k, sqrt(sum(a.z * g.g * b.z)) AS w FROM z a JOIN z b ON a.k = b.k JOIN g ON g.k = a.l AND g.l = b.l GROUP BY 1, 2),
cw AS (SELECT facet, k, CASE WHEN w < 0.2 * max(w) OVER (PARTITION BY facet) THEN 0 ELSE w END AS w FROM q)"""
MEMBERSHIP_WEIGHTS = f"WITH {WEIGHTS_CTE} SELECT facet, CAST(k AS INTEGER) AS k, round(w, 6) AS w FROM cw"


def weighted_places(spark, sf_dir: str) -> DataFrame:
    """Entities whose weighted membership is one community's by half and below a tenth in all others."""
    m = memberships(spark, sf_dir)
    cores = spark.createDataFrame([("ps", "part", "supplier", k, x, 1.0 if k == x else 0.1) for k in (65, 78, 82) for x in (65, 78, 82)], "relation string, rows string, cols string, k int, l int, z double")
    p = measures.weighted_memberships(m, measures.column_weights(m, cores, 0.2))
    flags = measures.mono_flags(p.withColumn("e", F.concat_ws("/", "facet", "entity")), "e", "k", "p")
    return flags.groupBy("mono").agg(F.count("*").alias("n"))


PLACES = f"""
WITH {WEIGHTS_CTE}, p AS (SELECT facet, entity, u.k, u * w AS p FROM u JOIN cw USING (facet, k)),
s AS (SELECT facet, entity, k, p / sum(p) OVER (PARTITION BY facet, entity) AS p FROM p QUALIFY sum(p) OVER (PARTITION BY facet, entity) > 0),
f AS (SELECT facet, entity, CASE WHEN count(*) FILTER (p >= 0.5) = 1 AND count(*) FILTER (p < 0.1) = count(*) - 1 THEN max(k) FILTER (p >= 0.5) END AS mono FROM s GROUP BY 1, 2)
SELECT CAST(mono AS INTEGER) AS mono, count(*) AS n FROM f GROUP BY 1
"""


def weak_brands(spark, sf_dir: str) -> DataFrame:
    """(flag, brand) whose mean price lies below a twentieth of the flag's prices."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_returnflag", "p_brand", "l_discount")
    w = li.groupBy("l_returnflag", "p_brand").agg((F.avg("l_discount") / 4).alias("w"))
    return measures.empty_columns(w, li, "l_returnflag", "p_brand", "w", "l_discount", 0.12)


WEAK = "WITH li AS (SELECT l_returnflag, p_brand, l_discount FROM lineitem JOIN part ON l_partkey = p_partkey), w AS (SELECT l_returnflag, p_brand, avg(l_discount) / 4 AS w FROM li GROUP BY 1, 2), t AS (SELECT l_returnflag, quantile_cont(l_discount, 0.12) AS t FROM li GROUP BY 1) SELECT l_returnflag, p_brand FROM w JOIN t USING (l_returnflag) WHERE w < t"


def source_concentration(spark, sf_dir: str) -> DataFrame:
    out = measures.cumulative_shares(table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("-")).alias("source")), "source")
    return out.select("source", "n", "pairs", r6("share").alias("share"), r6("upto").alias("upto"))


CONCENTRATION = "WITH n AS (SELECT coalesce(source, '-') AS source, count(*) AS n FROM documents GROUP BY 1) SELECT source, n, n * (n - 1) AS pairs, round(n / (SELECT sum(n) FROM n), 6) AS share, round(sum(n) OVER (ORDER BY n DESC, source) / (SELECT sum(n) FROM n), 6) AS upto FROM n"


def benchmark_typed_forms(spark, sf_dir: str) -> DataFrame:
    """Words of benchmark items with their marks, and what merging equal bare words does to the items they join."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("form")).where("form <> '' and length(form) > 6")
    return measures.typed_forms(rows, "item_id", "form", F.regexp_replace("form", "[^a-z0-9]", ""))


TYPED = """
WITH r AS (SELECT DISTINCT item_id, form, regexp_replace(form, '[^a-z0-9]', '', 'g') AS bare FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS form FROM benchmark) WHERE form <> '' AND length(form) > 6)
SELECT (SELECT count(DISTINCT form) FROM r) AS forms, (SELECT count(DISTINCT bare) FROM r) AS bare,
  (SELECT count(*) FROM (SELECT DISTINCT a.item_id, b.item_id FROM r a JOIN r b ON a.form = b.form AND a.item_id < b.item_id)) AS pairs_before,
  (SELECT count(*) FROM (SELECT DISTINCT a.item_id, b.item_id FROM r a JOIN r b ON a.bare = b.bare AND a.item_id < b.item_id WHERE a.bare <> '')) AS pairs_after
"""


def price_equivalence(spark, sf_dir: str) -> DataFrame:
    """Two ways to price a supplier's items, seeds by line number: apart by more than seeds are?"""
    li = table(spark, sf_dir, "lineitem")
    per = li.groupBy("l_suppkey", F.col("l_linenumber").alias("seed")).agg(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("a"), F.avg(F.col("l_extendedprice") * 0.95).alias("b"))
    per = materialise(per)
    out = measures.equivalence(per.select("l_suppkey", "seed", F.col("a").alias("v")), per.select("l_suppkey", "seed", F.col("b").alias("v")), "l_suppkey", "seed", "v")
    return out.select("l_suppkey", *[r6(c).alias(c) for c in ("difference", "noise", "ratio")], "alike")


EQUIVALENCE = """
WITH p AS (SELECT l_suppkey, l_linenumber AS seed, avg(l_extendedprice * (1 - l_discount)) AS a, avg(l_extendedprice * 0.95::DOUBLE) AS b FROM lineitem GROUP BY 1, 2),
n AS (SELECT x.l_suppkey, median(abs(x.a - y.a)) AS noise FROM p x JOIN p y ON x.l_suppkey = y.l_suppkey AND x.seed < y.seed GROUP BY 1),
d AS (SELECT l_suppkey, abs(median(a) - median(b)) AS difference FROM p GROUP BY 1)
SELECT l_suppkey, round(difference, 6) AS difference, round(noise, 6) AS noise, round(difference / nullif(noise, 0), 6) AS ratio, coalesce(difference / nullif(noise, 0) <= 1, difference = 0) AS alike FROM d JOIN n USING (l_suppkey)
"""


def chosen_size(spark, sf_dir: str) -> DataFrame:
    """Part sizes as model sizes, parts as their fits: the size all of whose parts pass, of the largest mean price."""
    p = table(spark, sf_dir, "part").select("p_size", "p_retailprice", (F.col("p_retailprice") % 100).alias("d"))
    out = measures.select_models(p, "p_size", F.col("p_retailprice") > 0, [F.col("p_size") > 2], "p_retailprice", "d")
    return out.select("p_size", r6("volume").alias("volume"), "fits", r6("nearest").alias("nearest"))


CHOSEN = "SELECT p_size, round(avg(p_retailprice), 6) AS volume, count(*) AS fits, round(min(p_retailprice % 100), 6) AS nearest FROM part GROUP BY p_size HAVING bool_and(p_retailprice > 0 AND p_size > 2) ORDER BY avg(p_retailprice) DESC, p_size LIMIT 1"


def broken_links(spark, sf_dir: str) -> DataFrame:
    """Links of pages by the words that no document's opening has."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(tokens("text")).alias("w"))
    return measures.broken_references(table(spark, sf_dir, "pages"), "page_id", "html", 'href="/([a-z0-9]+)"', words, "w")


BROKEN = """
WITH r AS (SELECT page_id, ref, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([a-z0-9]+)"', 1)) AS ref FROM pages) GROUP BY 1, 2),
w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark)
SELECT page_id, ref, n FROM r WHERE ref NOT IN (SELECT w FROM w)
"""
#: Marks an audit counts.
AUDIT = {"links": "https?://[a-z]", "tables": " \\| ", "marks": "[$%&#*]{3}"}


def text_audit(spark, sf_dir: str) -> DataFrame:
    return measures.audit(table(spark, sf_dir, "documents").where("lang is not null"), ["lang"], "text", AUDIT)


AUDITED = "SELECT lang, count(*) AS n, " + ", ".join(f"count(*) FILTER (regexp_matches(text, '{p}')) AS {n}_rows, CAST(sum(coalesce(len(regexp_extract_all(text, '{p}')), 0)) AS BIGINT) AS {n}_hits" for n, p in AUDIT.items()) + " FROM documents WHERE lang IS NOT NULL GROUP BY lang"


def order_shards(spark, sf_dir: str) -> DataFrame:
    return measures.shard_report(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 16, F.col("o_custkey") % 1009)


SHARDS = "SELECT CAST(place % 16 AS INTEGER) AS shard, count(*) AS n, CAST(sum(o_custkey % 1009) AS BIGINT) AS digest FROM (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders) GROUP BY 1"


def spearman_three_covariates(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("day", F.datediff("l_shipdate", F.lit("1990-01-01")))
    out = measures.partial_spearman_of(li, ["l_returnflag"], "l_extendedprice", "l_quantity", ["l_discount", "l_tax", "day"])
    return out.select("l_returnflag", F.round("rho", 5).alias("rho"))


def _partial(i: int, j: int, n: int, given: int) -> str:
    i, j = min(i, j), max(i, j)
    if not given:
        return f"r{i}_{j}"
    z = n - given
    a, b, c = (_partial(x, y, n, given - 1) for x, y in ((i, j), (i, z), (j, z)))
    return f"(({a}) - ({b}) * ({c})) / sqrt((1 - ({b}) * ({b})) * (1 - ({c}) * ({c})))"


_RANKED = ("l_extendedprice", "l_quantity", "l_discount", "l_tax", "date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE))")
SPEARMAN_THREE = (
    "WITH k AS (SELECT l_returnflag, " + ", ".join(f"rank() OVER (PARTITION BY l_returnflag ORDER BY {c}) + (count(*) OVER (PARTITION BY l_returnflag, {c}) - 1) / 2.0::DOUBLE AS k{i}" for i, c in enumerate(_RANKED)) + " FROM lineitem), "
    "r AS (SELECT l_returnflag, " + ", ".join(f"corr(k{i}, k{j}) AS r{i}_{j}" for i in range(5) for j in range(i + 1, 5)) + " FROM k GROUP BY 1) "
    f"SELECT l_returnflag, round({_partial(0, 1, 5, 3)}, 5) AS rho FROM r"
)


def membership_null(spark, sf_dir: str) -> DataFrame:
    """Agreement of brands with their sizes' shuffled brands inside strata of size class and degree band: mean and 95th
    percentile over eight deals."""
    deg = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.floor(F.log2(F.count("*") + 1)).cast("int").alias("band"))
    p = table(spark, sf_dir, "part").join(deg, F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "band", (F.col("p_size") % 2).alias("half"), F.substring("p_brand", 7, 1).alias("b"))
    out = measures.stratified_null(p, "p_partkey", "b", ["half", "band"], F.avg((F.col("b") == F.col("shuffled")).cast("double")), 8, "n1", ["half"])
    return out.select("half", r6("mean").alias("mean"), r6("p95").alias("p95"))


NULLS = """
WITH d AS (SELECT l_partkey, CAST(floor(log2(count(*) + 1)) AS INTEGER) AS band FROM lineitem GROUP BY 1),
p AS (SELECT p_partkey, band, p_size % 2 AS half, substr(p_brand, 7, 1) AS b, rep FROM part JOIN d ON l_partkey = p_partkey, (SELECT unnest(range(1, 9)) AS rep)),
x AS (SELECT *, row_number() OVER (PARTITION BY rep, half, band ORDER BY p_partkey) AS i, row_number() OVER (PARTITION BY rep, half, band ORDER BY md5(p_partkey || '|n1|' || rep), p_partkey) AS s FROM p),
a AS (SELECT x.rep, x.half, avg(CAST(x.b = y.b AS DOUBLE)) AS v FROM x JOIN x y ON x.rep = y.rep AND x.half = y.half AND x.band = y.band AND x.i = y.s GROUP BY 1, 2)
SELECT half, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.95), 6) AS p95 FROM a GROUP BY half
"""


def majority_labels(spark, sf_dir: str) -> DataFrame:
    """Items of each order with the order's most frequent flag, none where two are; and flags void if twice on a part."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    kept = aggregate.keep_majority(li, "l_orderkey", "l_returnflag").select("l_orderkey", "l_linenumber", "l_returnflag")
    return kept.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))


MAJORITY = "WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY l_orderkey) AS m FROM c), t AS (SELECT *, count(*) FILTER (n = m) OVER (PARTITION BY l_orderkey) AS k FROM m) SELECT l_orderkey, l_returnflag, n FROM t WHERE n = m AND k = 1"


def void_repeats(spark, sf_dir: str) -> DataFrame:
    """Flags of a part's items, void where a flag stands twice on the part."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag")
    out = aggregate.drop_repeated(li, ["l_partkey"], "l_returnflag")
    return out.groupBy("l_partkey").agg(F.count("*").alias("n"), F.count("l_returnflag").alias("kept"))


VOID = "WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_partkey, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (n = 1), 0) AS BIGINT) AS kept FROM c GROUP BY 1"


def relation_norm(spark, sf_dir: str) -> DataFrame:
    """Frobenius norm of the parts-suppliers relation without hidden cells."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_quantity").alias("v"))
    norm = aggregate.frobenius(t, t.where("(row + col) % 5 = 0"), True)
    return spark.createDataFrame([(round(norm, 6),)], "norm double")


NORM = "SELECT round(sqrt(sum(v * v)), 6) AS norm FROM (SELECT l_partkey AS r, l_suppkey AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) WHERE (r + c) % 5 <> 0 AND r <> c"


def parsed_dates(spark, sf_dir: str) -> DataFrame:
    """Dates written as text in two columns, the first that parses."""
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "yyyy MMM d")).otherwise("no date").alias("a"), F.when(F.col("o_orderkey") % 2 > 0, F.lit("2001 Feb 3")).alias("b"))
    return o.groupBy(day_of(F.col("a"), F.col("b")).cast("string").alias("day")).agg(F.count("*").alias("n"))


DATES = "SELECT CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 2 > 0 THEN '2001-02-03' END AS day, count(*) AS n FROM orders GROUP BY 1"


def masked_tokens(spark, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "[ \n]")).alias("w"))
    return w.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(masked(F.col("w"))).alias("masked"))


MASKED = "WITH w AS (SELECT lang, unnest(regexp_split_to_array(text, '[ \\n]')) AS w FROM documents) SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(w, '^(ref\\d{6}|url\\d{8})$') OR regexp_matches(w, '^[\\d.,%]+$')) AS masked FROM w GROUP BY lang"


def valid_orders(spark, sf_dir: str) -> DataFrame:
    """Orders none of whose items is returned; those without items are marked unknown."""
    kinds = table(spark, sf_dir, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("kinds"))
    out = curation.valid_records(table(spark, sf_dir, "orders").join(kinds, "o_orderkey", "left"), "kinds", "R")
    return out.groupBy("unknown").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


VALID = "WITH k AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS r FROM lineitem WHERE l_quantity > 25 GROUP BY 1) SELECT r IS NULL AS unknown, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders LEFT JOIN k ON l_orderkey = o_orderkey WHERE r IS NULL OR NOT r GROUP BY 1"


def labelled_lines(spark, sf_dir: str) -> DataFrame:
    """Turns that open with a label of listed words before a colon."""
    t = table(spark, sf_dir, "conversations").select("role", F.concat(F.when(F.col("turn") % 3 == 0, "Short answer: ").when(F.col("turn") % 3 == 1, "Some other thing: ").otherwise(""), F.coalesce("text", F.lit(""))).alias("t"))
    return t.groupBy("role").agg(F.count("*").alias("n"), F.count_if(curation.label_prefix(F.col("t"), ["short", "answer", "the"])).alias("labelled"))


LABELLED = """
WITH t AS (SELECT role, CASE turn % 3 WHEN 0 THEN 'Short answer: ' WHEN 1 THEN 'Some other thing: ' ELSE '' END || coalesce(text, '') AS t FROM conversations),
h AS (SELECT role, regexp_extract_all(lower(regexp_extract(t, '^([^:]{1,120}):', 1)), '[a-z0-9]+') AS h FROM t)
SELECT role, count(*) AS n, count(*) FILTER (len(h) BETWEEN 1 AND 8 AND len(list_filter(h, lambda x: x NOT IN ('short', 'answer', 'the'))) = 0) AS labelled FROM h GROUP BY role
"""


def near_dup_components(spark, sf_dir: str) -> DataFrame:
    """Components of the flagship's similarity graph."""
    ties = materialise(near_dup_knn_ties(spark, sf_dir).select(F.col("i").alias("src"), F.col("j").alias("dst")))
    return connected_components(ties).groupBy("component").agg(F.count("*").alias("n"), F.max("node").alias("last"))


SIMILAR_COMPONENTS = f"""
WITH RECURSIVE ties AS ({NEAR_DUP}), edges AS (SELECT i AS a, j AS b FROM ties UNION SELECT j, i FROM ties),
reach(a, b) USING KEY (a) AS (
  SELECT a, a AS b FROM (SELECT DISTINCT a FROM edges)
  UNION
  SELECT e.a, min(r.b) AS b FROM edges e JOIN reach r ON e.b = r.a JOIN recurring.reach o ON o.a = e.a WHERE r.b < o.b GROUP BY e.a)
SELECT b AS component, count(*) AS n, max(a) AS last FROM reach GROUP BY b
"""


def basket_sets(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as sets of words (keys of their parts) and names (types of their parts), and the names related by line."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("w"), "p_partkey").alias("w"), F.lower(F.regexp_replace("p_type", " ", "_")).alias("name"))
    li = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    sets = li.select(F.col("l_orderkey").alias("i"), F.explode(F.array("w", "name")).alias("token")).distinct()
    names = p.select("name", F.regexp_replace("name", "_[^_]*$", "").alias("block")).distinct()
    return sets, related.related_names(names, lambda a, b: name_similarity(a, b, frozenset(TIERS)))


def related_baskets(spark, sf_dir: str) -> DataFrame:
    """Orders whose parts are alike, types of one line counting in part."""
    sets, ties = basket_sets(spark, sf_dir)
    return related.similar_related(sets, ties, 0.6).select("i", "j", r6("sim").alias("sim"))


def aligned_parts(spark, sf_dir: str) -> DataFrame:
    """The part keys of an order against the same list without its every third item: where each finds its partner."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").groupBy("l_orderkey").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))).alias("a"))
    lists = own.withColumn("b", F.filter("a", lambda x, i: i % 3 != 2))
    return related.aligned_labels(lists, "l_orderkey", "a", "b", lambda x, y: x == y).withColumn("partner", F.coalesce("partner", F.lit(-1)))


ALIGNED = """
WITH o AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS l FROM lineitem GROUP BY 1, 2),
r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l, l_partkey) - 1 AS place FROM o)
SELECT l_orderkey, CAST(place AS INTEGER) AS place, CAST(CASE WHEN place % 3 <> 2 THEN place - place // 3 ELSE -1 END AS INTEGER) AS partner FROM r
"""


def record_bylines(spark, sf_dir: str) -> DataFrame:
    """Orders as records in XML, of contributors or author lists by turns, read back as authors."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("orcid", F.format_string("0000-0000-0000-%04d", (F.col("c_custkey") % 10000).cast("int")))
    jats = F.concat(F.lit('<article><front><contrib-group><contrib contrib-type="author"><contrib-id contrib-id-type="orcid">https://orcid.org/'), "orcid", F.lit("</contrib-id><name><surname>"), "c_name", F.lit('</surname><given-names>A &amp; B</given-names></name><xref ref-type="aff" rid="a1"/></contrib><contrib contrib-type="editor"><name><surname>E</surname></name></contrib></contrib-group><aff id="a1">'), "n_name", F.lit("</aff></front></article>"))
    listed = F.concat(F.lit("<PubmedArticle><AuthorList><Author><LastName>"), "c_name", F.lit('</LastName><ForeName>C</ForeName><Identifier Source="ORCID">'), "orcid", F.lit("</Identifier><AffiliationInfo><Affiliation>"), "n_name", F.lit("</Affiliation></AffiliationInfo></Author><Author><CollectiveName>G</CollectiveName></Author></AuthorList></PubmedArticle>"))
    xml = F.when(F.col("o_orderkey") % 5 == 0, F.lit("<broken")).when(F.col("o_orderkey") % 2 == 0, jats).otherwise(listed)
    return o.select("o_orderkey", F.explode(parsed_byline(xml)).alias("b")).select("o_orderkey", "b.pos", "b.last", "b.fore", "b.orcid", F.array_join("b.affiliations", ";").alias("places"))


BYLINES = """
WITH o AS (SELECT o_orderkey, c_name, n_name, format('0000-0000-0000-{:04d}', c_custkey % 10000) AS orcid FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 5 <> 0)
SELECT o_orderkey, 1 AS pos, c_name AS last, CASE WHEN o_orderkey % 2 = 0 THEN 'A & B' ELSE 'C' END AS fore, orcid, n_name AS places FROM o
UNION ALL SELECT o_orderkey, 2, NULL, NULL, NULL, '' FROM o WHERE o_orderkey % 2 <> 0
"""


def stored_relation(spark, sf_dir: str) -> DataFrame:
    """Two relations written to a matrix store and one of them read back."""
    li = table(spark, sf_dir, "lineitem")
    rows = [li.groupBy(F.lit(n).alias("relation"), F.col("l_partkey").alias("row"), F.col(c).cast("long").alias("col")).agg(F.sum("l_quantity").alias("value")) for n, c in (("part_supplier", "l_suppkey"), ("part_line", "l_linenumber"))]
    path = reserve(spark)
    save_matrix(rows[0].unionByName(rows[1]), path)
    return load_matrix(spark, path, "part_supplier").groupBy("col").agg(F.count("*").alias("ties"), F.sum("value").alias("value"))


STORED = "SELECT c AS col, count(*) AS ties, sum(v) AS value FROM (SELECT l_partkey AS r, l_suppkey AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1"


def baseline_coverage(spark, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_quantity").alias("v"))
    return measures.baseline_measures(t).select("row", r6("coverage").alias("coverage"), r6("accuracy").alias("accuracy"))


BASELINE = """
WITH t AS (SELECT l_partkey AS r, l_suppkey AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
x AS (SELECT r, v, sum(v) OVER (PARTITION BY r) * sum(v) OVER (PARTITION BY c) / sum(v) OVER () AS x FROM t)
SELECT r AS row, round(sum(least(v, x)) / sum(v), 6) AS coverage, round(sum(least(v, x)) / sum(x), 6) AS accuracy FROM x GROUP BY r
"""


def flag_penalties(spark, sf_dir: str) -> DataFrame:
    """Suppliers' and parts' flags as communities of two domains: collapse, effective number and imbalance."""
    m = memberships(spark, sf_dir)
    places = m.where("facet = 'part'").select("entity", "k", F.col("u").alias("p"))
    whole = m.groupBy("facet").agg(F.sum("u").alias("all"))
    presence = m.groupBy("facet", "k").agg(F.sum("u").alias("s")).join(whole, "facet").select(F.col("facet").alias("domain"), "k", (F.col("s") / F.col("all")).alias("p"))
    out = measures.community_penalties(places, presence)
    return out.select(*[r6(c).alias(c) for c in out.columns])


PENALTIES = f"""
WITH {MEMBERSHIPS}, f AS (SELECT entity, arg_max(k, (u, -k)) AS k FROM u WHERE facet = 'part' GROUP BY 1), n AS (SELECT k, count(*) / sum(count(*)) OVER () AS s FROM f GROUP BY k),
d AS (SELECT facet, k, sum(u) / sum(sum(u)) OVER (PARTITION BY facet) AS p FROM u GROUP BY facet, k),
g AS (SELECT abs(coalesce(sum(p) FILTER (facet = 'part'), 0) - coalesce(sum(p) FILTER (facet = 'supplier'), 0)) AS d FROM d GROUP BY k)
SELECT round((SELECT max(s) FROM n), 6) AS collapse, round((SELECT exp(-sum(s * ln(s))) FROM n), 6) AS effective, round((SELECT sum(d) / 2 FROM g), 6) AS imbalance
"""


def introduced_symbols(spark, sf_dir: str) -> DataFrame:
    """Turns with a definition put before them: the symbols they introduce."""
    t = table(spark, sf_dir, "conversations").select("role", F.concat(F.lit("Where "), F.substring(F.lit("abcdefg"), (F.col("turn") % 7 + 1).cast("int"), F.lit(1)), F.when(F.col("turn") % 2 == 0, " is the rate and q denotes time. ").otherwise(" was. "), F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("role", F.explode(measures.symbols(F.col("t"))).alias("symbol")).groupBy("role", "symbol").agg(F.count("*").alias("n"))


SYMBOLS = r"""
WITH t AS (SELECT role, 'Where ' || substr('abcdefg', CAST(turn % 7 + 1 AS INTEGER), 1) || CASE WHEN turn % 2 = 0 THEN ' is the rate and q denotes time. ' ELSE ' was. ' END || coalesce(text, '') AS t FROM conversations),
s AS (SELECT role, unnest(list_distinct(regexp_extract_all(t, '(?i)\b(?:where|let|here|and)\s+([a-zA-Z][a-zA-Z0-9_]{0,2})\s+(?:is|be|are|denotes?|represents?)\b', 1))) AS symbol FROM t)
SELECT role, symbol, count(*) AS n FROM s GROUP BY 1, 2
"""


def yearly_spearman(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    return spearman(o.join(li, "o_orderkey"), ["year"], "o_totalprice", "q").select("year", F.round("rho", 5).alias("rho"))


YEARLY_RHO = """
WITH q AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1), j AS (SELECT year(o_orderdate) AS y, o_totalprice AS p, q FROM orders JOIN q USING (o_orderkey)),
r AS (SELECT y, rank() OVER (PARTITION BY y ORDER BY p) + (count(*) OVER (PARTITION BY y, p) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY y ORDER BY q) + (count(*) OVER (PARTITION BY y, q) - 1) / 2.0::DOUBLE AS b FROM j)
SELECT CAST(y AS INTEGER) AS year, round(corr(a, b), 5) AS rho FROM r GROUP BY y
"""


def folded_words(spark, sf_dir: str) -> DataFrame:
    """Distinct words with letters beyond ASCII that folding makes plain."""
    w = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.lower("text"), "[ \n]")).alias("w")).distinct()
    return w.withColumn("f", text_udf(fold)(F.col("w"))).groupBy("lang").agg(F.count("*").alias("words"), F.countDistinct("f").alias("folded"), F.count_if(F.col("f") != F.col("w")).alias("changed"))


FOLDED = "WITH w AS (SELECT DISTINCT lang, unnest(regexp_split_to_array(lower(text), '[ \n]')) AS w FROM documents), f AS (SELECT lang, w, replace(replace(replace(strip_accents(w), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe') AS f FROM w) SELECT lang, count(*) AS words, count(DISTINCT f) AS folded, count(*) FILTER (f <> w) AS changed FROM f GROUP BY lang"


def name_keys(spark, sf_dir: str) -> DataFrame:
    """Keys of invented names: the first given name of two letters or more counts, initials do not."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    names = s.select(F.concat_ws("|", F.initcap("n_name"), F.when(F.col("s_suppkey") % 3 == 0, "J. Marie").when(F.col("s_suppkey") % 3 == 1, "A B").otherwise("Zoé-Ann")).alias("n"))
    key = text_udf(lambda x: name_key(*x.split("|")))
    return names.groupBy(key(F.col("n")).alias("key")).agg(F.count("*").alias("n"))


NAME_KEYS = "SELECT CASE s_suppkey % 3 WHEN 1 THEN NULL ELSE regexp_replace(lower(n_name), '[^a-z]', '', 'g') || '|' || CASE s_suppkey % 3 WHEN 0 THEN 'marie' ELSE 'zoe' END END AS key, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"


def token_places(spark, sf_dir: str) -> DataFrame:
    """Where the first two words of a turn stand in it."""

    @F.pandas_udf("array<int>")
    def spans(text):  # noqa: ANN001, ANN202
        return text.map(lambda t: [x for s in token_spans(t, t.split()[:2]) for x in (s or ())] if isinstance(t, str) else None)

    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", spans("text").alias("s"))
    return t.where("size(s) = 4").select("conv_id", "turn", F.col("s")[0].alias("a"), F.col("s")[1].alias("b"), F.col("s")[2].alias("c"), F.col("s")[3].alias("d"))


PLACES_OF = r"""
WITH t AS (SELECT conv_id, turn, text, regexp_extract_all(text, '\S+') AS w FROM conversations WHERE text IS NOT NULL),
p AS (SELECT *, strpos(text, w[1]) - 1 AS a FROM t WHERE len(w) >= 2), q AS (SELECT *, a + length(w[1]) AS b FROM p)
SELECT conv_id, turn, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(b + strpos(substr(text, CAST(b + 1 AS INTEGER)), w[2]) - 1 AS INTEGER) AS c, CAST(b + strpos(substr(text, CAST(b + 1 AS INTEGER)), w[2]) - 1 + length(w[2]) AS INTEGER) AS d FROM q
"""


def hub_types(spark, sf_dir: str) -> DataFrame:
    """Part types written as hub tokens that hold a listed family and a signal."""
    token = F.regexp_replace("p_type", " ", "/")
    return table(spark, sf_dir, "part").groupBy(curation.hub_spelling(token, ["promo", "small"], ["plated", "tin"]).alias("hub")).agg(F.count("*").alias("n"))


HUBS = "SELECT list_has_any(string_split(lower(p_type), ' '), ['promo', 'small']) AND list_has_any(string_split(lower(p_type), ' '), ['plated', 'tin']) AS hub, count(*) AS n FROM part GROUP BY 1"


def price_clusters(spark, sf_dir: str) -> DataFrame:
    """A brand's parts in key order join the first cluster whose first member's price is within a tenth."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    out = curation.greedy_clusters(p, "p_brand", "p_partkey", ["p_size"], lambda a, b: abs(a[0] - b[0]) <= 10, "p_brand string, p_partkey long")
    return out.select("p_brand", "p_partkey", "cluster")


CLUSTERS = """
WITH RECURSIVE p AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part),
g AS (
  SELECT p_brand, p_partkey, r, 0 AS cluster, [p_size] AS firsts FROM p WHERE r = 1
  UNION ALL
  SELECT p.p_brand, p.p_partkey, p.r, CAST(coalesce(list_position(list_transform(g.firsts, lambda x: abs(x - p.p_size) <= 10), true), len(g.firsts) + 1) - 1 AS INTEGER),
    CASE WHEN list_position(list_transform(g.firsts, lambda x: abs(x - p.p_size) <= 10), true) IS NULL THEN list_append(g.firsts, p.p_size) ELSE g.firsts END FROM g JOIN p ON p.p_brand = g.p_brand AND p.r = g.r + 1)
SELECT p_brand, p_partkey, cluster FROM g
"""

_PAIRS = (
    (near_dup_side_ties, SIDE_TIES), (persistence_weighted, PERSISTENCE_WEIGHTED), (yearly_shares, YEARLY), (eligible_orders, ELIGIBLE), (order_tag_classes, TAG_CLASSES), (disclosure_lines, DISCLOSURE), (canonical_types, CANONICAL), (name_ladder, LADDER),
    (unlisted_names, UNLISTED), (shipping_delays, DELAYS), (dense_part_ids, DENSE), (first_articles, FIRST), (lineage_tops, LINEAGE), (part_hops, HOPS), (trade_partition, PARTITION), (weighted_loss, LOSS), (membership_weights, MEMBERSHIP_WEIGHTS), (weighted_places, PLACES),
    (weak_brands, WEAK), (source_concentration, CONCENTRATION), (benchmark_typed_forms, TYPED), (price_equivalence, EQUIVALENCE), (chosen_size, CHOSEN), (broken_links, BROKEN), (text_audit, AUDITED), (order_shards, SHARDS), (spearman_three_covariates, SPEARMAN_THREE), (membership_null, NULLS),
    (majority_labels, MAJORITY), (void_repeats, VOID), (relation_norm, NORM), (parsed_dates, DATES), (masked_tokens, MASKED), (valid_orders, VALID), (labelled_lines, LABELLED),
    (near_dup_components, SIMILAR_COMPONENTS), (aligned_parts, ALIGNED), (record_bylines, BYLINES), (stored_relation, STORED), (baseline_coverage, BASELINE), (flag_penalties, PENALTIES), (introduced_symbols, SYMBOLS), (yearly_spearman, YEARLY_RHO), (folded_words, FOLDED),
    (name_keys, NAME_KEYS), (token_places, PLACES_OF), (hub_types, HUBS), (price_clusters, CLUSTERS), (related_baskets, None),
)
QUERIES = {f.__name__: f for f, _ in _PAIRS}
ORACLES = {f.__name__: sql for f, sql in _PAIRS if sql}
