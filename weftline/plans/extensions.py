"""Extensions: what the event and star-schema tables ask for beyond the reference (windows, as-of join, rollups)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.plans.common import r6, table
from weftline.streaming.windows import sessions, sliding, tumbling


def events_tumbling(spark, sf_dir: str) -> DataFrame:
    out = tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], {"n": F.count("*"), "value": r6(F.sum("value"))})
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "value")


TUMBLING = "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2"


def events_sliding(spark, sf_dir: str) -> DataFrame:
    out = sliding(table(spark, sf_dir, "events"), "ts", "2 days", "1 day", ["event_type"], {"n": F.count("*")})
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


SLIDING = "WITH w AS (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) SELECT event_type, strftime(s, '%Y-%m-%d') AS start, count(*) AS n FROM w GROUP BY 1, 2"


def events_sessions(spark, sf_dir: str) -> DataFrame:
    out = sessions(table(spark, sf_dir, "events"), "ts", "4 hours", ["user_id"], {"n": F.count("*")})
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


SESSIONS = "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k"


def events_asof_signup(spark, sf_dir: str) -> DataFrame:
    """Each event with the time since its user's last signup: one window over the union, no range join."""
    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, 0)
    last = F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).over(w)
    return e.select("event_id", F.date_format(last, "yyyy-MM-dd HH:mm:ss").alias("signup"))


ASOF = "SELECT event_id, strftime(max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING), '%Y-%m-%d %H:%M:%S') AS signup FROM events"


def events_json(spark, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.min(k).alias("low"), F.max(k).alias("high"), F.count(k).alias("n"))


JSON = "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS low, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS high, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY 1"


def events_distinct(spark, sf_dir: str) -> DataFrame:
    """Exact distinct users a type (the sketch beside it is for large tables)."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"))


DISTINCT = "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1"


def events_deduplicated(spark, sf_dir: str) -> DataFrame:
    """First event of each user, type and day."""
    first = F.row_number().over(W.partitionBy("user_id", "event_type", F.to_date("ts")).orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("r", first).where("r = 1").select("event_id", "user_id", "event_type")


DEDUP = "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1"


def pricing_rollup(spark, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"), r6(F.avg("l_extendedprice")).alias("price"), F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))
    return out.select("l_returnflag", "l_linestatus", F.round("q", 2).alias("q"), "price", "n", "level")


ROLLUP = "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 6) AS price, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS INTEGER) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"


def segment_cube(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.cube("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("int").alias("level"))


CUBE = "SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(grouping(c_mktsegment) * 2 + grouping(o_orderstatus) AS INTEGER) AS level FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderstatus)"


def nation_revenue(spark, sf_dir: str) -> DataFrame:
    """Revenue by region, nation and ship year: a five-way star join, small sides pruned and pushed down."""
    li = table(spark, sf_dir, "lineitem").where("l_discount > 0.02").select("l_orderkey", "l_suppkey", "l_shipdate", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    s, n, g = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name", F.year("l_shipdate").alias("year")).agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("n"))


REVENUE = "SELECT r_name, n_name, CAST(year(l_shipdate) AS INTEGER) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_discount > 0.02 GROUP BY 1, 2, 3"


def top_parts_by_brand(spark, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    p = q.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    r = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("q"), "p_partkey"))
    return p.withColumn("rank", r).where("rank <= 3").select("p_brand", "rank", "p_partkey", F.round("q", 2).alias("q"))


TOP_PARTS = "SELECT p_brand, CAST(r AS INTEGER) AS rank, p_partkey, round(q, 2) AS q FROM (SELECT p_brand, p_partkey, q, row_number() OVER (PARTITION BY p_brand ORDER BY q DESC, p_partkey) AS r FROM (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) JOIN part ON l_partkey = p_partkey) WHERE r <= 3"

QUERIES = {f.__name__: f for f in (events_tumbling, events_sliding, events_sessions, events_asof_signup, events_json, events_distinct, events_deduplicated, pricing_rollup, segment_cube, nation_revenue, top_parts_by_brand)}
ORACLES = {
    "events_tumbling": TUMBLING, "events_sliding": SLIDING, "events_sessions": SESSIONS, "events_asof_signup": ASOF, "events_json": JSON, "events_distinct": DISTINCT, "events_deduplicated": DEDUP, "pricing_rollup": ROLLUP, "segment_cube": CUBE, "nation_revenue": REVENUE, "top_parts_by_brand": TOP_PARTS,
}
