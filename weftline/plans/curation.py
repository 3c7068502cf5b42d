"""Queries over curation filters, folds and evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.expressions import tokens
from weftline.operators.curation import blank_lines, classify_sets, cluster_works, companions, exclude_listed, label_propagation, merge_checks, nonprose, split_items, surviving_units, with_items
from weftline.operators.evaluation import band_harm, error_parts, fold_values, heldout_scores, paired_difference, placed, recurrence
from weftline.operators.relational import two_hops
from weftline.plans.common import r6, table

TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def exclusion_list(spark, sf_dir: str) -> DataFrame:
    """Documents less listed ones; listed under another digest they stay and are marked stale."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    listed = docs.where("doc_id % 4 = 1").withColumn("digest", F.when(F.col("doc_id") % 8 == 1, F.lit("old")).otherwise(F.col("digest")))
    kept, stale = exclude_listed(docs, listed, "doc_id", "digest")
    return kept.select("doc_id").join(stale.select("doc_id").distinct().withColumn("stale", F.lit(1)), "doc_id", "left").select("doc_id", F.coalesce("stale", F.lit(0)).alias("stale"))


EXCLUSIONS = "SELECT doc_id, CASE WHEN doc_id % 8 = 1 THEN 1 ELSE 0 END AS stale FROM documents WHERE NOT (doc_id % 4 = 1 AND doc_id % 8 <> 1)"


def companion_statements(spark, sf_dir: str) -> DataFrame:
    """Turns of a conversation that holds a question: short turns become statements with it."""
    c = table(spark, sf_dir, "conversations").withColumn("s", F.col("text").contains("?")).withColumn("loose", F.length("text") < 200)
    return companions(c, "conv_id", "s", "loose").groupBy("role").agg(F.count_if("s").alias("statements"), F.count("*").alias("n"))


COMPANIONS = "SELECT role, count(*) FILTER (s) AS statements, count(*) AS n FROM (SELECT role, contains(text, '?') OR (length(text) < 200 AND bool_or(contains(text, '?')) OVER (PARTITION BY conv_id)) AS s FROM conversations) GROUP BY role"


def rejected_terms(spark, sf_dir: str) -> DataFrame:
    """Distinct words of benchmark items, split into kept ones and rejected ones with a reason."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(tokens("text")).alias("words"))
    reason = F.when(F.length("item") <= 2, "short").when(F.col("item").rlike("^th"), "article")
    kept, gone = split_items(items, "item_id", "words", reason)
    left = with_items(kept, "words").select("item_id", F.size("words").alias("kept"), F.element_at("words", 1).alias("first"))
    n = gone.groupBy("item_id").agg(F.count_if(F.col("reason") == "short").alias("short"), F.count_if(F.col("reason") == "article").alias("article"))
    return left.join(n, "item_id", "left").na.fill(0, ["short", "article"])


REJECTED = f"""
WITH t AS (SELECT item_id, unnest(list_distinct({TOKENS})) AS w FROM benchmark), r AS (SELECT *, CASE WHEN length(w) <= 2 THEN 'short' WHEN w LIKE 'th%' THEN 'article' END AS reason FROM t)
SELECT item_id, CAST(count(*) FILTER (reason IS NULL) AS INTEGER) AS kept, min(w) FILTER (reason IS NULL) AS first, count(*) FILTER (reason = 'short') AS short, count(*) FILTER (reason = 'article') AS article FROM r GROUP BY item_id HAVING count(*) FILTER (reason IS NULL) > 0
"""


def nonprose_kinds(spark, sf_dir: str) -> DataFrame:
    """Kinds of lines of documents that are no sentences."""
    lines = table(spark, sf_dir, "documents").select("lang", F.explode(F.split("text", "\n", -1)).alias("line"))
    count = lambda p: F.size(F.regexp_extract_all("line", F.lit(p), F.lit(0)))
    kind = nonprose(F.col("line"), count("[A-Za-z]+"), count(r"\b[A-Z][a-z]+"), captions=r"^(Figure|Table) [0-9]", code=r"[{};]$")
    return lines.select("lang", kind.alias("kind")).where("kind is not null").groupBy("lang", "kind").agg(F.count("*").alias("n"))


NONPROSE = r"""
WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT lang, CASE WHEN regexp_matches(line, '(?i)^\s*(references|bibliography)\b') THEN 'reference' WHEN regexp_matches(line, '^(Figure|Table) [0-9]') THEN 'caption' WHEN regexp_matches(line, '^\s*\(?[A-Ha-h]\)[\s:]') THEN 'panel' WHEN regexp_matches(line, '[{};]$') THEN 'code'
  WHEN len(regexp_extract_all(line, '[A-Za-z]+')) BETWEEN 1 AND 20 AND len(regexp_extract_all(line, '\b[A-Z][a-z]+')) / len(regexp_extract_all(line, '[A-Za-z]+')) >= 0.6 THEN 'heading'
  WHEN regexp_matches(line, '(?i)\b(where|let|here)\s+\$?\\?[a-z]\w{0,2}\$?\s+(is|be|are|denotes?|represents?)\b') OR regexp_matches(line, '(?i)\b[a-z]\s+denotes?\b') THEN 'notation' END AS kind FROM l)
SELECT lang, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY lang, kind
"""


def blanked_lines(spark, sf_dir: str) -> DataFrame:
    """Lines with links, mail addresses or licence notes blanked; their number stays."""
    rules = ["https?://", "[a-z0-9]@[a-z0-9]", "[Ll]icensed under"]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", blank_lines(F.col("text"), rules).alias("cut"))
    lines = lambda c: F.size(F.split(c, "\n", -1))
    return docs.where("text is not null").select("doc_id", lines("cut").alias("lines"), (F.length("text") - F.length("cut")).alias("removed"))


BLANKED = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(count(*) AS INTEGER) AS lines, CAST(coalesce(sum(length(line)) FILTER (regexp_matches(line, 'https?://') OR regexp_matches(line, '[a-z0-9]@[a-z0-9]') OR regexp_matches(line, '[Ll]icensed under')), 0) AS INTEGER) AS removed FROM l GROUP BY doc_id"


def unit_survival(spark, sf_dir: str) -> DataFrame:
    """Line items as units of an order: a unit that lost its focal mark goes; one without a parent stays only if
    it names the parent of a unit that stays."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sid"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("uid"), "l_partkey", "l_linenumber", "l_suppkey").distinct()
    units = li.select("uid", "sid", (F.col("l_partkey") % 3 == 0).alias("had_focal"), (F.col("l_partkey") % 6 == 0).alias("has_focal"))
    parents = li.where("l_suppkey % 2 = 0").select("sid", "uid", F.col("l_linenumber").alias("pid"))
    cousins = li.select("sid", "uid", (F.col("l_linenumber") - 1).alias("pid"))
    return surviving_units(units, parents, cousins)


SURVIVAL = """
WITH li AS (SELECT DISTINCT l_orderkey AS sid, l_orderkey || '/' || l_linenumber || '/' || l_partkey AS uid, l_partkey, l_linenumber, l_suppkey FROM lineitem),
f AS (SELECT * FROM li WHERE l_partkey % 6 = 0 OR l_partkey % 3 <> 0), a AS (SELECT sid, uid, l_linenumber AS pid FROM f WHERE l_suppkey % 2 = 0)
SELECT uid FROM a UNION SELECT f.uid FROM f JOIN a ON f.sid = a.sid AND f.l_linenumber - 1 = a.pid
"""


def works_by_title(spark, sf_dir: str) -> DataFrame:
    """Documents clustered as works by the similarity of their first lines, among those of one source."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    title = F.array_join(tokens(F.split("text", "\n", 2)[0]), " ")
    works = docs.select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("doi"), F.coalesce("source", F.lit("-")).alias("author"), F.lit(2024).alias("year"), title.alias("title"))
    first = works.groupBy("author", "title").agg(F.min("id").alias("id"), F.min("doi").alias("doi"), F.min("year").alias("year"))
    return cluster_works(first.where("title <> ''").select("id", "doi", "author", "year", "title"))


WORKS = """
WITH RECURSIVE t AS (SELECT min(doc_id) AS id, author, title FROM (SELECT doc_id, coalesce(source, '-') AS author, array_to_string(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9]+'), ' ') AS title FROM documents WHERE text IS NOT NULL) WHERE title <> '' GROUP BY author, title),
w AS (SELECT id, author, list_distinct(string_split(title, ' ')) AS ws FROM t),
p AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.author = b.author AND a.id < b.id WHERE len(list_intersect(a.ws, b.ws)) >= 0.6 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))),
edges AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach(a, b) USING KEY (a) AS (
  SELECT a, a AS b FROM (SELECT DISTINCT a FROM edges)
  UNION
  SELECT e.a, min(r.b) AS b FROM edges e JOIN reach r ON e.b = r.a JOIN recurring.reach o ON o.a = e.a WHERE r.b < o.b GROUP BY e.a)
SELECT id, coalesce(b, id) AS work FROM t LEFT JOIN reach ON a = id
"""


def generic_sets(spark, sf_dir: str) -> DataFrame:
    """Suppliers' part brands against a list of kinds: generic, ambiguous or substantive."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand").distinct()
    kinds = table(spark, sf_dir, "part").select("p_brand").distinct().where("p_brand < 'Brand#4'").select("p_brand", F.substring("p_brand", -2, 1).alias("kind"))
    return classify_sets(items, "l_orderkey", "p_brand", kinds)


GENERIC = """
WITH i AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey), k AS (SELECT DISTINCT p_brand, substr(p_brand, length(p_brand) - 1, 1) AS kind FROM part WHERE p_brand < 'Brand#4')
SELECT l_orderkey, CASE WHEN count(*) FILTER (kind IS NULL) > 0 THEN 'substantive' WHEN count(DISTINCT kind) = 1 THEN 'generic' ELSE 'ambiguous' END AS class FROM i LEFT JOIN k USING (p_brand) GROUP BY 1
"""


def supplier_communities(spark, sf_dir: str) -> DataFrame:
    """Label propagation over strong ties of the supplier graph."""
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("end"), F.col("l_partkey").alias("middle")).agg(F.count("*").cast("double").alias("w"))
    strong = two_hops(e)
    return label_propagation(strong.select("a", "b", "w"))


def merge_invariants(spark, sf_dir: str) -> DataFrame:
    """Checks of a merge of orders, one row an invariant."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.col("o_custkey").cast("string")).alias("digest"))
    new = o.where("o_orderkey % 50 <> 7").unionByName(o.where("o_orderkey % 100 = 3")).withColumn("digest", F.when(F.col("o_orderkey") % 70 == 5, F.lit("x")).otherwise(F.col("digest")))
    checks = merge_checks(o, new, o.where("o_orderkey % 100 = 57"), "o_orderkey", "digest")
    return spark.createDataFrame(sorted(checks.items()), "invariant string, n long")


INVARIANTS = """
WITH n AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 7 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 100 = 3)
SELECT 'repeated' AS invariant, count(*) AS n FROM (SELECT o_orderkey FROM n GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'missing', count(*) FROM orders WHERE o_orderkey % 50 = 7 AND o_orderkey % 100 <> 57
UNION ALL SELECT 'excluded_present', count(*) FROM n WHERE o_orderkey % 100 = 57 UNION ALL SELECT 'digest_differs', count(*) FROM n WHERE o_orderkey % 70 = 5
"""


def fold_weights(spark, sf_dir: str) -> DataFrame:
    """Leakage-free weights of four folds of the supplier-part matrix."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.count("*").alias("tf"))
    t = t.withColumn("group", F.when((F.col("row") + F.col("col")) % 5 < 4, (F.col("row") + F.col("col")) % 5).otherwise(-1).cast("int"))
    return fold_values(t, 4).groupBy("fold", "row").agg(F.count("*").alias("n"), r6(F.sum("v")).alias("total"))


FOLDS = """
WITH t AS (SELECT l_suppkey AS r, l_partkey AS c, count(*) AS tf FROM lineitem GROUP BY 1, 2), s AS (SELECT f.fold, t.* FROM t CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS fold) f WHERE (r + c) % 5 <> f.fold),
n AS (SELECT fold, count(DISTINCT r) AS n FROM s GROUP BY 1), d AS (SELECT fold, c, count(*) AS df FROM s GROUP BY 1, 2),
v AS (SELECT s.fold, s.r, ln(1 + tf) * (ln(CAST(n AS DOUBLE) / (df + 1)) + 1) AS v FROM s JOIN n ON s.fold = n.fold JOIN d ON s.fold = d.fold AND s.c = d.c), q AS (SELECT fold, r, sum(v * v) AS q FROM v GROUP BY 1, 2)
SELECT v.fold, v.r AS "row", count(*) AS n, round(sum(CASE WHEN q > 0 THEN v * pow(q, -0.25) ELSE v END), 6) AS total FROM v JOIN q ON v.fold = q.fold AND v.r = q.r GROUP BY 1, 2
"""


def cells(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("row"), F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity") / 50).alias("v"), ((F.col("l_discount") + 0.01) * 5).alias("xhat"))


CELLS = "c AS (SELECT l_suppkey AS r, CASE WHEN l_returnflag = 'R' THEN 0.0::DOUBLE ELSE l_quantity / 50 END AS v, (l_discount + 0.01::DOUBLE) * 5 AS h FROM lineitem)"


def heldout_by_supplier(spark, sf_dir: str) -> DataFrame:
    out = heldout_scores(cells(spark, sf_dir), ["row"])
    return out.select("row", r6("captured").alias("captured"), r6("kl").alias("kl"), r6("over").alias("over"))


HELDOUT = f'WITH {CELLS} SELECT r AS "row", round(1 - sum((v - h) * (v - h)) / sum(v * v), 6) AS captured, round(sum(CASE WHEN v > 0 THEN v * ln(v / h) - v + h ELSE h END), 6) AS kl, round(avg(CASE WHEN h > v THEN 1.0::DOUBLE ELSE 0 END), 6) AS over FROM c GROUP BY r'


def error_decomposition(spark, sf_dir: str) -> DataFrame:
    out = error_parts(cells(spark, sf_dir))
    return out.select(F.round("ties", 4).alias("ties"), F.round("empty", 4).alias("empty"), r6("calibration").alias("calibration"))


ERRORS = f"WITH {CELLS} SELECT round(sum(CASE WHEN v > 0 THEN (v - h) * (v - h) ELSE 0 END), 4) AS ties, round(sum(CASE WHEN v = 0 THEN (v - h) * (v - h) ELSE 0 END), 4) AS empty, round(sum(h) / sum(v), 6) AS calibration FROM c"


def placed_suppliers(spark, sf_dir: str) -> DataFrame:
    """Suppliers whose mean price share beats the baseline by more than its spread over years (as seeds)."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.avg(F.col("l_extendedprice") / 100000).alias("share"), F.lit(0.3).alias("base"))
    return placed(li, "l_suppkey", "share", "base").select("l_suppkey", r6("gain").alias("gain"), "placed")


PLACED = "WITH s AS (SELECT l_suppkey, year(l_shipdate) AS y, avg(l_extendedprice / 100000) AS share FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, round(avg(share - 0.3::DOUBLE), 6) AS gain, avg(share - 0.3::DOUBLE) > coalesce(stddev_samp(share), 0) AS placed FROM s GROUP BY 1"


def arm_difference(spark, sf_dir: str) -> DataFrame:
    """Paired difference of mean price under two ship flags over suppliers."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.avg("l_extendedprice").alias("x"))
    out = paired_difference(li, "l_linestatus", "l_suppkey", "x", "F", "O")
    return out.select("n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


ARMS = "WITH s AS (SELECT l_suppkey, l_linestatus AS f, avg(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2) SELECT count(*) AS n, round(avg(b.x - a.x), 4) AS mean, round(stddev_samp(b.x - a.x), 4) AS sd FROM s a JOIN s b USING (l_suppkey) WHERE a.f = 'F' AND b.f = 'O'"


def harm_by_band(spark, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.floor(F.log2(F.col("l_quantity") + 1)).alias("band"), (F.col("l_discount") > 0.05).alias("e"), "l_extendedprice")
    return band_harm(li, "band", "e", "l_extendedprice").select(F.round("harm", 4).alias("harm"))


HARM = "WITH b AS (SELECT floor(log2(l_quantity + 1)) AS band, count(*) FILTER (l_discount > 0.05) AS n, avg(l_extendedprice) FILTER (l_discount > 0.05) AS e, avg(l_extendedprice) FILTER (l_discount <= 0.05) AS o FROM lineitem GROUP BY 1) SELECT round(sum(n * (e - o)) / sum(n), 4) AS harm FROM b WHERE n > 0 AND o IS NOT NULL"


def failure_recurrence(spark, sf_dir: str) -> DataFrame:
    """Event types by user as failures of days as seeds: share of the other days each recurs on."""
    e = table(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("seed"), F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string")).alias("item"))
    return recurrence(e, 30).select("item", r6("share").alias("share"))


RECURRENCE = "SELECT item, round((count(*) - 1) / 29, 6) AS share FROM (SELECT DISTINCT day(ts) AS seed, event_type || ':' || (user_id % 20) AS item FROM events) GROUP BY item"

QUERIES = {f.__name__: f for f in (exclusion_list, companion_statements, rejected_terms, nonprose_kinds, blanked_lines, unit_survival, works_by_title, generic_sets, supplier_communities, merge_invariants, fold_weights, heldout_by_supplier, error_decomposition, placed_suppliers, arm_difference, harm_by_band, failure_recurrence)}
ORACLES = {
    "works_by_title": WORKS,
    "exclusion_list": EXCLUSIONS, "companion_statements": COMPANIONS, "rejected_terms": REJECTED, "nonprose_kinds": NONPROSE, "blanked_lines": BLANKED, "unit_survival": SURVIVAL, "generic_sets": GENERIC, "merge_invariants": INVARIANTS, "fold_weights": FOLDS, "heldout_by_supplier": HELDOUT, "error_decomposition": ERRORS, "placed_suppliers": PLACED, "arm_difference": ARMS, "harm_by_band": HARM, "failure_recurrence": RECURRENCE,
}
