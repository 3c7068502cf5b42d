"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.functions.expressions import content_key, first_match, hash_order, ladder, sentence_count, set_key, shingles, tokens, word_count
from weftline.functions.words import set_keys
from weftline.operators.aggregate import best_spelling, partial_row_norm, tf_idf_table
from weftline.operators.blockjoin import joined
from weftline.operators.ranking import adjacency_runs, first_occurrence, stratified_sample, top_k
from weftline.operators.relational import compare_snapshots, first_source, overlay, route_by_items
from weftline.operators.similarity import K, TAU, bags_of, inverted_index_similarity, knn_ties, weighted_tokens
from weftline.plans.common import r6, spread, table
from weftline.scratch import materialise, small_enough, without

TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"

SETS = f"""
bags AS (SELECT doc_id, list_sort(list_distinct({TOKENS})) AS t FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT min(doc_id) AS i, t FROM bags WHERE len(t) > 0 GROUP BY t),
toks AS (SELECT i, unnest(t) AS token FROM keyed),
h AS (SELECT count(*) AS h FROM keyed),
dfs AS (SELECT token, count(*) AS df FROM toks GROUP BY token),
w AS (SELECT i, token, df, ln(CAST(h AS DOUBLE) / df) AS idf FROM toks JOIN dfs USING (token), h),
ws AS (SELECT i, sum(idf) AS weight FROM w GROUP BY i)
"""


def document_sets(docs: DataFrame) -> DataFrame:
    """(i, token) of the distinct token sets; i is the smallest document of a set."""
    # the filter says what the words' pattern needs, so the words are taken once, after it
    bags = spread(docs.select("doc_id", "text")).where(F.lower("text").rlike("[a-z0-9]")).select("doc_id", F.array_distinct(tokens("text")).alias("t"))
    keyed = bags.withColumn("k", F.sha2(F.array_join(F.array_sort("t"), " "), 256)).groupBy("k").agg(F.min(F.struct("doc_id", "t")).alias("x"))
    return materialise(keyed.select(F.col("x.doc_id").alias("i"), F.explode("x.t").alias("token")))


def document_bags(docs: DataFrame) -> tuple[DataFrame, int]:
    """(i, text, t) of the distinct token sets as ``document_sets`` has them, text in lower case, and their number; (i, t) where ids
    repeat or are null.  Texts are read where their words are needed, and only keys of the sets are written; texts are
    shuffled, once, only where the documents of sets that are there already outgrow the broadcast bound."""
    docs = spread(docs.select("doc_id", F.lower("text").alias("text"))).where("text is not null")

    def keyed(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, set_keys(batch.column("text")))], ["doc_id", "n", "a", "b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = materialise(docs.mapInArrow(keyed, f"doc_id {kind}, n long, a long, b long").where("n > 0"))
    first = materialise(keys.groupBy("n", "a", "b").agg(F.min("doc_id").alias("i")))
    h = first.count()
    if keys.agg(F.countDistinct("doc_id")).first()[0] < keys.count():  # ids that repeat or are null
        return materialise(bags_of(document_sets(docs).distinct())), h
    others = materialise(keys.select("doc_id").join(first, F.col("doc_id") == F.col("i"), "left_anti"))
    left = without(docs, others, "doc_id")
    return (left if small_enough(others, 32) else materialise(left)).select(F.col("doc_id").alias("i"), "text", F.array_distinct(tokens("text")).alias("t")), h


def near_dup_knn_ties(spark, sf_dir: str) -> DataFrame:
    """Flagship: idf-weighted Jaccard ties between distinct token sets, five nearest with ties from either side."""
    bags, h = document_bags(table(spark, sf_dir, "documents"))
    out = knn_ties(joined(bags, TAU, h, k=K))
    return out.select("i", "j", r6("sim").alias("sim"))


NEAR_DUP = f"""
WITH {SETS},
pairs AS (SELECT a.i AS i, b.i AS j, sum(a.idf) AS o FROM w a JOIN w b ON a.token = b.token AND a.i < b.i WHERE a.idf > 0 GROUP BY a.i, b.i),
sims AS (SELECT p.i, p.j, round(o / (x.weight + y.weight - o), 9) AS sim FROM pairs p JOIN ws x ON p.i = x.i JOIN ws y ON p.j = y.i WHERE x.weight + y.weight - o > 0),
kept AS (SELECT * FROM sims WHERE sim >= 0.4),
sides AS (SELECT i, j, sim FROM kept UNION ALL SELECT j, i, sim FROM kept),
best AS (SELECT *, rank() OVER (PARTITION BY i ORDER BY sim DESC) AS r FROM sides)
SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j, round(sim, 6) AS sim FROM best WHERE r <= 5
"""


def near_dup_members(spark, sf_dir: str) -> DataFrame:
    """Which documents each token set of the flagship stands for."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    bags = docs.select("doc_id", set_key(tokens("text"), 40).alias("k"), F.size(F.array_distinct(tokens("text"))).alias("n")).where("n > 0")
    first = bags.groupBy("k").agg(F.min("doc_id").alias("i"), F.count("*").alias("members"))
    return bags.join(first, "k").select("doc_id", "i", "n", "members")


MEMBERS = f"""
WITH bags AS (SELECT doc_id, list_sort(list_distinct({TOKENS})) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS i, CAST(len(t) AS INTEGER) AS n, count(*) OVER (PARTITION BY t) AS members FROM bags WHERE len(t) > 0
"""


def set_weights(spark, sf_dir: str) -> DataFrame:
    """Size and idf weight of every distinct token set."""
    w = weighted_tokens(document_sets(table(spark, sf_dir, "documents")))
    return w.groupBy("i").agg(F.count("*").alias("n"), r6(F.max("weight")).alias("weight"), r6(F.max("idf")).alias("rarest"))


SET_WEIGHTS = f"WITH {SETS} SELECT i, count(*) AS n, round(sum(idf), 6) AS weight, round(max(idf), 6) AS rarest FROM w GROUP BY i"


def benchmark_word_similarity(spark, sf_dir: str) -> DataFrame:
    """Jaccard and cosine of all benchmark items that share a word, by the inverted index."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("i"), F.explode(F.array_distinct(tokens("text"))).alias("token"))
    return inverted_index_similarity(items).select("i", "j", r6("jaccard").alias("jaccard"), r6("cosine").alias("cosine"))


BENCH_SIM = f"""
WITH t AS (SELECT item_id AS i, unnest(list_distinct({TOKENS})) AS token FROM benchmark),
d AS (SELECT token, count(*) AS df FROM t GROUP BY token),
w AS (SELECT i, token, ln(CAST((SELECT count(DISTINCT i) FROM t) AS DOUBLE) / df) AS idf FROM t JOIN d USING (token)),
s AS (SELECT i, sum(idf) AS weight, sqrt(sum(idf * idf)) AS norm FROM w GROUP BY i),
p AS (SELECT a.i AS i, b.i AS j, sum(a.idf) AS o, sum(a.idf * b.idf) AS d FROM w a JOIN w b ON a.token = b.token AND a.i < b.i WHERE a.idf > 0 GROUP BY a.i, b.i)
SELECT p.i, p.j, round(round(o / (x.weight + y.weight - o), 9), 6) AS jaccard, round(round(d / (x.norm * y.norm), 9), 6) AS cosine FROM p JOIN s x ON p.i = x.i JOIN s y ON p.j = y.i
"""


def term_pairs(spark, sf_dir: str) -> DataFrame:
    """(doc_id, token, tf), written once: all statistics of the terms read it."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return materialise(docs.select("doc_id", F.explode(tokens("text")).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf")))


TF = f"tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM documents) GROUP BY doc_id, token), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), n AS (SELECT count(DISTINCT doc_id) AS n FROM tf), v AS (SELECT doc_id, token, ln(1 + tf) * (ln(CAST(n AS DOUBLE) / (df + 1)) + 1) AS v FROM tf JOIN df USING (token), n)"


def tfidf_topk_terms(spark, sf_dir: str) -> DataFrame:
    """Ten heaviest terms of each document."""
    v = tf_idf_table(term_pairs(spark, sf_dir), "doc_id", "token", "tf").withColumn("v", r6("v"))
    return top_k(v, ["doc_id"], [F.desc("v"), F.col("token")], 10).select("doc_id", "rank", "token", "v")


TFIDF = f"WITH {TF}, r AS (SELECT doc_id, token, round(v, 6) AS v FROM v), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, token) AS INTEGER) AS rank FROM r) SELECT doc_id, rank, token, v FROM k WHERE rank <= 10"


def row_partial_norm(spark, sf_dir: str) -> DataFrame:
    """Sum and largest weight of each document after the partial row norm."""
    v = partial_row_norm(tf_idf_table(term_pairs(spark, sf_dir), "doc_id", "token", "tf"), "doc_id")
    return v.groupBy("doc_id").agg(r6(F.sum("v")).alias("total"), r6(F.max("v")).alias("largest"), F.count("*").alias("n"))


PARTIAL = f"WITH {TF}, n2 AS (SELECT doc_id, sum(v * v) AS s FROM v GROUP BY doc_id) SELECT doc_id, round(sum(CASE WHEN s > 0 THEN v * pow(s, -0.25) ELSE v END), 6) AS total, round(max(CASE WHEN s > 0 THEN v * pow(s, -0.25) ELSE v END), 6) AS largest, count(*) AS n FROM v JOIN n2 USING (doc_id) GROUP BY doc_id"


def content_key_groups(spark, sf_dir: str) -> DataFrame:
    """Documents of equal content keys (token multisets)."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", content_key(tokens("text")).alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


CONTENT_KEYS = f"SELECT key, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, substr(sha1(array_to_string(list_sort(coalesce({TOKENS}, [])), ' ')), 1, 16) AS key FROM documents) GROUP BY key"

#: Ordered rules of the example funnel.
FUNNEL_RULES = [(r"https?://", "link"), (r"[a-z0-9]+@[a-z0-9]", "mail"), (r"licen[sc]e", "licence"), (r"\d{3,}", "number")]


def doc_funnel(spark, sf_dir: str) -> DataFrame:
    """Documents by class and label: first matching rule, then a length ladder."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kind = first_match(F.lower("text"), FUNNEL_RULES, "plain")
    size = ladder([(F.col("n_chars") < 200, "short"), (F.col("n_chars") < 2000, "medium")], "long")
    joined = docs.select("doc_id", "lang", kind.alias("kind"), size.alias("size")).join(labels, "doc_id", "left")
    return joined.groupBy("lang", "kind", "size").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


FUNNEL = r"""
SELECT lang, kind, size, count(*) AS n, count(quality) AS labelled, CAST(coalesce(sum(quality), 0) AS BIGINT) AS good, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS toxic FROM (
  SELECT doc_id, lang,
    CASE WHEN regexp_matches(lower(text), 'https?://') THEN 'link' WHEN regexp_matches(lower(text), '[a-z0-9]+@[a-z0-9]') THEN 'mail'
         WHEN regexp_matches(lower(text), 'licen[sc]e') THEN 'licence' WHEN regexp_matches(lower(text), '\d{3,}') THEN 'number' ELSE 'plain' END AS kind,
    CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS size
  FROM documents) d LEFT JOIN labels USING (doc_id) GROUP BY lang, kind, size
"""


def funnel_grouping_sets(spark, sf_dir: str) -> DataFrame:
    """Coverage table by language, by source and in all, as one pass of grouping sets."""
    docs = table(spark, sf_dir, "documents")
    out = docs.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("int").alias("level"))
    return out.select("lang", "source", "n", "chars", "level")


FUNNEL_SETS = "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(grouping(lang) * 2 + grouping(source) AS INTEGER) AS level FROM documents GROUP BY GROUPING SETS ((lang), (source), ())"


def benchmark_contamination(spark, sf_dir: str) -> DataFrame:
    """(item, document, share): documents that hold half of an item's eight-word phrases or more."""
    # words are a column of their own first: inside the phrase lambda they would be split again for every phrase
    phrases = lambda name, key: table(spark, sf_dir, name).select(key, tokens("text").alias("w")).select(key, F.explode(shingles(F.col("w"), 8)).alias("phrase"))
    items, docs = phrases("benchmark", "item_id"), phrases("documents", "doc_id")
    size = items.groupBy("item_id").agg(F.count("*").alias("size"))
    hits = docs.join(items, "phrase").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared")).join(size, "item_id")
    return hits.where(F.col("shared") * 2 >= F.col("size")).select("item_id", "doc_id", "shared", r6(F.col("shared") / F.col("size")).alias("share"))


PHRASES = "list_distinct(CASE WHEN len(t) = 0 THEN [] ELSE list_transform(range(1, greatest(len(t) - 8 + 1, 1) + 1), lambda i: array_to_string(t[i:i + 7], ' ')) END)"
CONTAMINATION = f"""
WITH b AS (SELECT item_id, unnest({PHRASES}) AS phrase FROM (SELECT item_id, {TOKENS} AS t FROM benchmark)),
d AS (SELECT doc_id, unnest({PHRASES}) AS phrase FROM (SELECT doc_id, coalesce({TOKENS}, []) AS t FROM documents)),
s AS (SELECT item_id, count(*) AS size FROM b GROUP BY item_id)
SELECT item_id, doc_id, count(*) AS shared, round(count(*) / size, 6) AS share FROM d JOIN b USING (phrase) JOIN s USING (item_id) GROUP BY item_id, doc_id, size HAVING count(*) * 2 >= size
"""


def html_title_links(spark, sf_dir: str) -> DataFrame:
    """Header parse of pages: title, language, number of links and host, by expressions over the whole page."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0))).alias("links"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


TITLES = "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS links, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages"


def page_category(spark, sf_dir: str) -> DataFrame:
    """Substring ladder over addresses."""
    url = F.lower("url")
    kind = ladder([(url.like("%casino%"), "spam"), (url.like("%blog.%"), "blog"), (url.like("%//m.%"), "mobile"), (url.like("%.html%"), "file")], "other")
    return table(spark, sf_dir, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


PAGE_CATEGORY = "SELECT CASE WHEN lower(url) LIKE '%casino%' THEN 'spam' WHEN lower(url) LIKE '%blog.%' THEN 'blog' WHEN lower(url) LIKE '%//m.%' THEN 'mobile' WHEN lower(url) LIKE '%.html%' THEN 'file' ELSE 'other' END AS kind, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1"


def conv_adjacent_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of assistant turns in consecutive positions, ten turns at most."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    out = adjacency_runs(turns, "conv_id", "turn", F.col("role") != "user")
    return out.groupBy("conv_id", "run").agg(F.min("turn").alias("first"), F.count("*").alias("steps"))


RUNS = """
WITH t AS (SELECT DISTINCT conv_id, turn, role FROM conversations),
m AS (SELECT *, role <> 'user' AS o, coalesce(turn - lag(turn) OVER w <> 1, true) AS gap, coalesce(lag(role <> 'user') OVER w, false) AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, CAST(sum(CASE WHEN o AND (gap OR NOT before) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) AS step FROM r WHERE o)
SELECT conv_id, run, min(turn) AS first, count(*) AS steps FROM s WHERE step <= 10 GROUP BY conv_id, run
"""


def conv_first_turns(spark, sf_dir: str) -> DataFrame:
    """First occurrence of each text within a conversation and the later turns that repeat it."""
    out = first_occurrence(table(spark, sf_dir, "conversations"), ["conv_id", "text"], ["turn", "role"], "turn")
    return out.select("conv_id", "turn", "role", F.size("also_in").alias("repeats"))


FIRST_TURNS = "SELECT conv_id, turn, role, CAST(n - 1 AS INTEGER) AS repeats FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn, role) AS r, count(*) OVER (PARTITION BY conv_id, text) AS n FROM conversations) WHERE r = 1"


def conv_renumber(spark, sf_dir: str) -> DataFrame:
    """Ids K1..Kn of the turns of a role within a conversation."""
    n = F.row_number().over(W.partitionBy("conv_id", "role").orderBy("turn", "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("K"), n).alias("local_id"))


RENUMBER = "SELECT conv_id, turn, role, 'K' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS local_id FROM conversations"


def anti_semi_overlay(spark, sf_dir: str) -> DataFrame:
    """A patch (documents of even id, text marked) over the base, restricted to labelled documents."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    patch = docs.where("doc_id % 2 = 0").withColumn("text", F.concat("text", F.lit("#")))
    both = overlay(docs.withColumn("origin", F.lit("base")), patch.withColumn("origin", F.lit("patch")), "doc_id")
    return both.join(labels.select("doc_id"), "doc_id", "left_semi").groupBy("origin").agg(F.count("*").alias("n"), F.min(F.md5("text")).alias("first_digest"))


OVERLAY = "SELECT origin, count(*) AS n, min(md5(text)) AS first_digest FROM (SELECT doc_id, 'patch' AS origin, text || '#' AS text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'base', text FROM documents WHERE doc_id % 2 <> 0) WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY origin"


def first_source_wins(spark, sf_dir: str) -> DataFrame:
    """Ordered sources: labels first, then documents; the first that knows an id gives the row."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit("labels").alias("origin"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("documents").alias("origin"))
    return first_source([labels, docs], "doc_id")


FIRST_SOURCE = "SELECT doc_id, 'labels' AS origin FROM labels UNION ALL SELECT doc_id, 'documents' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def change_classify(spark, sf_dir: str) -> DataFrame:
    """Two snapshots of documents: the new one lacks every seventh and has changed every fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("digest"))
    new = docs.where("doc_id % 7 <> 3").withColumn("digest", F.when(F.col("doc_id") % 5 == 0, F.lit("x")).otherwise(F.col("digest")))
    return compare_snapshots(docs.where("doc_id % 11 <> 4"), new, "doc_id", "digest")


CHANGES = "WITH d AS (SELECT doc_id, sha1(text) AS digest FROM documents), o AS (SELECT * FROM d WHERE doc_id % 11 <> 4), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE digest END AS digest FROM d WHERE doc_id % 7 <> 3) SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'dropped' WHEN o.digest IS NOT DISTINCT FROM n.digest THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id"


def route_documents(spark, sf_dir: str) -> DataFrame:
    """Sources routed by how their sets of documents changed."""
    docs = table(spark, sf_dir, "documents")
    old, new = docs.where("doc_id % 13 <> 5"), docs.where("(doc_id % 17 <> 2 or source < 'src3') and source <> 'src4'")
    return route_by_items(old, new, "source", "doc_id")


ROUTES = """
WITH o AS (SELECT DISTINCT source, doc_id FROM documents WHERE doc_id % 13 <> 5), n AS (SELECT DISTINCT source, doc_id FROM documents WHERE (doc_id % 17 <> 2 OR source < 'src3') AND source <> 'src4'),
b AS (SELECT coalesce(o.source, n.source) AS source, count(o.doc_id) AS a, count(n.doc_id) AS c, count(*) FILTER (o.doc_id IS NULL) AS added, count(*) FILTER (n.doc_id IS NULL) AS gone FROM o FULL JOIN n ON o.source = n.source AND o.doc_id = n.doc_id GROUP BY 1)
SELECT source, CASE WHEN a = 0 THEN 'new' WHEN c = 0 THEN 'missing' WHEN added > 0 THEN 'additions' WHEN gone > 0 THEN 'removals_only' ELSE 'unchanged' END AS route FROM b
"""


def text_counts(spark, sf_dir: str) -> DataFrame:
    """Words and sentences of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("words"), sentence_count(F.col("text")).alias("sentences"))


TEXT_COUNTS = r"SELECT doc_id, CAST(CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\s+')) END AS INTEGER) AS words, CAST(len(list_filter(string_split_regex(text, '[.!?]+(?:\s+|$)'), lambda s: trim(s) <> '')) AS INTEGER) AS sentences FROM documents"


def language_spelling(spark, sf_dir: str) -> DataFrame:
    """Most frequent form of each spelling key (letters only) over all documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+(?:_[A-Za-z]+)*"), F.lit(0))).alias("form"))
    forms = words.groupBy("form").agg(F.count("*").alias("c")).withColumn("key", F.lower(F.regexp_replace("form", "_", "")))
    return best_spelling(forms, "key", "form", "c")


SPELLING = "WITH f AS (SELECT form, count(*) AS c, lower(replace(form, '_', '')) AS key FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+(?:_[A-Za-z]+)*')) AS form FROM documents) GROUP BY form) SELECT key, form FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, contains(form, '_') DESC, length(form), form) AS r FROM f) WHERE r = 1"


def stratified_by_language(spark, sf_dir: str) -> DataFrame:
    """Twenty documents a language in a portable random order, none of the labelled ones."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id")
    return stratified_sample(docs, ["lang"], "doc_id", 20, "s1", labels)


STRATIFIED = "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|s1'), doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE r <= 20"


TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def title_distance(spark, sf_dir: str) -> DataFrame:
    """Distinct page titles of equal first word that differ by at most 30 % edits; lengths that far apart never meet."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.array_join(tokens(F.regexp_extract("html", TITLE, 1)), " ").alias("t"))
    first = pages.where("t <> ''").groupBy("t").agg(F.min("page_id").alias("i"))
    keyed = first.withColumn("k", F.substring_index("t", " ", 1)).withColumn("n", F.length("t"))
    a, b = keyed.alias("a"), keyed.alias("b")
    near = F.least("a.n", "b.n") >= 0.7 * F.greatest("a.n", "b.n")
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.i") < F.col("b.i")) & near)
    ratio = F.levenshtein("a.t", "b.t") / F.greatest("a.n", "b.n")
    return pairs.select(F.col("a.i").alias("i"), F.col("b.i").alias("j"), r6(ratio).alias("ratio")).where("ratio <= 0.3")


TITLES_NEAR = f"""
WITH f AS (SELECT min(page_id) AS i, t FROM (SELECT page_id, array_to_string(regexp_extract_all(lower(regexp_extract(html, '{TITLE}', 1)), '[a-z0-9]+'), ' ') AS t FROM pages WHERE html IS NOT NULL) WHERE t <> '' GROUP BY t)
SELECT a.i, b.i AS j, round(levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 6) AS ratio FROM f a JOIN f b ON split_part(a.t, ' ', 1) = split_part(b.t, ' ', 1) AND a.i < b.i WHERE levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)) <= 0.3
"""


def reservoir_by_role(spark, sf_dir: str) -> DataFrame:
    """Five turns a role in a portable random order (what a reservoir keeps)."""
    key = F.concat_ws("-", "conv_id", "turn")
    return top_k(table(spark, sf_dir, "conversations").select("role", key.alias("key")).distinct(), ["role"], [hash_order(F.col("key"), "r"), F.col("key")], 5).select("role", "key")


RESERVOIR = "SELECT role, key FROM (SELECT role, key, row_number() OVER (PARTITION BY role ORDER BY md5(key || '|r'), key) AS r FROM (SELECT DISTINCT role, conv_id || '-' || turn AS key FROM conversations)) WHERE r <= 5"

QUERIES = {f.__name__: f for f in (near_dup_knn_ties, near_dup_members, set_weights, benchmark_word_similarity, tfidf_topk_terms, row_partial_norm, content_key_groups, doc_funnel, funnel_grouping_sets, benchmark_contamination, html_title_links, page_category, conv_adjacent_runs, conv_first_turns, conv_renumber, anti_semi_overlay, first_source_wins, change_classify, route_documents, text_counts, language_spelling, stratified_by_language, title_distance, reservoir_by_role)}
ORACLES = {
    "near_dup_knn_ties": NEAR_DUP, "near_dup_members": MEMBERS, "set_weights": SET_WEIGHTS, "benchmark_word_similarity": BENCH_SIM, "tfidf_topk_terms": TFIDF, "row_partial_norm": PARTIAL, "content_key_groups": CONTENT_KEYS, "doc_funnel": FUNNEL, "funnel_grouping_sets": FUNNEL_SETS,
    "benchmark_contamination": CONTAMINATION, "html_title_links": TITLES, "page_category": PAGE_CATEGORY, "conv_adjacent_runs": RUNS, "conv_first_turns": FIRST_TURNS, "conv_renumber": RENUMBER, "anti_semi_overlay": OVERLAY, "first_source_wins": FIRST_SOURCE, "change_classify": CHANGES, "route_documents": ROUTES,
    "text_counts": TEXT_COUNTS, "language_spelling": SPELLING, "stratified_by_language": STRATIFIED, "title_distance": TITLES_NEAR, "reservoir_by_role": RESERVOIR,
}
