"""Filters and routing of text units, with a record of what each rule removed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.operators.blockjoin import joined
from weftline.operators.graph import connected_components
from weftline.operators.relational import dense_ids
from weftline.scratch import materialise, small_enough


def exclude_listed(rows: DataFrame, listed: DataFrame, key: str, digest: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, stale): rows whose key, and digest if given, are not listed; and rows whose key is listed under
    another digest, which are kept but must be looked at."""
    keys = [key, digest] if digest else [key]
    kept = rows.join(listed.select(*keys).distinct(), keys, "left_anti")
    stale = kept.join(listed.select(key).distinct(), key, "left_semi") if digest else kept.limit(0)
    return kept, stale


def valid_records(rows: DataFrame, kinds: str, void: str) -> DataFrame:
    """Rows whose array of kinds lacks ``void``; rows with unknown kinds stay, marked by ``unknown``."""
    return rows.where(F.col(kinds).isNull() | ~F.array_contains(kinds, void)).withColumn("unknown", F.col(kinds).isNull())


def nonprose(text: Column, words: Column, names: Column, references: str = r"(?i)^\s*(references|bibliography)\b", captions: str = r"(?i)^\s*(fig(ure)?|table)\s*\d", code: str = r"[{};]\s*$|^\s*(for|while|if)\s*\(", panels: str = r"^\s*\(?[A-Ha-h]\)[\s:]") -> Column:
    """Kind of text that is no sentence: reference, caption, panel caption, code, heading (60 % or more capitalised words
    of 20 at most) or notation (a symbol's definition); null for prose.  ``words`` and ``names`` count all words and
    capitalised ones."""
    heading = (words > 0) & (words <= 20) & (names / words >= 0.6)
    return F.when(text.rlike(references), "reference").when(text.rlike(captions), "caption").when(text.rlike(panels), "panel").when(text.rlike(code), "code").when(heading, "heading").when(defines_symbol(text), "notation")


def defines_symbol(text: Column) -> Column:
    """Sentences that introduce a symbol: where x is, let x be, x denotes."""
    return text.rlike(r"(?i)\b(where|let|here)\s+\$?\\?[a-z]\w{0,2}\$?\s+(is|be|are|denotes?|represents?)\b") | text.rlike(r"(?i)\b[a-z]\s+denotes?\b")


def companions(rows: DataFrame, group: str, statement: str, loose: str) -> DataFrame:
    """``loose`` rows of a group that holds a statement become statements."""
    return rows.withColumn(statement, F.col(statement) | (F.col(loose) & F.bool_or(statement).over(W.partitionBy(group))))


def split_items(rows: DataFrame, key: str, items: str, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): arrays less the items a reason is given for (a column over ``item``), and (key, item,
    reason) of those.  Rows left without an item stay with an empty array."""
    tagged = rows.select(key, F.explode(items).alias("item")).withColumn("reason", reason)
    kept = tagged.where("reason is null").groupBy(key).agg(F.array_sort(F.collect_list("item")).alias(items))
    out = rows.drop(items).join(kept, key, "left").withColumn(items, F.coalesce(items, F.array().cast(dict(rows.dtypes)[items])))
    return out, tagged.where("reason is not null")


def with_items(rows: DataFrame, items: str) -> DataFrame:
    return rows.where(F.size(items) > 0)


def surviving_units(units: DataFrame, parents: DataFrame, cousins: DataFrame) -> DataFrame:
    """(uid): units that stay after atoms were dropped.  ``units``: uid, sid, had_focal, has_focal; ``parents``: sid,
    uid, pid; ``cousins``: sid, uid, pid (the parent of another unit of the sentence it names).

    A unit that had a focal atom and lost its last one goes; a unit without a parent stays only if a cousin of it
    names a parent of a unit that stays.
    """
    first = units.where("has_focal or not had_focal")
    alive = parents.join(first.select("uid"), "uid", "left_semi")
    own = first.join(alive.select("uid").distinct(), "uid", "left_semi").select("uid")
    by_cousin = cousins.join(first.select("uid"), "uid", "left_semi").join(alive.select("sid", "pid").distinct(), ["sid", "pid"], "left_semi").select("uid").distinct()
    return own.unionByName(by_cousin).distinct()


def label_prefix(text: Column, vocabulary: list[str], most: int = 8) -> Column:
    """Whether the words before the first colon are ``most`` at most and all in the vocabulary."""
    head = F.regexp_extract_all(F.lower(F.regexp_extract(text, r"^([^:]{1,120}):", 1)), F.lit("[a-z0-9]+"), F.lit(0))
    return (F.size(head) > 0) & (F.size(head) <= most) & (F.size(F.array_except(head, F.array(*map(F.lit, vocabulary)))) == 0)


def blank_lines(text: Column, rules: list[str]) -> Column:
    """Lines that match a rule made empty; the number of lines stays."""
    hit = lambda line: F.exists(F.array(*map(F.lit, rules)), lambda r: F.regexp_like(line, r))
    return F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.when(hit(line), "").otherwise(line)), "\n")


def hub_spelling(token: Column, families: list[str], signals: list[str]) -> Column:
    """Whether the parts of a lower-case token hold a listed family and a hub signal."""
    parts = F.split(F.lower(token), "[-_/]")
    return F.arrays_overlap(parts, F.array(*map(F.lit, families))) & F.arrays_overlap(parts, F.array(*map(F.lit, signals)))


def cluster_works(works: DataFrame, similarity: float = 0.6) -> DataFrame:
    """(id, work): records of one work share an identifier, or first author and title words (Jaccard) within a year.

    ``works``: id (long), doi, author, year, title.  A word of two authors is two tokens, so titles meet within an author only;
    pairs are verified where they are found (``blockjoin``)."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), F.lit(0)))
    bags = works.where("id is not null and author is not null and title is not null").select("id", F.col("author").cast("string").alias("author"), "year", words.alias("ws"))
    bags = materialise(bags.select(F.col("id").cast("long").alias("i"), F.transform("ws", lambda w: F.concat("author", F.lit("\n"), w)).alias("t"), F.col("year").alias("mark")))
    by_title = joined(bags, similarity, weighted=False).select(F.col("i").alias("src"), F.col("j").alias("dst"))
    first = works.where("doi is not null").groupBy("doi").agg(F.min("id").alias("dst"))
    by_doi = works.join(first, "doi").select(F.col("id").alias("src"), "dst")
    found = connected_components(by_title.unionByName(by_doi)).withColumnsRenamed({"node": "id", "component": "work"})
    return works.select("id").join(found, "id", "left").select("id", F.coalesce("work", "id").alias("work"))


def greedy_clusters(rows: DataFrame, key: str, order: str, columns: list[str], fits, kind: str) -> DataFrame:  # noqa: ANN001
    """(key, order, cluster): within a key, in the declared order, a row joins the first cluster whose first member
    it fits.  ``kind``: DDL of key and order.  A key's rows are bounded by what one identity can hold."""
    from weftline.functions.names import greedy_groups

    def work(frame):  # noqa: ANN001, ANN202
        frame = frame.sort_values(order)
        items = list(frame[columns].itertuples(index=False, name=None))
        return frame[[key, order]].assign(cluster=greedy_groups(items, fits))

    return rows.select(key, order, *columns).groupBy(key).applyInPandas(work, f"{kind}, cluster int")


def merge_checks(old: DataFrame, new: DataFrame, excluded: DataFrame, key: str, digest: str) -> dict[str, int]:
    """Invariants of a merge; all must be 0: repeated keys, keys lost, excluded keys present, digests that differ."""
    both = old.select(key, F.col(digest).alias("__a")).join(new.select(key, F.col(digest).alias("__b")), key)
    return {
        "repeated": new.groupBy(key).count().where("count > 1").count(),
        "missing": old.select(key).join(excluded.select(key), key, "left_anti").join(new.select(key), key, "left_anti").count(),
        "excluded_present": new.join(excluded.select(key), key, "left_semi").count(),
        "digest_differs": both.where(~F.col("__a").eqNullSafe(F.col("__b"))).count(),
    }


def classify_sets(items: DataFrame, key: str, item: str, kinds: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(key, class): generic if all items are of listed kinds of one sort, ambiguous if of several, substantive if
    any is unlisted; ``overrides`` (key, class) win.  ``kinds``: item, kind."""
    j = items.join(kinds, item, "left").groupBy(key).agg(F.count_if(F.col("kind").isNull()).alias("n"), F.countDistinct("kind").alias("k"))
    out = j.select(key, F.when(F.col("n") > 0, "substantive").when(F.col("k") == 1, "generic").otherwise("ambiguous").alias("class"))
    if overrides is None:
        return out
    return out.join(overrides.select(key, F.col("class").alias("__o")), key, "left").select(key, F.coalesce("__o", "class").alias("class"))


def label_propagation(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, community) by weighted label propagation on edges (a, b, w); ties go to the smallest label.  A round
    counts as settled when no label moves; labels are updated in alternating halves of the nodes, so pairs cannot
    swap for ever.  The result is stable: both halves are quiet one after the other; RuntimeError if ``rounds`` of
    both do not reach that."""
    both = edges.where("a is not null and b is not null").select("a", "b", "w")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    nodes = materialise(dense_ids(both.select(F.col("a").alias("node")).distinct(), ["node"], "n"))
    if small_enough(nodes):
        return _labels_sent(both, nodes, rounds)
    both = materialise(both)
    now = materialise(both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    still = 0
    for r in range(2 * rounds):
        votes = both.join(now.withColumnsRenamed({"node": "b"}), "b").groupBy("a", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("x")).select(F.col("a").alias("node"), F.col("x.community").alias("new"))
        half = F.pmod(F.xxhash64("node"), F.lit(2)) == r % 2
        step = materialise(now.join(best, "node").select("node", F.when(half, F.col("new")).otherwise(F.col("community")).alias("community"), (half & (F.col("new") != F.col("community"))).alias("moved")))
        still = still + 1 if step.where("moved").isEmpty() else 0
        now = step.select("node", "community")
        if still == 2:
            return now
    raise RuntimeError("labels did not settle")


def _labels_sent(both: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """``label_propagation`` where the labels can be broadcast: neighbours are written once, a row a node, and a round reads
    those of its half and sends only labels."""
    import pyarrow as pa

    spark = both.sparkSession
    number = lambda c: F.broadcast(nodes.select(F.col("node").alias(c), F.col("n").cast("int").alias(f"n{c}")))
    rows = both.join(number("a"), "a").join(number("b"), "b").select("na", F.pmod(F.xxhash64("a"), F.lit(2)).alias("half"), F.struct(F.col("nb").alias("m"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w")).alias("x"))
    near = rows.groupBy("na", "half").agg(F.collect_list("x").alias("x"))
    near = materialise(near.select("na", "half", F.col("x.m").alias("m"), F.col("x.w").alias("w")))
    labels, still = np.arange(nodes.count(), dtype=np.int64), 0
    for r in range(2 * rounds):
        sent = spark.sparkContext.broadcast(labels)

        def vote(batches, sent=sent):  # noqa: ANN001, ANN202
            now = sent.value
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    node, size = np.asarray(batch.column("na")), np.asarray(batch.column("m").value_lengths())
                    key = np.repeat(np.arange(len(node)), size) * len(now) + now[np.asarray(batch.column("m").flatten())]
                    key, place = np.unique(key, return_inverse=True)
                    w = np.bincount(place, np.asarray(batch.column("w").flatten()), minlength=len(key))
                    best = key[np.lexsort((key, -w, key // len(now)))]
                    row, first = np.unique(best // len(now), return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(node[row].astype(np.int64)), pa.array(best[first] % len(now))], ["n", "label"])

        got = near.where(F.col("half") == r % 2).select("na", "m", "w").mapInArrow(vote, "n long, label long").toArrow()
        node, new = np.asarray(got.column("n")), np.asarray(got.column("label"))
        moved = bool((labels[node] != new).any())
        labels = labels.copy()
        labels[node] = new
        sent.destroy()
        still = 0 if moved else still + 1
        if still == 2:
            out = spark.createDataFrame(pa.table({"n": np.arange(len(labels)), "label": labels}))
            return nodes.join(F.broadcast(out), "n").join(F.broadcast(nodes.select(F.col("n").alias("label"), F.col("node").alias("community"))), "label").select("node", "community")
    raise RuntimeError("labels did not settle")
