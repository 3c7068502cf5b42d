"""Overlays, comparisons of snapshots, linking joins and hierarchies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.scratch import materialise, small_enough


def overlay(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """The patch's rows, and the base's for keys the patch does not have."""
    return patch.unionByName(base.join(patch.select(key).distinct(), key, "left_anti"))


def first_source(sources: list[DataFrame], key: str) -> DataFrame:
    """Of several ordered sources the first that has a key wins; a repeat inside a source is kept out by
    ``repeated_keys``, which callers check."""
    ranked = reduce(DataFrame.unionByName, [s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)])
    first = ranked.withColumn("__r", F.rank().over(W.partitionBy(key).orderBy("__source")))
    return first.where("__r = 1").drop("__r", "__source")


def repeated_keys(source: DataFrame, key: str) -> DataFrame:
    return source.groupBy(key).count().where("count > 1")


def compare_snapshots(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): unchanged, changed, new or dropped."""
    a, b = old.select(key, F.col(digest).alias("__a"), F.lit(1).alias("__x")), new.select(key, F.col(digest).alias("__b"), F.lit(1).alias("__y"))
    change = F.when(F.col("__x").isNull(), "new").when(F.col("__y").isNull(), "dropped").when(F.col("__a").eqNullSafe(F.col("__b")), "unchanged").otherwise("changed")
    return a.join(b, key, "full").select(key, change.alias("change"))


def route_by_items(old: DataFrame, new: DataFrame, group: str, item: str) -> DataFrame:
    """(group, route) from the items each snapshot has: new, missing, unchanged, removals_only or additions."""
    a, b = old.select(group, item).distinct().withColumn("__a", F.lit(1)), new.select(group, item).distinct().withColumn("__b", F.lit(1))
    both = a.join(b, [group, item], "full").groupBy(group).agg(F.count("__a").alias("a"), F.count("__b").alias("b"), F.count_if(F.col("__a").isNull()).alias("added"), F.count_if(F.col("__b").isNull()).alias("gone"))
    route = F.when(F.col("a") == 0, "new").when(F.col("b") == 0, "missing").when(F.col("added") > 0, "additions").when(F.col("gone") > 0, "removals_only").otherwise("unchanged")
    return both.select(group, route.alias("route"))


def only_new(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys and digest are not among those done."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def fallback_join(rows: DataFrame, lookup: DataFrame, value: str, first: tuple[str, str], second: tuple[str, str], prefer_second: Column | None = None) -> DataFrame:
    """``value`` found by the first key, else by the second; by the second where ``prefer_second`` holds."""
    a = lookup.where(F.col(first[1]).isNotNull()).groupBy(F.col(first[1]).alias(first[0])).agg(F.min(value).alias("__one"))
    b = lookup.where(F.col(second[1]).isNotNull()).groupBy(F.col(second[1]).alias(second[0])).agg(F.min(value).alias("__two"))
    out = rows.join(a, first[0], "left").join(b, second[0], "left")
    either = F.coalesce("__one", "__two")
    found = either if prefer_second is None else F.when(prefer_second, F.coalesce("__two", "__one")).otherwise(either)
    return out.withColumn(value, found).drop("__one", "__two")


def scoped_lookup(rows: DataFrame, decisions: DataFrame, scope: str, key: str, value: str) -> DataFrame:
    """A decision for the row's own scope, else for ``*other``, else the global one (null scope)."""
    own = decisions.where(F.col(scope).isNotNull() & (F.col(scope) != "*other")).groupBy(scope, key).agg(F.min(value).alias("__own"))
    other = decisions.where(F.col(scope) == "*other").groupBy(key).agg(F.min(value).alias("__other"))
    world = decisions.where(F.col(scope).isNull()).groupBy(key).agg(F.min(value).alias("__world"))
    out = rows.join(own, [scope, key], "left").join(other, key, "left").join(world, key, "left")
    return out.withColumn(value, F.coalesce("__own", "__other", "__world")).drop("__own", "__other", "__world")


def exactly_one(rows: DataFrame, candidates: DataFrame, key: str, id_col: str, candidate: str, corroborated: Column) -> DataFrame:
    """(id, status, match): linked to the one candidate of equal key that is corroborated, else ambiguous or none."""
    pairs = rows.join(candidates, key).where(corroborated)
    found = pairs.groupBy(id_col).agg(F.countDistinct(candidate).alias("n"), F.min(candidate).alias("m"))
    out = rows.select(id_col).distinct().join(found, id_col, "left")
    status = F.when(F.col("n") == 1, "linked").when(F.col("n") > 1, "ambiguous").otherwise("none")
    return out.select(id_col, status.alias("status"), F.when(F.col("n") == 1, F.col("m")).alias("match"))


def enough_evidence(n_same_name: Column, co_authors: Column, institutions: Column, many: int = 5) -> Column:
    """With ``many`` namesakes two shared co-authors and an institution are asked for; else two, or one and one."""
    strict = (co_authors >= 2) & (institutions >= 1)
    return F.when(n_same_name >= many, strict).otherwise((co_authors >= 2) | ((co_authors >= 1) & (institutions >= 1)))


def clique_pairs(members: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, group), a < b: pairs of items of one group.  Quadratic in a group by its nature: callers bound it."""
    x, y = members.alias("x"), members.alias("y")
    return x.join(y, (F.col(f"x.{group}") == F.col(f"y.{group}")) & (F.col(f"x.{item}") < F.col(f"y.{item}"))).select(F.col(f"x.{item}").alias("a"), F.col(f"y.{item}").alias("b"), F.col(f"x.{group}").alias(group))


def newman_weights(members: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b, w) of items that share groups: sum of 1 / (n_group - 1) over the groups, by the size of the union of
    both items' groups, then by the fourth root of the product of both ends' row norms."""
    rows = materialise(members.select(group, item).distinct())
    size = rows.groupBy(group).agg(F.count("*").alias("n"))
    degree = rows.groupBy(item).agg(F.count("*").alias("d"))
    pairs = clique_pairs(rows, group, item).join(size, group).groupBy("a", "b").agg(F.sum(1.0 / (F.col("n") - 1)).alias("s"), F.count("*").alias("shared"))
    pairs = pairs.join(degree.select(F.col(item).alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col(item).alias("b"), F.col("d").alias("db")), "b")
    raw = materialise(pairs.select("a", "b", (F.col("s") / (F.col("da") + F.col("db") - F.col("shared"))).alias("w")))
    both = raw.unionByName(raw.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    norm = both.groupBy("a").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("s"))
    out = raw.join(norm.select("a", F.col("s").alias("sa")), "a").join(norm.select(F.col("a").alias("b"), F.col("s").alias("sb")), "b")
    return out.select("a", "b", (F.col("w") / F.pow(F.col("sa") * F.col("sb"), 0.25)).alias("w"))


def two_hops(edges: DataFrame, largest_group: int = 200) -> DataFrame:
    """(a, b, paths, w), a < b: sum over middle nodes of w(a, m) * w(m, b), middles of ``largest_group`` ends at most
    (the bound is part of the definition).  ``edges``: end, middle, w."""
    size = edges.groupBy("middle").agg(F.countDistinct("end").alias("n")).where(F.col("n") <= largest_group).select("middle")
    kept = materialise(edges.groupBy("end", "middle").agg(F.sum("w").alias("w")).join(size, "middle", "left_semi"))
    x, y = kept.alias("x"), kept.alias("y")
    pairs = x.join(y, (F.col("x.middle") == F.col("y.middle")) & (F.col("x.end") < F.col("y.end")))
    return pairs.groupBy(F.col("x.end").alias("a"), F.col("y.end").alias("b")).agg(F.count("*").alias("paths"), F.sum(F.col("x.w") * F.col("y.w")).alias("w"))


def longest_contained(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str, value_col: str, place_col: str | None = None) -> DataFrame:
    """(id, value): the value of the longest name a text contains, if that is unique; with ``place_col`` (of both tables,
    such as a country) only names of the text's own place count.

    Names are matched from their first word (an equi-join on words of the text), so no pair is formed that does not
    share a word; ``contains`` decides.
    """
    word = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    place = (F.col(place_col) if place_col else F.lit(0)).alias("__place")
    n = names.select(F.lower(F.col(name_col)).alias("__name"), F.col(value_col).alias("__value"), F.element_at(word(F.col(name_col)), 1).alias("__w"), place).where("__w is not null").distinct()
    t = texts.select(F.col(id_col).alias("__id"), F.lower(F.col(text_col)).alias("__text"), F.explode(F.array_distinct(word(F.col(text_col)))).alias("__w"), place)
    hits = t.join(n, ["__w", "__place"]).where(F.col("__text").contains(F.col("__name"))).select("__id", "__name", "__value").distinct()
    best = hits.withColumn("__r", F.rank().over(W.partitionBy("__id").orderBy(F.desc(F.length("__name"))))).where("__r = 1")
    one = best.groupBy("__id").agg(F.countDistinct("__value").alias("n"), F.min("__value").alias("v")).where("n = 1")
    return one.select(F.col("__id").alias(id_col), F.col("v").alias(value_col))


def roll_up(units: DataFrame, parents: DataFrame, id_col: str, max_depth: int = 64) -> DataFrame:
    """(id, root): a unit follows its absorbing parents to their roots and merges only if all agree; else it stays itself,
    and so do units of a cycle and those below one.  ``parents``: id, parent (absorbing ones only; parents that are no
    units do not count).

    Units are settled from the top, a level a round: those all of whose parents are.  RuntimeError if ``max_depth`` levels
    do not settle all that can be."""
    every = materialise(units.select(F.col(id_col).alias("id")).distinct())
    links = parents.select(F.col(id_col).alias("id"), "parent").where("id <> parent").distinct().join(every.select(F.col("id").alias("parent")), "parent", "left_semi")
    links = materialise(links)
    wanted = links.groupBy("id").agg(F.count("*").alias("wanted"))
    now = materialise(every.join(links, "id", "left_anti").withColumn("root", F.col("id")))
    for _ in range(max_depth + 1):
        up = links.join(now.select(F.col("id").alias("parent"), F.col("root").alias("top")), "parent").groupBy("id").agg(F.count("*").alias("have"), F.countDistinct("top").alias("n"), F.min("top").alias("top"))
        new = up.join(wanted, "id").where("have = wanted").join(now, "id", "left_anti").select("id", F.when(F.col("n") == 1, F.col("top")).otherwise(F.col("id")).alias("root"))
        new = materialise(new)
        if new.isEmpty():
            rest = every.join(now, "id", "left_anti").withColumn("root", F.col("id"))
            return now.unionByName(rest).select(F.col("id").alias(id_col), "root")
        now = materialise(now.unionByName(new))
    raise RuntimeError("the hierarchy is deeper than max_depth")


def roll_up_by_category(units: DataFrame, parents: DataFrame, id_col: str, category: str, kind: str, absorbs: DataFrame) -> DataFrame:
    """(id, root, how): units follow those parents that may absorb them to their roots, as ``roll_up`` says.

    ``units`` has a category (what a unit is as a parent) and a kind (what it is as a child); ``absorbs`` lists
    (category, kind) that merge, a null kind standing for every child.  ``how``: itself (no parent absorbs it), merged,
    or joint (its parents' roots differ)."""
    child = units.select(F.col(id_col).alias("id"), F.col(kind).alias("kind"))
    above = units.select(F.col(id_col).alias("parent"), F.col(category).alias("category"))
    rules = absorbs.select(F.col(absorbs.columns[0]).alias("category"), F.col(absorbs.columns[1]).alias("for_kind")).distinct()
    known = parents.select(F.col(id_col).alias("id"), "parent").where("id <> parent").join(child, "id").join(above, "parent")
    taken = materialise(known.join(F.broadcast(rules) if small_enough(rules) else rules, "category").where("for_kind is null or for_kind = kind").select("id", "parent").distinct())
    roots = roll_up(units, taken.withColumnRenamed("id", id_col), id_col)
    some = taken.select(F.col("id").alias(id_col)).distinct().withColumn("__some", F.lit(True))
    how = F.when(F.col("root") != F.col(id_col), "merged").when(F.col("__some"), "joint").otherwise("itself")
    return roots.join(some, id_col, "left").select(id_col, "root", how.alias("how"))


def dense_ids(rows: DataFrame, keys: list[str], name: str = "idx") -> DataFrame:
    """``rows`` numbered from 0 in the order of ``keys``, without a global window: a range sort gives each row its
    place in its partition, and the partitions' counts give the offsets.  Keys that tie are numbered in any order."""
    sorted_rows = rows.orderBy(*[F.col(k).asc_nulls_last() for k in keys])
    placed = materialise(sorted_rows.withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    return placed.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, (place + F.col("__before")).cast("long")).drop("__at", "__part", "__before")


def stable_ids(clusters: DataFrame, old: DataFrame, member: str, cluster: str, old_id: str) -> DataFrame:
    """(cluster, id): new clusters keep old ids.  Clusters claim in order of size (then cluster); each takes its
    smallest old id that no earlier cluster took, others are numbered behind the largest old id."""
    sizes = clusters.groupBy(cluster).agg(F.count("*").alias("n"))
    claims = clusters.join(old, member).select(cluster, old_id).distinct().join(sizes, cluster)
    order = F.struct((-F.col("n")).alias("n"), F.col(cluster).alias("c"))
    left, taken, got = materialise(claims.withColumn("__order", order)), None, []
    while True:
        # a claim is settled once its cluster is the first for the id and the id the first for the cluster
        first = left.withColumn("__a", F.row_number().over(W.partitionBy(old_id).orderBy("__order"))).withColumn("__b", F.row_number().over(W.partitionBy(cluster).orderBy(old_id)))
        done = materialise(first.where("__a = 1 and __b = 1").select(cluster, old_id))
        if done.isEmpty():
            break
        got.append(done)
        left = materialise(left.join(done.select(cluster), cluster, "left_anti").join(done.select(old_id), old_id, "left_anti"))
    kept = reduce(DataFrame.unionByName, got) if got else claims.select(cluster, old_id).limit(0)
    top = old.agg(F.coalesce(F.max(old_id), F.lit(0)).alias("top"))
    fresh = dense_ids(sizes.select(cluster).join(kept.select(cluster), cluster, "left_anti"), [cluster], "r")
    fresh = fresh.crossJoin(F.broadcast(top)).select(cluster, (F.col("top") + F.col("r") + 1).alias("id"))
    return kept.select(cluster, F.col(old_id).cast("long").alias("id")).unionByName(fresh)
