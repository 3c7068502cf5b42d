"""Shares, partitions of graphs, weighted memberships, selection rules and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftline.operators.ranking import average_rank
from weftline.scratch import materialise


def side_ties(scored: DataFrame, k: int, tau: float) -> DataFrame:
    """(i, j, sim): for each side on its own its k best partners of ``tau`` or more, ties with the kth included.
    ``scored``: i, j, sim, each pair once."""
    both = scored.unionByName(scored.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim")).where(F.col("sim") >= tau)
    return both.withColumn("__r", F.rank().over(W.partitionBy("i").orderBy(F.desc("sim")))).where(F.col("__r") <= k).drop("__r")


def weighted_persistence(old: DataFrame, new: DataFrame, by: list[str], entity: str, weights: dict[str, Column]) -> DataFrame:
    """For each weight the share of the new slice's weight whose entities the old slice has, by ``by``.

    ``weights`` name columns over the new slice's rows, which are distinct entities."""
    known = old.select(*by, entity).distinct().withColumn("__old", F.lit(1.0))
    rows = new.join(known, [*by, entity], "left").withColumn("__p", F.coalesce("__old", F.lit(0.0)))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[(F.sum(w * F.col("__p")) / F.sum(w)).alias(name) for name, w in weights.items()])


def share_table(rows: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Rows and the share of each condition by group; a null condition does not count as a case."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c.cast("double")).alias(name) for name, c in conditions.items()])


def eligible(rows: DataFrame, key: str, needed: list[DataFrame], void: list[DataFrame], condition: Column | None = None) -> DataFrame:
    """Rows that hold ``condition`` and whose key is in every table of ``needed`` and in none of ``void``."""
    out = rows if condition is None else rows.where(condition)
    for d in needed:
        out = out.join(d.select(key).distinct(), key, "left_semi")
    for d in void:
        out = out.join(d.select(key).distinct(), key, "left_anti")
    return out


def tag_ladder(tags: str, rules: list[tuple[list[str], str]], otherwise: str) -> Column:
    """The class of the first rule any of whose tags is in the array."""
    out = F.lit(otherwise)
    for wanted, name in reversed(rules):
        out = F.when(F.arrays_overlap(F.col(tags), F.array(*map(F.lit, wanted))), name).otherwise(out)
    return out


def disclosure(text: Column, formula: str, negated: str, statement: str, author: str, research: str) -> Column:
    """Sentences that disclose the use of something: a set phrase, its denial, or a statement by the authors that does
    not describe their research."""
    return text.rlike(formula) | text.rlike(negated) | (text.rlike(statement) & text.rlike(author) & ~text.rlike(research))


def strict_disclosure(text: Column, formula: str, negated: str, opening: str) -> Column:
    """The narrower rule for sentences of texts that are kept: a set phrase or its denial behind an opening."""
    return (text.rlike(formula) | text.rlike(negated)) & text.rlike(opening)


def mapped_names(rows: DataFrame, name: str, scope: str, canon: DataFrame, by_scope: DataFrame, void: DataFrame) -> DataFrame:
    """``name`` by the general map (name, canonical) after the scope's own (scope, name, canonical); rows whose (scope,
    name) is void are dropped."""
    own = by_scope.select(F.col(scope), F.col(name), F.col("canonical").alias("__own"))
    out = rows.join(void.select(scope, name).distinct(), [scope, name], "left_anti").join(own, [scope, name], "left")
    out = out.withColumn(name, F.coalesce("__own", name)).drop("__own").join(canon.select(F.col(name), F.col("canonical").alias("__c")), name, "left")
    return out.withColumn(name, F.coalesce("__c", name)).drop("__c")


def unlisted_name(token: Column, family: str, suffix: str, tools: str, excluded: str, glued: str) -> Column:
    """Class of a token that holds a family name: tool, excluded, glued (a citation stuck to it) or name; null for
    others.  ``suffix`` is cut first."""
    base = F.regexp_replace(token, suffix, "")
    return F.when(~base.rlike(family), None).when(base.rlike(tools), "tool").when(base.rlike(excluded), "excluded").when(base.rlike(glued), "glued").otherwise("name")


def first_n(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows by their keys (test runs)."""
    return rows.orderBy(*keys).limit(n)


def lineage(parents: DataFrame, node: str, parent: str, max_depth: int = 64) -> DataFrame:
    """(node, ancestors, top): the way up from each node, nearest first; RuntimeError in a cycle."""
    up = parents.select(F.col(node).alias("at"), F.col(parent).alias("__up")).where("__up is not null and at <> __up")
    now = materialise(parents.select(F.col(node).alias(node)).distinct().withColumn("at", F.col(node)).withColumn("ancestors", F.array().cast(f"array<{dict(parents.dtypes)[parent]}>")))
    for _ in range(max_depth):
        step = now.join(up, "at", "left")
        step = materialise(step.select(node, F.coalesce("__up", "at").alias("at"), F.when(F.col("__up").isNotNull(), F.concat("ancestors", F.array("__up"))).otherwise(F.col("ancestors")).alias("ancestors"), F.col("__up").isNotNull().alias("moved")))
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now.select(node, "ancestors", F.coalesce(F.try_element_at("ancestors", F.lit(-1)), F.col(node)).alias("top"))
    raise RuntimeError("the hierarchy has a cycle or is deeper than max_depth")


def hops(edges: DataFrame, sources: DataFrame, max_hops: int = 100) -> DataFrame:
    """(node, hops) from the nearest of ``sources`` (node) along undirected edges (a, b); a frontier a round."""
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = [materialise(sources.select("node").distinct().withColumn("hops", F.lit(0)))]
    for k in range(1, max_hops + 1):
        known = reduce(DataFrame.unionByName, seen).select("node")
        new = both.join(seen[-1].select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct().join(known, "node", "left_anti")
        new = materialise(new.withColumn("hops", F.lit(k)))
        if new.isEmpty():
            break
        seen.append(new)
    return reduce(DataFrame.unionByName, seen)


def partition_scores(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(community, inside, cut, volume, conductance) of a partition; ``edges``: a, b, w once a pair."""
    m = [membership.select(F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in ("a", "b")]
    e = edges.join(m[0], "a").join(m[1], "b")
    same = F.col("ca") == F.col("cb")
    ends = e.select(F.col("ca").alias("community"), "w", same.alias("same")).unionByName(e.select(F.col("cb").alias("community"), "w", same.alias("same")))
    got = ends.groupBy("community").agg((F.sum(F.when(F.col("same"), F.col("w")).otherwise(0.0)) / 2).alias("inside"), F.sum(F.when(~F.col("same"), F.col("w")).otherwise(0.0)).alias("cut"), F.sum("w").alias("volume"))
    whole = ends.agg(F.sum("w").alias("__all"))
    least = F.least("volume", F.col("__all") - F.col("volume"))
    return got.crossJoin(F.broadcast(whole)).select("community", "inside", "cut", "volume", F.when(least > 0, F.col("cut") / least).alias("conductance"))


def total_loss(losses: DataFrame, weights: dict[str, float], relation: str = "relation", loss: str = "loss") -> DataFrame:
    """One row: the sum of the relations' losses by weight; a relation without a weight is an error."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(relation)]
    checked = F.when(w.isNull(), F.raise_error(F.concat(F.lit("no weight for "), F.col(relation)))).otherwise(w)
    return losses.agg(F.sum(checked * F.col(loss)).alias("total"))


def gram(memberships: DataFrame, by: list[str]) -> DataFrame:
    """(by, k, l, g): products of columns of a membership table (by, entity, k, u), summed over entities.  An entity has
    at most as many rows as there are communities, so the join stays that factor of its input."""
    a = memberships.select(*by, "entity", "k", "u")
    b = memberships.select(*by, "entity", F.col("k").alias("l"), F.col("u").alias("v"))
    return a.join(b, [*by, "entity"]).groupBy(*by, "k", "l").agg(F.sum(F.col("u") * F.col("v")).alias("g"))


def column_weights(memberships: DataFrame, cores: DataFrame, cutoff: float = 1e-3) -> DataFrame:
    """(facet, k, w): w is the root of the sum, over the relations that touch the facet, of Z G Z' at k, with G the Gram
    matrix of the other side; a column below ``cutoff`` times the facet's largest counts as 0.

    ``memberships``: facet, entity, k, u; ``cores``: relation, rows, cols (facets), k, l, z."""
    g = materialise(gram(memberships, ["facet"]))
    out = cores.select("relation", F.col("rows").alias("facet"), F.col("cols").alias("other"), "k", "l", "z")
    back = cores.select("relation", F.col("cols").alias("facet"), F.col("rows").alias("other"), F.col("l").alias("k"), F.col("k").alias("l"), "z")
    z = materialise(out.unionByName(back))
    right = z.select("relation", "facet", "other", "k", F.col("l").alias("m"), F.col("z").alias("z2"))
    quad = z.join(right, ["relation", "facet", "other", "k"]).join(g.select(F.col("facet").alias("other"), F.col("k").alias("l"), F.col("l").alias("m"), "g"), ["other", "l", "m"])
    w = quad.groupBy("facet", "k").agg(F.sqrt(F.greatest(F.sum(F.col("z") * F.col("g") * F.col("z2")), F.lit(0.0))).alias("w"))
    most = F.max("w").over(W.partitionBy("facet"))
    return w.select("facet", "k", F.when(F.col("w") < cutoff * most, 0.0).otherwise(F.col("w")).alias("w"))


def weighted_memberships(memberships: DataFrame, weights: DataFrame) -> DataFrame:
    """(facet, entity, k, p): memberships by column weight, as shares of the entity's sum; entities without any stay out."""
    p = memberships.join(weights, ["facet", "k"]).withColumn("p", F.col("u") * F.col("w"))
    whole = F.sum("p").over(W.partitionBy("facet", "entity"))
    return p.withColumn("__s", whole).where("__s > 0").select("facet", "entity", "k", (F.col("p") / F.col("__s")).alias("p"))


def mono_flags(presence: DataFrame, unit: str, part: str, share: str, low: float = 0.1, high: float = 0.5) -> DataFrame:
    """(unit, mono): the one part in which a unit's presence is ``high`` or more while it is below ``low`` in all others;
    null if there is none."""
    c = presence.groupBy(unit).agg(F.count("*").alias("n"), F.count_if(F.col(share) >= high).alias("h"), F.count_if(F.col(share) < low).alias("l"), F.max(F.when(F.col(share) >= high, F.col(part))).alias("m"))
    return c.select(unit, F.when((F.col("h") == 1) & (F.col("l") == F.col("n") - 1), F.col("m")).alias("mono"))


def empty_columns(weights: DataFrame, ties: DataFrame, relation: str, column: str, weight: str, value: str, point: float) -> DataFrame:
    """(relation, column) whose tie weight is below the relation's quantile ``point`` of tie values."""
    least = ties.groupBy(relation).agg(F.expr(f"percentile({value}, {point})").alias("__least"))
    return weights.join(F.broadcast(least), relation).where(F.col(weight) < F.col("__least")).select(relation, column)


def cumulative_shares(rows: DataFrame, group: str) -> DataFrame:
    """(group, n, pairs, share, upto): group sizes, ordered pairs inside, share of all rows, and the cumulative share from
    the largest group on (ties by group).  The window runs over the table of groups."""
    n = rows.groupBy(group).agg(F.count("*").alias("n"))
    whole = rows.agg(F.count("*").alias("__all"))
    order = W.orderBy(F.desc("n"), group)
    out = n.withColumn("__upto", F.sum("n").over(order)).crossJoin(F.broadcast(whole))
    return out.select(group, "n", (F.col("n") * (F.col("n") - 1)).alias("pairs"), (F.col("n") / F.col("__all")).alias("share"), (F.col("__upto") / F.col("__all")).alias("upto"))


def typed_forms(rows: DataFrame, unit: str, form: str, bare: Column) -> DataFrame:
    """One row: distinct forms, distinct bare forms, and pairs of units that share one, before and after the merge."""

    def pairs(d: DataFrame, key: str) -> DataFrame:
        a, b = d.select(unit, key).distinct().alias("a"), d.select(unit, key).distinct().alias("b")
        met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{unit}") < F.col(f"b.{unit}")))
        return met.select(F.col(f"a.{unit}").alias("x"), F.col(f"b.{unit}").alias("y")).distinct()

    d = materialise(rows.select(unit, form, bare.alias("__bare")).distinct())
    counts = d.agg(F.countDistinct(form).alias("forms"), F.countDistinct("__bare").alias("bare"))
    before, after = pairs(d, form).agg(F.count("*").alias("pairs_before")), pairs(d.where("__bare <> ''"), "__bare").agg(F.count("*").alias("pairs_after"))
    return counts.crossJoin(before).crossJoin(after)


def equivalence(a: DataFrame, b: DataFrame, key: str, seed: str, value: str, most: float = 1.0) -> DataFrame:
    """(key, difference, noise, ratio, alike): the difference of two implementations' medians over seeds against the
    median difference between seeds of the first; alike if it is at most ``most`` times that."""
    med = lambda d, name: d.groupBy(key).agg(F.expr(f"percentile({value}, 0.5)").alias(name))
    x, y = a.alias("x"), a.alias("y")
    apart = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col(f"x.{seed}") < F.col(f"y.{seed}")))
    noise = apart.select(F.col(f"x.{key}").alias(key), F.abs(F.col(f"x.{value}") - F.col(f"y.{value}")).alias("d")).groupBy(key).agg(F.expr("percentile(d, 0.5)").alias("noise"))
    out = med(a, "__a").join(med(b, "__b"), key).join(noise, key).withColumn("difference", F.abs(F.col("__a") - F.col("__b")))
    ratio = F.when(F.col("noise") > 0, F.col("difference") / F.col("noise"))
    return out.select(key, "difference", "noise", ratio.alias("ratio"), F.coalesce(ratio <= most, F.col("difference") == 0).alias("alike"))


def select_models(fits: DataFrame, size: str, ok: Column, above: list[Column], volume: str, distance: str) -> DataFrame:
    """(size, volume, seeds): of the sizes all of whose fits are ok and above chance, the one of the largest mean volume
    (then the smallest size), and its fit nearest to the ideal."""
    every = ok
    for c in above:
        every = every & c
    good = fits.groupBy(size).agg(F.bool_and(F.coalesce(every, F.lit(False))).alias("__ok"), F.avg(volume).alias("volume"), F.count("*").alias("fits"), F.min(distance).alias("nearest")).where("__ok")
    return good.orderBy(F.desc("volume"), size).limit(1).select(size, "volume", "fits", "nearest")


def broken_references(texts: DataFrame, key: str, text: str, pattern: str, targets: DataFrame, target: str) -> DataFrame:
    """(key, ref, n): references that ``pattern`` (one group) finds in the texts and no target answers."""
    found = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("ref")).groupBy(key, "ref").agg(F.count("*").alias("n"))
    return found.join(targets.select(F.col(target).alias("ref")).distinct(), "ref", "left_anti").select(key, "ref", "n")


def audit(rows: DataFrame, by: list[str], text: str, patterns: dict[str, str]) -> DataFrame:
    """Rows and, for each named pattern, rows that match it and matches in all."""
    cols = []
    for name, p in patterns.items():
        cols += [F.count_if(F.col(text).rlike(p)).alias(f"{name}_rows"), F.sum(F.coalesce(F.regexp_count(F.col(text), F.lit(p)), F.lit(0))).cast("long").alias(f"{name}_hits")]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *cols)


def shard_report(rows: DataFrame, keys: list[str], shards: int, digest: Column) -> DataFrame:
    """(shard, n, digest): rows dealt by their place in key order, each shard's count and sum of digests; a merge is whole
    if the shards' reports add up to the report of the whole."""
    from weftline.operators.relational import dense_ids

    placed = dense_ids(rows.withColumn("__d", digest), keys, "__place")
    return placed.groupBy((F.col("__place") % shards).cast("int").alias("shard")).agg(F.count("*").alias("n"), F.sum("__d").alias("digest"))


def partial_spearman_of(rows: DataFrame, by: list[str], x: str, y: str, covariates: list[str]) -> DataFrame:
    """Spearman of x and y with the ranks of any number of covariates taken out, by the recursion of partial
    correlations: all pairwise correlations come from one aggregate."""
    names = [x, y, *covariates]
    ranked = rows
    for i, c in enumerate(names):
        ranked = ranked.withColumn(f"__{i}", average_rank(F.col(c), by))
    n = len(names)
    r = ranked.groupBy(*by).agg(*[F.corr(f"__{i}", f"__{j}").alias(f"r{i}_{j}") for i in range(n) for j in range(i + 1, n)])

    def part(i: int, j: int, given: int) -> Column:
        """Correlation of i and j given the last ``given`` of the covariates."""
        i, j = min(i, j), max(i, j)
        if not given:
            return F.col(f"r{i}_{j}")
        z = n - given
        a, b, c = part(i, j, given - 1), part(i, z, given - 1), part(j, z, given - 1)
        return (a - b * c) / F.sqrt((1 - b * b) * (1 - c * c))

    return r.select(*by, part(0, 1, len(covariates)).alias("rho"))


def stratified_null(rows: DataFrame, key: str, value: str, strata: list[str], statistic: Column, replicates: int, seed: str, by: list[str] | None = None) -> DataFrame:
    """(by, mean, p95): a statistic (an aggregate over columns ``value`` and ``shuffled``) under ``replicates`` deals of
    ``value`` inside strata, each in a portable random order of its own."""
    by = by or []
    w = W.partitionBy("__rep", *strata)
    many = rows.withColumn("__rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    placed = many.withColumn("__i", F.row_number().over(w.orderBy(key)))
    dealt = many.withColumn("__i", F.row_number().over(w.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}|"), F.col("__rep").cast("string"))), key))).select("__rep", *strata, "__i", F.col(value).alias("shuffled"))
    per = placed.join(dealt, ["__rep", *strata, "__i"]).groupBy("__rep", *by).agg(statistic.alias("__s"))
    return per.groupBy(*by).agg(F.avg("__s").alias("mean"), F.expr("percentile(__s, 0.95)").alias("p95"))




def symbols(text: Column) -> Column:
    """Symbols that a sentence introduces: where x is, let x be, here x denotes, x and y denote."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)\b(?:where|let|here|and)\s+([a-zA-Z][a-zA-Z0-9_]{0,2})\s+(?:is|be|are|denotes?|represents?)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def baseline_measures(ties: DataFrame) -> DataFrame:
    """(row, coverage, accuracy): how much of a row's mass the degree-only model (row total times column share) covers, and
    how much of what it predicts at the row's ties is there.  ``ties``: row, col, v."""
    whole = ties.agg(F.sum("v").alias("__all"))
    r, c = ties.groupBy("row").agg(F.sum("v").alias("__r")), ties.groupBy("col").agg(F.sum("v").alias("__c"))
    t = ties.join(r, "row").join(c, "col").crossJoin(F.broadcast(whole)).withColumn("x", F.col("__r") * F.col("__c") / F.col("__all"))
    met = F.sum(F.least("v", "x"))
    return t.groupBy("row").agg((met / F.sum("v")).alias("coverage"), (met / F.sum("x")).alias("accuracy"))


def community_penalties(places: DataFrame, presence: DataFrame) -> DataFrame:
    """One row: ``collapse`` (share of entities whose largest membership is the commonest one), ``effective`` (effective
    number of communities by those) and ``imbalance`` (half the summed difference of two domains' shares).

    ``places``: entity, k, p; ``presence``: domain (two values), k, p as shares of the domain."""
    first = places.groupBy("entity").agg(F.max(F.struct("p", (-F.col("k")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    share = F.col("n") / F.col("__all")
    one = first.crossJoin(F.broadcast(first.agg(F.sum("n").alias("__all")))).agg(F.max(share).alias("collapse"), F.exp(-F.sum(share * F.log(share))).alias("effective"))
    gap = presence.groupBy("k").agg(F.abs(F.max(F.struct("domain", "p"))["p"] - F.when(F.count("*") > 1, F.min(F.struct("domain", "p"))["p"]).otherwise(0.0)).alias("d"))
    return one.crossJoin(gap.agg((F.sum("d") / 2).alias("imbalance")))


def match_slices(old: DataFrame, new: DataFrame, replicates: int = 20, seed: str = "slices", level: float = 0.95) -> list[tuple[int, int, float]]:
    """(old k, new k, z) of the communities of two slices that go on: overlaps of entities as z-scores against deals of the
    new communities over its entities, the best one-to-one matching of these, and of it the pairs above the
    ``level`` quantile of matched z-scores of the deals.

    ``old``, ``new``: entity, k.  Counts are aggregates; only K x K tables reach the driver."""
    import numpy as np

    from weftline.operators.similarity import hungarian

    w = W.partitionBy("__rep")
    many = new.withColumn("__rep", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    # the deal of number 0 leaves all as it is; entities are spread over hash blocks, so no deal is one task's work
    block = F.pmod(F.xxhash64("entity"), F.lit(64))
    w = W.partitionBy("__rep", "__block")
    many = many.withColumn("__block", block)
    order = F.when(F.col("__rep") == 0, F.lit("")).otherwise(F.md5(F.concat_ws("|", F.lit(seed), F.col("__rep").cast("string"), F.col("entity").cast("string"))))
    a = many.withColumn("__i", F.row_number().over(w.orderBy("entity"))).select("__rep", "__block", "__i", "entity")
    b = many.withColumn("__i", F.row_number().over(w.orderBy(order, "entity"))).select("__rep", "__block", "__i", F.col("k").alias("l"))
    dealt = a.join(b, ["__rep", "__block", "__i"])
    got = dealt.join(old.select("entity", "k"), "entity").groupBy("__rep", "k", "l").agg(F.count("*").alias("n")).collect()
    ks, ls = sorted({r["k"] for r in got}), sorted({r["l"] for r in got})
    if not ks:
        return []
    n = np.zeros((replicates + 1, len(ks), len(ls)))
    for r in got:
        n[r["__rep"], ks.index(r["k"]), ls.index(r["l"])] = r["n"]
    mean, sd = n[1:].mean(axis=0), n[1:].std(axis=0) + 1e-9
    z = (n - mean) / np.maximum(sd, 0.5)
    matched = lambda m: hungarian([[-x for x in row] for row in m.tolist()])
    null = [m[i, j] for m in z[1:] for i, j in matched(m)]
    least = float(np.quantile(null, level))
    return [(ks[i], ls[j], float(z[0, i, j])) for i, j in matched(z[0]) if z[0, i, j] > least]


def start_core(k: int, kind: str, level: float = 0.1, seed: int = 0) -> list[list[float]]:
    """A k x k core to start a fit from: ``diagonal`` links, the same with ``level`` of the mass off the diagonal, or
    ``random``; rows sum to 1."""
    import numpy as np

    if kind == "random":
        z = np.random.default_rng(seed).random((k, k)) + 1e-7
    elif kind == "diagonal" or k == 1:
        z = np.eye(k)
    elif kind == "offdiagonal":
        z = np.full((k, k), level / (k - 1))
        np.fill_diagonal(z, 1 - level)
    else:
        raise ValueError(kind)
    return (z / z.sum(axis=1, keepdims=True)).tolist()


def anchors(ties: DataFrame, key: str, share: float, seed: str) -> DataFrame:
    """The ties of a share of the entities, drawn by hash: what a start is computed from."""
    u = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return ties.where(u < share)


def logistic(rows: DataFrame, label: str, features: list[str], reg: float = 0.0) -> DataFrame:
    """(name, coefficient) of a logistic regression, the intercept first; distributed by the ML library."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(rows.select(F.col(label).cast("double").alias("__y"), *features))
    fit = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=reg, maxIter=100, tol=1e-9).fit(ready)
    return rows.sparkSession.createDataFrame([("intercept", float(fit.intercept)), *((f, float(c)) for f, c in zip(features, fit.coefficients))], "name string, coefficient double")
