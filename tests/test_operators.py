"""Operators against brute force and hand-made cases."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import names, trees
from weftline.functions.expressions import SECONDARY, cooccurrence
from weftline.operators import factor
from weftline.operators.aggregate import best_spelling, drop_repeated, exclusive_quantile, frobenius, keep_majority, relation_weights
from weftline.operators.graph import connected_components
from weftline.operators.ranking import draw_tie_groups, empty_cells, first_occurrence
from weftline.operators.relational import overlay, repeated_keys, roll_up, stable_ids
from weftline.operators.similarity import best_assignment, hungarian, knn_ties, similar_pairs
from weftline.scratch import attach, materialise, without


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, v) for v in r])


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (200, 200), (None, 5)]
    parent = {x: x for e in edges for x in e if x is not None and None not in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = rows(connected_components(spark.createDataFrame(edges, "src long, dst long")))
    assert got == sorted((x, find(x)) for x in parent)
    assert rows(connected_components(spark.createDataFrame([], "src long, dst long"))) == []


def test_attach_by_shuffle_with_hot_key(spark, monkeypatch):
    import weftline.scratch as scratch

    big = spark.range(6000).select(F.when(F.col("id") < 4000, 1).when(F.col("id") < 5990, F.col("id")).alias("k"), "id")
    lookup = spark.range(5500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    fast = rows(attach(big, lookup, "k"))
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 10)
    assert rows(attach(big, lookup, "k")) == fast and len(fast) == 6000
    assert without(big, lookup.select("k"), "k").count() == big.where("k is null or k >= 5500").count()


def test_similar_pairs_brute_force(spark):
    rng = random.Random(5)
    sets = {i: frozenset(rng.sample("abcdefghijkl", rng.randint(1, 6))) for i in range(40)}
    df = {t: sum(t in s for s in sets.values()) for s in sets.values() for t in s}
    idf = {t: np.log(len(sets) / n) for t, n in df.items()}
    w = {i: sum(idf[t] for t in s) for i, s in sets.items()}
    sims = {}
    for i, j in itertools.combinations(sets, 2):
        o = sum(idf[t] for t in sets[i] & sets[j])
        if o > 0 and round(o / (w[i] + w[j] - o), 9) >= 0.4:
            sims[i, j] = round(o / (w[i] + w[j] - o), 9)
    keep = set()
    for i in sets:
        near = sorted(((s, p) for p, s in sims.items() if i in p), reverse=True)
        if near:
            least = near[min(4, len(near) - 1)][0]
            keep |= {p for s, p in near if s >= least}
    got = similar_pairs(spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "i long, token string"))
    assert rows(got) == sorted((i, j, sims[i, j]) for i, j in keep)


@pytest.mark.parametrize("tau,weighted", [(0.4, True), (0.5, True), (0.6, False)])
def test_block_join_brute_force(spark, monkeypatch, tau, weighted):
    from weftline.operators import blockjoin

    monkeypatch.setattr(blockjoin, "BLOCK", 300)
    monkeypatch.setattr(blockjoin, "CELLS", 40)
    rng = random.Random(3)
    base = [rng.sample(range(60), rng.randint(1, 20)) for _ in range(12)]
    sets = {i: frozenset(x for x in base[i % 12] if rng.random() < 0.8) | {99} for i in range(120)} | {200: frozenset({99}), 201: frozenset({7, 99}), 202: frozenset({500, 501, 99})}
    mark = {i: i % 3 for i in sets}
    df = {t: sum(t in s for s in sets.values()) for s in sets.values() for t in s}
    idf = {t: float(np.log(len(sets) / n)) if weighted else 1.0 for t, n in df.items()}
    want = {}
    for i, j in itertools.combinations(sorted(sets), 2):
        o, u = sum(idf[t] for t in sets[i] & sets[j]), sum(idf[t] for t in sets[i] | sets[j])
        if abs(mark[i] - mark[j]) <= 1 and u > 0 and o > 0 and round(o / u, 9) >= tau:
            want[i, j] = round(o / u, 6)
    frame = spark.createDataFrame([(i, [f"t{x}" for x in s], mark[i]) for i, s in sets.items()], "i long, t array<string>, mark long")
    got = blockjoin.joined(frame, tau, weighted=weighted).collect()
    assert {(r.i, r.j): round(r.sim, 6) for r in got} == want and len(got) == len(want) > 50


def test_evidence_links_odd_rows_match_sql(spark, tmp_path):
    import duckdb

    from weftline.plans.relations import EVIDENCE, evidence_links

    rng = random.Random(8)
    con = duckdb.connect()
    people = [(i, f"Customer#{i % 4:02d}", rng.randint(0, 2)) for i in range(40)] + [(100 + i, f"Customer#{50 + i // 3}", rng.choice([1, 2, None])) for i in range(12)]
    people += [people[3], (7, "Customer#03", 1), (8, "Customer#01", None), (90, None, 1), (None, "Customer#01", 1)]
    orders = [(i, rng.choice([*range(40), *range(100, 112), None])) for i in range(300)]
    lines = [(rng.choice([*range(300), None]), rng.choice([*range(25), None])) for _ in range(600)]
    for name, ddl, data in (("customer", "c_custkey long, c_name string, c_nationkey int", people), ("orders", "o_orderkey long, o_custkey long", orders), ("lineitem", "l_orderkey long, l_partkey long", lines)):
        spark.createDataFrame(data, ddl).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = evidence_links(spark, str(tmp_path))
    plain = lambda found: sorted(tuple(-1 if v is None else int(v) for v in r) for r in found)
    assert plain(got.select("a", "b", "common", "places").collect()) == plain(con.execute(f"SELECT a, b, common, places FROM ({EVIDENCE})").fetchall()) and got.count() > 50


def test_labels_sent_equal_labels_joined(spark, monkeypatch):
    from weftline.operators import curation

    rng = random.Random(4)
    e = spark.createDataFrame([(f"n{a}", f"n{b}", float(rng.randint(1, 9))) for a, b in itertools.combinations(range(60), 2) if rng.random() < (0.6 if a // 12 == b // 12 else 0.03)] + [("n1", None, 2.0)], "a string, b string, w double")
    sent = rows(curation.label_propagation(e).select("node", "community"))
    monkeypatch.setattr(curation, "small_enough", lambda df: False)
    assert rows(curation.label_propagation(e).select("node", "community")) == sent and len({c for _, c in sent}) > 1


def test_works_within_author_and_year(spark):
    from weftline.operators.curation import cluster_works

    works = [(1, None, "x", 2000, "a b c d e"), (2, None, "x", 2001, "A b c, d f"), (3, None, "x", 2002, "a b c d f"), (4, None, "y", 2001, "a b c d e"), (5, "k", None, 2001, "a b c d e"), (6, "k", "z", 1990, "q"), (7, None, "x", None, "a b c d e"), (8, None, "x", 2000, "a b c g h")]
    got = {r.id: r.work for r in cluster_works(spark.createDataFrame(works, "id long, doi string, author string, year int, title string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}


def test_words_by_hash_equal_words(monkeypatch):
    import re

    import pyarrow as pa

    from weftline.functions import words

    rng = random.Random(1)
    texts = ["", "a", "ab cd ab", "x" * 9 + " " + "x" * 8 + "y " + "x" * 17, "é a é", "z9"] + ["".join(rng.choice("ab1 -é\n") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for step in (50, 1_000_000):
        monkeypatch.setattr(words, "STEP", step)
        for arr in (pa.array(texts), pa.array(["junk", *texts]).slice(1), pa.array(texts, pa.large_string())):
            named, seen = {}, 0
            for (first, n), row, h, o in words.distinct_words(arr, 3):
                for r in range(n):
                    want = frozenset(re.findall("[a-z0-9]+", texts[first + r]))
                    got = set(zip(h[row == r].tolist(), o[row == r].tolist()))
                    assert len(want) == len(got) == (row == r).sum() and named.setdefault(want, got) == got
                seen += n
            assert seen == len(texts) and len(set(map(frozenset, named.values()))) == len(named)
    keys = {}
    for t, *key in zip(texts, *words.set_keys(pa.array(texts))):
        assert keys.setdefault(frozenset(re.findall("[a-z0-9]+", t)), key) == key
    assert len(set(map(tuple, keys.values()))) == len(keys)


def test_pairs_left_out_are_nobodys_nearest(spark):
    from weftline.operators.blockjoin import near

    rng = random.Random(5)
    pairs = [(i, j, round(rng.random(), 1 if i % 2 else 9)) for i, j in itertools.combinations(range(40), 2) if rng.random() < 0.8]
    kept = [p for p, good in zip(pairs, near(*(np.array(x) for x in zip(*pairs)), 5)) if good]
    frame = lambda rows_: knn_ties(spark.createDataFrame(rows_, "i long, j long, sim double"), 5)
    assert len(kept) < len(pairs) and rows(frame(kept)) == rows(frame(pairs))


def test_components_write_no_words(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    from weftline import scratch
    from weftline.plans import measures

    rng = random.Random(6)
    made = [" ".join("%012x" % rng.getrandbits(48) for _ in range(150)) for _ in range(60)]
    docs = [(2 * i, t) for i, t in enumerate(made)] + [(2 * i + 1, t.upper() + " one more") for i, t in enumerate(made[:20])] + [(500, made[0] + "!"), (501, None), (502, "..")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(scratch, "reserve", lambda spark, n=itertools.count(): f"file://{tmp_path}/scratch/{next(n)}")
    got = measures.near_dup_components(spark, str(tmp_path)).collect()
    assert sorted((r.component, r.n, r.last) for r in got) == [(2 * i, 2, 2 * i + 1) for i in range(20)]
    written = list((tmp_path / "scratch").rglob("*.parquet"))
    assert written and not any("string" in str(f.type) for p in written for f in pq.read_schema(p))


def test_document_bags_with_odd_ids(spark):
    from weftline.plans.text import document_bags, document_sets

    plain = [(1, "b a"), (2, "A b b"), (3, "c"), (4, None), (5, "..")]
    for rows_ in (plain, [*plain, (None, "d"), (None, "a b")], [*plain, (3, "c"), (3, "C d")]):
        docs = spark.createDataFrame(rows_, "doc_id long, text string")
        bags, h = document_bags(docs)
        assert h == docs.where("text rlike '[a-zA-Z0-9]'").selectExpr("array_sort(array_distinct(regexp_extract_all(lower(text), '[a-z0-9]+', 0)))").distinct().count()
        assert {(r.i, t) for r in bags.collect() for t in r.t} == {(r.i, r.token) for r in document_sets(docs).collect()}


@pytest.mark.parametrize("n,m", [(1, 3), (3, 3), (4, 2), (5, 5)])
def test_hungarian(n, m):
    cost = np.random.default_rng(n * 10 + m).random((n, m)).tolist()
    pairs = hungarian(cost)
    small, large = sorted((n, m))
    options = (zip(range(small), p) for p in itertools.permutations(range(large), small))
    least = min(sum(cost[a][b] if n <= m else cost[b][a] for a, b in o) for o in options)
    assert len(pairs) == small and abs(sum(cost[r][c] for r, c in pairs) - least) < 1e-9
    assert abs(best_assignment([[0.2, 0.9], [0.8, 0.7]]) - 1.7) < 1e-12


def test_secondary_tie_weighs_half(spark):
    r = spark.range(1).select(cooccurrence(F.lit(1), F.lit(0), F.lit(10), F.lit(3)).alias("a"), cooccurrence(F.lit(0), F.lit(1), F.lit(10), F.lit(3)).alias("b")).first()
    assert abs(r["b"] ** 2 / r["a"] ** 2 - 0.5) < 1e-12 and 0.63 < SECONDARY < 0.64


def test_stable_ids(spark):
    new = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "B"), (5, "B"), (6, "C")], "m long, c string")
    old = spark.createDataFrame([(1, 7), (4, 7), (5, 3), (2, 9)], "m long, o long")
    assert rows(stable_ids(new, old, "m", "c", "o")) == [("A", 7), ("B", 3), ("C", 10)]


def test_roll_up_cycle_and_joint(spark):
    units = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c"), ("d", "e"), ("f", "g"), ("g", "f")], "id string, parent string")
    got = dict(rows(roll_up(units, parents, "id", 12)))
    assert got["a"] == got["b"] == got["c"] == "c" and got["d"] == "d" and got["e"] == "e"


def test_overlay_and_repeats(spark):
    base, patch = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string"), spark.createDataFrame([(2, "p")], "k long, v string")
    assert rows(overlay(base, patch, "k")) == [(1, "a"), (2, "p")]
    assert rows(repeated_keys(base, "k")) == [(2, 2)]


def test_group_rules(spark):
    r = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x"), (2, "y")], "k long, l string")
    assert rows(keep_majority(r, "k", "l")) == [(1, "x"), (1, "x")]
    assert rows(drop_repeated(r, ["k"], "l")) == [(1, None), (1, None), (1, "y"), (2, "x"), (2, "y")] or len(rows(drop_repeated(r, ["k"], "l"))) == 5
    f = spark.createDataFrame([("ab", "ab", 3), ("ab", "a_b", 3), ("ab", "AB", 1)], "g string, f string, n long")
    assert rows(best_spelling(f, "g", "f", "n")) == [("ab", "a_b")]
    q = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<double>").select(exclusive_quantile("v", 0.5).alias("m"), exclusive_quantile("v", 0.1).alias("l")).first()
    assert (q["m"], q["l"]) == (2.5, 1.0)
    t = spark.createDataFrame([(0, 1, 3.0), (1, 1, 9.0), (1, 0, 4.0)], "row long, col long, v double")
    assert frobenius(t, masked_diagonal=True) == 5.0
    assert relation_weights({"a": ["x", "y"], "b": ["z"]}) == {"x": 0.25, "y": 0.25, "z": 0.5}


def test_first_occurrence(spark):
    r = spark.createDataFrame([("s", "e", 2), ("s", "e", 1), ("s", "f", 3)], "s string, e string, u long")
    assert rows(first_occurrence(r, ["s", "e"], ["u"], "u").select("e", "u", "also_in")) == [("e", 1, [2]), ("f", 3, [])]


def test_hold_out_rules(spark):
    rng = random.Random(1)
    ties = sorted({(rng.randrange(12), rng.randrange(9)) for _ in range(60)})
    groups = draw_tie_groups(ties, 3)
    for axis in (0, 1):
        n = {}
        for t in ties:
            n[t[axis]] = n.get(t[axis], 0) + 1
        for g in range(3):
            for e, total in n.items():
                lost = sum(1 for t, h in zip(ties, groups) if t[axis] == e and h == g)
                assert lost <= (min(max(1, total // 3), total - 1) if total > 1 else 0)
    frame = spark.createDataFrame(ties, "row long, col long")
    every = rows(empty_cells(frame, spark.range(12).withColumnRenamed("id", "row"), 9, 10**6, 1))
    assert every == sorted(set(itertools.product(range(12), range(9))) - set(ties))


@pytest.mark.parametrize("beta", [1, 2])
def test_sparse_loss_equals_dense(spark, beta):
    rng = np.random.default_rng(4)
    n, m, k = 13, 11, 3
    x = rng.random((n, m)) * (rng.random((n, m)) < 0.3)
    a, z, b = rng.random((n, k)), rng.random((k, k)), rng.random((m, k))
    hidden = [(0, 0), (1, 4), (5, 5), (6, 2), (8, 8)]
    mask = np.ones((n, m))
    mask[[2, 7]] = 0
    x[[2, 7]] = 0
    for r, c in hidden:
        mask[r, c] = 0
    h = a @ z @ b.T
    cell = (x - h) ** 2 if beta == 2 else np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / h) - x, 0) + h
    fac = lambda u: spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(u)], "idx long, u array<double>")
    ties = spark.createDataFrame([(int(r), int(c), float(x[r, c])) for r, c in zip(*np.nonzero(x))], "row long, col long, v double")
    got = factor.masked_loss(ties, fac(a), fac(b), z, spark.createDataFrame(hidden, "row long, col long"), spark.createDataFrame([(2,), (7,)], "idx long"), beta=beta)
    assert abs(got - float((cell * mask).sum())) < 1e-8


def test_fit_recovers_planted_blocks():
    rng = np.random.default_rng(0)
    truth = np.repeat(np.arange(3), 12)
    x = (truth[:, None] == truth[None, :]) * (0.8 + 0.2 * rng.random((36, 36)))
    fit = factor.fit_relations({"x": ("r", "c", x, np.ones_like(x))}, 3, seed=1)
    label = fit["factors"]["r"].argmax(axis=1)
    assert fit["loss"][-1] < 0.05 and len({(a, b) for a, b in zip(truth, label)}) == 3
    again = factor.fit_relations({"x": ("r", "c", x, np.ones_like(x))}, 3, seed=2)
    s = factor.stability(fit["factors"]["r"], again["factors"]["r"])
    assert s["track_b"] > 0.9 > s["chance_b"]


def test_small_statistics():
    assert abs(factor.t_quantile(0.975, 10) - 2.228139) < 1e-5 and abs(factor.t_quantile(0.95, 3) - 2.353363) < 1e-5
    u, s, vt = factor.svd_start(np.diag([5.0, 3.0, 1.0]), 2)
    assert np.allclose(s, [5, 3], atol=1e-8)
    assert factor.choose_rank([{"k": 3, "existence": 0.5, "se": 0.01, "passes": True}, {"k": 4, "existence": 0.6, "se": 0.02, "passes": False}]) == 3
    assert abs(factor.presence(np.eye(2), np.array([1.0, 1.0]), np.array([1.0, 1.0])).sum() - 2) < 1e-12


def test_names():
    assert names.compatible(("Müller", "Jan P."), ("Mueller", "J."))
    assert not names.compatible(("Miller", "Jan"), ("Muster", "Jan"))
    assert names.fold("Łódź Straße Ø") == "lodz strasse o"
    assert names.name_key("O'Neil", "J. Mary") == "oneil|mary" and names.name_key("X", "J.") is None
    assert names.expands("LLMs", ["large", "language", "model"]) and not names.expands("abc", ["x", "y"])
    assert names.tidy_word("(learning12,13)") == "learning" and names.tidy_word("=x") is None
    assert names.greedy_groups([1, 2, 8, 9, 3], lambda a, b: abs(a - b) <= 2) == [0, 0, 1, 1, 0]
    assert names.guarded_terms("the bert model and bert street", {"bert": "bert"}, {"bert": "bert street"}, 8) == [("bert", 4, 8)]


def test_trees():
    t = trees.parse("(says/Pd (the/M man/Cc) (likes/Pd it/Ci))")
    assert trees.write(t) == "(says/Pd (the/M man/Cc) (likes/Pd it/Ci))"
    assert trees.smallest_cover(t, {"the/M", "man/Cc"}) == ["the/M", "man/Cc"]
    assert trees.replace_at(t, (1, 0), "a/M")[1][0] == "a/M" and t[1][0] == "the/M"
    clause = lambda n: isinstance(n, list) and isinstance(n[0], str) and "/P" in n[0]
    assert trees.governing(t, clause, lambda a: a == "it/Ci") == [["likes/Pd", "it/Ci"]]
    with pytest.raises(ValueError):
        trees.parse("((a)")


def test_materialise_reads_back(spark):
    assert rows(materialise(spark.createDataFrame([(1, "a")], "x long, y string"))) == [(1, "a")]


def test_continuations_fold_what_is_left_open(spark):
    from weftline.operators.ranking import continuations

    rows = [("a", 0, "said “x", True), ("a", 1, "y", False), ("a", 2, "z”", False), ("a", 3, "w", False), ("a", 5, "“", True), ("a", 7, "gap", False), ("b", 0, None, True), ("b", 1, "n", None)]
    rows += [("c", i, "“" if i == 0 else "go on", i == 0) for i in range(15)]
    df = spark.createDataFrame(rows, "g string, p int, t string, l boolean")
    got = {(r.g, r.p): r.step for r in continuations(df, "g", "p", F.col("t"), F.col("l")).collect()}
    assert got == {("a", 0): 0, ("a", 1): 1, ("a", 2): 2, ("a", 5): 0, ("b", 0): 0} | {("c", i): i for i in range(11)}
    assert continuations(df.limit(0), "g", "p", F.col("t"), F.col("l")).count() == 0
