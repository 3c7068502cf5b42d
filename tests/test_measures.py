"""Names, related-name joins, graphs, samples, records and fits against plain Python."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions.names import compatible, extend_mentions, levels, name_similarity
from weftline.operators import measures, related
from weftline.operators.curation import label_propagation
from weftline.operators.factor import pareto_front
from weftline.operators.ranking import empty_cells
from weftline.operators.relational import dense_ids, roll_up, stable_ids
from weftline.operators.similarity import best_assignment
from weftline.sources import records


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        (("Smith", "Jan"), ("Smith", "Janet"), False),
        (("Smith", "J"), ("Smith", "Janet"), True),
        (("Smith", ""), ("Smith", "J"), True),
        (("Leon", "L"), ("Leon Mateos", "Laura"), False),
        (("Leon", "Laura"), ("Leon Mateos", "Laura"), True),
        (("Li", "Wei"), ("Liu", "Wei"), False),
        (("Müller", "Anna"), ("Mueller", "A"), True),
        (("Wei", "Zhang"), ("Zhang", "Wei"), True),
        (("Zheng", "Zheng-Hao"), ("Zheng", "Zhenghao"), True),
        (("Brown", "Andrew J E"), ("Brown", "Andrew John Ervine"), True),
        (("Park", "Miji"), ("Park", "Minjae"), False),
        (("Momi", "Elena De"), ("Demomi", "Elena"), True),
    ],
)
def test_compatible_names(a, b, same):
    assert compatible(a, b) is same and compatible(b, a) is same


def test_name_ladder():
    tiers, lineage = {"mini", "pro", "max"}, {"duckling": ("duck", 0.25)}
    sim = lambda a, b: name_similarity(a, b, tiers, {"bird"}, lineage, {"ducky": "duck"}, "ducky")
    assert levels("duck_4o_mini", tiers) == ("duck_4o", "duck")
    cases = {("duck_4", "duck_4"): 1, ("duck_4_mini", "duck_4_pro"): 0.95, ("duck_4", "duck_5"): 0.8, ("duck", "duck_4"): 0.66, ("ducky", "duck_4"): 0.5, ("duckling_2", "duck_4"): 0.25, ("duck_4", "goose_4"): 0, ("bird", "duck"): 0}
    for (a, b), want in cases.items():
        assert sim(a, b) == sim(b, a) == want, (a, b)


def test_extended_mentions():
    tokens = "the Duck 4 mini pro max and Duck , Goose 2".split()
    assert extend_mentions(tokens, "Duck|Goose", r"\d+|mini|pro|max") == [(1, 5), (7, 8), (9, 11)]
    assert extend_mentions([], "x", "y") == []


@pytest.mark.parametrize("prefix", [True, False])
def test_related_join_against_brute_force(spark, prefix):
    rng = random.Random(4)
    names = [f"{f}_{v}" for f in "abc" for v in range(4)]
    sets = {i: set(rng.sample([f"w{k}" for k in range(12)], rng.randrange(1, 4))) | set(rng.sample(names, rng.randrange(0, 4))) for i in range(60)}
    alike = lambda a, b: 0.66 if a[0] == b[0] else 0.0
    frame = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "i long, token string")
    ties = related.related_names(spark.createDataFrame([(n, n[0]) for n in names], "name string, block string"), alike)
    df = {t: sum(t in s for s in sets.values()) for s in sets.values() for t in s}
    idf = {t: math.log(60 / n) for t, n in df.items()}
    sims = {}
    for i, j in itertools.combinations(sets, 2):
        a, b = sets[i], sets[j]
        ua, ub = sorted(x for x in a - b if "_" in x), sorted(x for x in b - a if "_" in x)
        o = sum(idf[t] for t in a & b) + best_assignment([[alike(x, y) * min(idf[x], idf[y]) for y in ub] for x in ua])
        whole = sum(map(idf.get, a)) + sum(map(idf.get, b)) - o
        if whole > 0 and round(o / whole, 9) >= 0.4:
            sims[i, j] = round(o / whole, 9)
    kept = set()
    for i in sets:
        own = sorted(((s, p) for p, s in sims.items() if i in p), reverse=True)
        kept |= {p for s, p in own if s >= own[min(2, len(own)) - 1][0]}
    got = related.similar_related(frame, ties, 0.4, 2, prefix).collect()
    assert {(r.i, r.j): round(r.sim, 6) for r in got} == {p: round(sims[p], 6) for p in kept} and len(kept) > 10


def test_aligned_lists():
    same = lambda a, b: a[0] == b[0]
    assert related.align_lists(["a1", "b1", "c1"], ["a", "c"], same) == [0, None, 1]
    assert related.align_lists(["a", "b"], ["b", "a"], same) == [1, 0]
    assert related.align_lists([], ["x"], same) == [] and related.align_lists(["x"], [], same) == [None]


def test_labels_settle_and_deep_hierarchies_raise(spark):
    clique = lambda ids: [(a, b, 1.0) for a, b in itertools.combinations(ids, 2)]
    e = spark.createDataFrame([*clique(range(6)), *clique(range(10, 16)), (5, 10, 0.1)], "a long, b long, w double")
    got = {r.node: r.community for r in label_propagation(e).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(10, 16)}) == 1 and got[0] != got[10]
    chain = spark.createDataFrame([(i, i + 1) for i in range(8)], "id long, parent long")
    units = spark.range(9)
    assert {r.root for r in roll_up(units, chain, "id").collect()} == {8}
    with pytest.raises(RuntimeError):
        roll_up(units, chain, "id", max_depth=3)
    with pytest.raises(RuntimeError):
        measures.lineage(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long"), "id", "parent", 10)


def test_stable_ids_and_numbers(spark):
    new = spark.createDataFrame([(m, c) for c, ms in {"x": [1, 2, 3], "y": [4, 5], "z": [6], "w": [7]}.items() for m in ms], "m long, c string")
    old = spark.createDataFrame([(1, 2), (2, 1), (4, 1), (5, 3), (6, 3)], "m long, old long")
    got = {r.c: r.id for r in stable_ids(new, old, "m", "c", "old").collect()}
    assert got == {"x": 1, "y": 3, "w": 4, "z": 5}
    assert [r.idx for r in dense_ids(spark.range(100).repartition(7), ["id"]).orderBy("id").collect()] == list(range(100))
    assert dense_ids(spark.range(0), ["id"]).count() == 0


def test_empty_cells_are_empty_and_even(spark):
    full = {(r, c) for r in range(20) for c in range(r, 30, 3)}
    ties = spark.createDataFrame(sorted(full), "row long, col long")
    got = [(r.row, r.col) for r in empty_cells(ties, spark.range(20).withColumnRenamed("id", "row"), 30, 120, 5).collect()]
    assert len(got) == len(set(got)) and not set(got) & full and all(0 <= c < 30 for _, c in got) and 100 <= len(got) <= 140
    everything = empty_cells(ties, spark.range(20).withColumnRenamed("id", "row"), 30, 10**6, 5).collect()
    assert {(r.row, r.col) for r in everything} == {(r, c) for r in range(20) for c in range(30)} - full


def test_pareto_front_against_brute_force(spark):
    rng = random.Random(2)
    points = [(i, float(rng.randrange(30)), float(rng.randrange(30))) for i in range(200)]
    got = {r.i for r in pareto_front(spark.createDataFrame(points, "i long, x double, y double").repartition(5), "i", ["x", "y"]).collect()}
    assert got == {i for i, x, y in points if not any(u <= x and v <= y and (u < x or v < y) for _, u, v in points)}


def test_slices_match_what_goes_on(spark):
    rng = random.Random(3)
    old = [(i, i % 4) for i in range(400)]
    new = [(i, (7 - i % 4) if i % 4 < 3 and rng.random() < 0.9 else rng.randrange(3, 9)) for i in range(400)]
    got = measures.match_slices(spark.createDataFrame(old, "entity long, k int"), spark.createDataFrame(new, "entity long, k int"))
    assert {(a, b) for a, b, _ in got} >= {(0, 7), (1, 6), (2, 5)} and all(z > 5 for a, _, z in got if a < 3)
    assert measures.match_slices(spark.createDataFrame([], "entity long, k int"), spark.createDataFrame(new, "entity long, k int")) == []


def test_starts_and_logistic(spark):
    for kind in ("diagonal", "offdiagonal", "random"):
        z = np.array(measures.start_core(5, kind, 0.2, 1))
        assert np.allclose(z.sum(axis=1), 1) and (z >= 0).all()
    assert np.allclose(np.diag(measures.start_core(4, "offdiagonal", 0.2)), 0.8)
    some = measures.anchors(spark.range(1000), "id", 0.3, "s").count()
    assert 230 < some < 370
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2))
    y = rng.random(3000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))
    rows = spark.createDataFrame([(int(b), float(u), float(v)) for b, (u, v) in zip(y, x)], "y int, u double, v double")
    got = {r.name: r.coefficient for r in measures.logistic(rows, "y", ["u", "v"]).collect()}
    assert abs(got["intercept"] - 0.5) < 0.2 and abs(got["u"] - 2) < 0.3 and abs(got["v"] + 1) < 0.2


def test_null_of_a_deal(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], i % 3) for i in range(300)], "id long, v string, s int")
    got = measures.stratified_null(rows, "id", "v", ["s"], F.avg((F.col("v") == F.col("shuffled")).cast("double")), 10, "x").first()
    assert 0.4 < got["mean"] < 0.6 and got["mean"] <= got["p95"] < 0.7


def test_records(spark, tmp_path):
    jats = '<article xmlns:x="u"><contrib-group><contrib contrib-type="author"><contrib-id contrib-id-type="orcid">https://orcid.org/0000-1</contrib-id><name><surname> Ro  e </surname><given-names>A.</given-names></name><xref ref-type="aff" rid="a"/><xref ref-type="fn" rid="b"/></contrib></contrib-group><aff id="a">Uni <b>One</b></aff></article>'
    assert records.byline(jats) == [{"pos": 1, "last": "Ro e", "fore": "A.", "orcid": "0000-1", "affiliations": ["Uni One"]}]
    assert records.byline("<a><b></a>") is None and records.byline("") is None and records.byline("<a/>") == []
    t = spark.createDataFrame([("r", 1, 2, 0.5), ("r", 0, 7, 1.5), ("s", 1, 1, 2.0)], "relation string, row long, col long, value double")
    records.save_matrix(t, f"{tmp_path}/m")
    assert sorted(map(tuple, records.load_matrix(spark, f"{tmp_path}/m").select(*t.columns).collect())) == sorted(map(tuple, t.collect()))
    assert records.load_matrix(spark, f"{tmp_path}/m", "s").count() == 1
    with pytest.raises(Exception, match="exists"):
        records.save_matrix(t, f"{tmp_path}/m")
    for k in range(2):
        (tmp_path / f"00{k}.jsonl").write_text(f'{{"a": {k}}}\n')
    assert {(r.a, r.shard) for r in records.shards(spark, f"{tmp_path}/*.jsonl", schema="a int").collect()} == {(0, "000.jsonl"), (1, "001.jsonl")}
