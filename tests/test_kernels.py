"""Kernels against brute force and closed forms; operators that raise or choose on small tables."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import distance
from lodestrata.operators import curvature, geometry, inference, measures, trees


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()[0]


def test_least_transport_equals_enumeration():
    rng = np.random.default_rng(0)
    for n in [1, 2, 3, 4, 5] * 20:
        cost = rng.integers(0, 6, (n, n)).astype(float)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))) / n
        assert curvature.least_transport(np.full(n, 1 / n), np.full(n, 1 / n), cost) == pytest.approx(best)
    assert curvature.least_transport(np.array([0.25, 0.75]), np.array([0.5, 0.25, 0.25]), np.array([[0.0, 1, 2], [1, 0, 1]])) == pytest.approx(0.5)
    with pytest.raises(ValueError):
        curvature.least_transport(np.array([1.0]), np.array([0.5]), np.zeros((1, 1)))


def test_curvature_of_star_path_triangle(spark):
    frame = lambda pairs: spark.createDataFrame(pairs, "left string, right string")
    curves = lambda pairs, **k: {round(r.curvature, 6) for r in curvature.ollivier_curvature(frame(pairs), **k).collect()}
    assert curves([("a", "b"), ("b", "c"), ("a", "c")]) == {0.5}  # a triangle: half of the mass stays
    assert curves([("c", "x"), ("c", "y"), ("c", "z")]) == {0.0}
    assert curves([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]) == {0.0}
    assert curves([("a", "b")], idleness=0.5) == {1.0}
    with pytest.raises(ValueError):
        curvature.ollivier_curvature(frame([("a", "b")]), idleness=2)


def test_synthetic_trees():
    kinds = ("line", "star", "balanced", "comb")
    assert all(trees.hyperbolicity(trees.tree_distances(trees.synthetic_tree(k, 8))) == 0 for k in kinds) and trees.hyperbolicity(trees.grid_distances(3)) == 2
    assert trees.tree_distances(trees.synthetic_tree("comb", 6)).max() == 4


def test_subtrees_and_signatures(spark):
    df = spark.createDataFrame([(1, "def f(x):\n    return g(lambda: x)\n"), (2, "y = 1")], "program long, source string")
    nodes = trees.node_table(df, "program", "source").cache()
    roots = trees.callable_roots(nodes, "program")
    assert sorted(r.program for r in roots.collect()) == [1, 1]
    below = trees.subtrees(nodes, "program", roots)
    tops = below.where("node = 0").collect()
    assert {r.label for r in tops} == {"FunctionDef", "Lambda"} and all(r.parent is None and r.depth == 0 for r in tops)
    sizes = {r.root: r.n for r in below.groupBy("root").agg(F.count("*").alias("n")).collect()}
    assert sizes == {r.node: r.last - r.node + 1 for r in nodes.join(roots, ["program", "node"]).collect()}
    signed = trees.signatures(nodes, "program").where("program = 2").collect()
    assert len({r.signature for r in signed}) == len(signed) and min(signed, key=lambda r: r.node).signature == "Module:0"
    assert trees.leaves(nodes, "program").count() == nodes.where("node = last").count() > 0
    nodes.unpersist()


def test_ends_and_gaps(spark):
    direct, best = (one(spark, c) for c in trees.end_distances(*map(F.lit, (3, 4, 1, 2))))
    assert (direct, best) == (7, 3) and one(spark, trees.meeting_depth(F.lit(3), F.lit(4), F.lit(3))) == 2
    bag = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])
    assert one(spark, trees.counter_gap(bag({"a": 1, "b": 3}), bag({"a": 2}))) == pytest.approx(0.8)
    shape = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, trees.structural_gap(shape(10, 4), shape(5, 4), F.lit(0.5), F.lit(1.0))) == pytest.approx(0.5 * 0.25 + 0.15 + 0.2)
    pairs = spark.createDataFrame([("a", "b", 0.5, 0.4), ("a", "c", 0.4, 0.5), ("a", "a", 1.0, 1.0), ("d", "e", 0.9, 0.01), ("d", "f", 0.1, 0.02)], "anchor string, item string, similarity double, gap double")
    assert {r.anchor: r.item for r in trees.hard_negatives(pairs).collect()} == {"a": "b", "d": "f"}
    arr = lambda s: F.array(*[F.lit(c) for c in s])
    assert one(spark, trees.typed_branch(arr("abc"), arr("de"))) == "a^b^c_d_e"


def test_constant_curvature():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(5, 3)) / 4, rng.normal(size=(5, 3)) / 4
    curved = geometry.apart(x, y, 1.0)
    closed = np.arccosh(1 + 2 * ((x - y) ** 2).sum(1) / ((1 - (x**2).sum(1)) * (1 - (y**2).sum(1))))
    assert np.allclose(curved, closed) and np.allclose(geometry.apart(x, y, 1e-9), 2 * geometry.apart(x, y, 0.0), rtol=1e-4)
    assert np.linalg.norm(geometry.into_ball(np.array([5.0, 0, 0]), 4.0)) < 0.5
    way = geometry.on_geodesic(x[0], y[0], np.array([0, 0.25, 1.0]), 1.0)
    assert np.allclose(way[[0, 2]], [x[0], y[0]]) and geometry.apart(x[0], way[1], 1.0) == pytest.approx(curved[0] / 4)
    assert geometry.geodesic_hausdorff((x[0], y[0]), (y[0], x[0]), 1.0) == pytest.approx(0, abs=1e-7) and geometry.hausdorff(x, x, 1.0) == 0
    assert geometry.gromov_product(x, x, np.zeros(3), 1.0) == pytest.approx(geometry.apart(x, np.zeros(3), 1.0))
    ends = [(x[0], y[0]), (x[1], y[1])]
    turned = geometry.end_product((x[0], x[1]), (y[0], y[1]), 1.0, unoriented=True)
    assert turned <= geometry.end_product((x[0], x[1]), (y[0], y[1]), 1.0) and len(ends) == 2
    apex = np.array([0.4, 0.0])
    assert geometry.cone_energy(apex, np.array([0.8, 0.0])) == 0 and geometry.cone_energy(apex, np.array([-0.5, 0.1])) > 1


def test_products_and_batches():
    rng = np.random.default_rng(2)
    measure = lambda n: geometry.Measure(rng.normal(size=(n, 3, 2)) / 5, np.full(n, 1 / n))
    a, b = measure(4), measure(3)
    product = geometry.Product(1.0, (0.5, 1.0, 1.0), unoriented=True)
    brute = np.array([[min(sum(w * geometry.apart(p[i], q[j], 1.0) ** 2 for w, i, j in zip((0.5, 1, 1), range(3), order, strict=True)) for order in ((0, 1, 2), (0, 2, 1))) for q in b.points] for p in a.points])
    assert np.allclose(product.cost(a, b), brute)
    assert geometry.sinkhorn_divergence_of(product, a, a, 0.1) == pytest.approx(0, abs=1e-9) and geometry.sinkhorn_divergence_of(product, a, b, 0.1) > 0
    plan = product.plan(a, b, 0.1)
    assert geometry.plan_diagnostics(plan, a.mass, b.mass)["feasible"]
    rough = geometry.rounded_plans(rng.random((2, 4, 3)), np.tile(a.mass, (2, 1)), np.tile(b.mass, (2, 1)))
    assert np.allclose(rough.sum(2), a.mass) and np.allclose(rough.sum(1), b.mass)
    flat = geometry.Product(0.0, (2.0, 1.0, 1.0))
    assert np.allclose(flat.cost(a, b), geometry.concatenated_cost(a, b, (2.0, 1.0, 1.0))) and geometry.matched_weights((1.0, 2.0), (0.0, 1.0)) == (4.0, 2.0)
    w = geometry.role_weights([(a, b)])
    assert all(np.median(w[i] * geometry.apart(a.points[:, None, i], b.points[None, :, i], 0.0) ** 2) == pytest.approx(1) for i in range(3))
    for bad in ({"weights": ()}, {"weights": (1.0, -1.0)}, {"weights": (1.0, 1.0, 2.0), "unoriented": True}):
        with pytest.raises(ValueError):
            geometry.Product(**bad)
    assert np.allclose(geometry.permutation_coupling(a.mass, np.array([1, 0, 3, 2])).sum(0), a.mass) and geometry.uniform_coupling(a.mass, b.mass).sum() == pytest.approx(1)


def test_divergence_of_products(spark):
    df = spark.createDataFrame([([[0.1, 0.2, 0.0, 0.1]], [[0.1, 0.2, 0.0, 0.1]]), ([[0.1, 0.2, 0.0, 0.1]], [[-0.3, 0.2, 0.4, 0.1], [0.0, 0.0, 0.1, 0.1]]), (None, [[0.0, 0.0, 0.0, 0.0]])], "x array<array<double>>, y array<array<double>>")
    same, other, none = (r[0] for r in df.select(geometry.divergence(F.col("x"), F.col("y"), 2, 1.0, 0.1)).collect())
    assert same == pytest.approx(0, abs=1e-9) and other > 0.05 and none is None


def test_inference_kernels(spark):
    beacon = bytes(range(64)).hex()
    assert inference.derived_seed(beacon, "d") == int.from_bytes(hashlib.sha256(bytes(range(64)) + b"d").digest()[:8], "big") % (2**63 - 1)
    with pytest.raises(ValueError):
        inference.derived_seed("00", "d")
    low, high = inference.exact_bootstrap([1.0, 2.0, 4.0])
    assert 1 <= low < 2 < high <= 4
    with pytest.raises(ValueError):
        inference.exact_bootstrap([1.0] * 7)
    x, y = np.array([1.0, 2, 2, 3]), np.array([4.0, 5, 6, 7])
    assert inference.spearman_of(x, y) == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [1, 2, 3, 4])[0, 1]) and inference.spearman_of(x, x * 0) == 0
    rows = spark.createDataFrame([("a", float(i), float(i * i), i) for i in range(12)] + [("b", 1.0, 2.0, 0), ("b", 2.0, 1.0, 1)], "g string, x double, y double, k long")
    got = {r.g: r for r in inference.spearman_study(rows, ["g"], "x", "y", "k", iterations=200).collect()}
    assert got["a"].rho == pytest.approx(1) and got["a"].p_value < 0.02 and got["a"].low <= 1 and got["b"].p_value == 1 and got["b"].key_min is None
    power = inference.shift_power(np.random.default_rng(0).normal(size=200), 25, 4000, 1, [0.0, 0.5], [1.0, 2.0])
    assert power.power[0] == pytest.approx(0.025, abs=0.005) and power.power[1] > 0.6 > power.power[3] and (power.seen_90 > power.seen_80).all()
    with pytest.raises(ValueError):
        inference.shift_power(np.zeros(1), 2, 100, 0, [0.0], [1.0])


def test_fixed_sequence(spark):
    frame = lambda ok: spark.createDataFrame([(ok,)], "success boolean")
    got = inference.fixed_sequence([("one", frame(True)), ("two", frame(False)), ("three", frame(True))]).orderBy("step").collect()
    assert [(r.reached, r.success) for r in got] == [(True, True), (True, False), (False, False)]


def test_measures_that_raise(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (1, "b", 3.0)], "seed long, task string, score double")
    with pytest.raises(ValueError, match="b"):
        measures.averaged_over(rows, "seed", "task", "score")
    whole = rows.union(spark.createDataFrame([(2, "b", 5.0)], rows.schema))
    assert {r.task: r.score for r in measures.averaged_over(whole, "seed", "task", "score", [1, 2]).collect()} == {"a": 1.5, "b": 4.0}
    with pytest.raises(ValueError):
        measures.averaged_over(whole, "seed", "task", "score", [1, 2, 3])
    with pytest.raises(ValueError):
        measures.paired_differences(whole.where("seed = 1"), whole.where("seed = 2 AND task = 'a'"), "task", "score")
    with pytest.raises(ValueError):
        measures.selected(whole, "task", "score", "seed", "score", "other")
    single = spark.createDataFrame([(7,)], "k long")
    assert [tuple(r) for r in measures.first_pairs(single, "k", 5).collect()] == [(7, 7)]


def test_kinds_and_grids(spark):
    names = {'{"feature_set_results": 1}': "confirmatory_feature_sweep", '{"feature_set_results": 1, "protocol": {"status": "residual run"}}': "confirmatory_residual_sweep", '{"methods": {}}': "method_comparison", '{"profile": 1}': "file_tree_smoke_test", "{}": "unknown", '{"results": [], "methods": 1}': "weight_sweep"}
    df = spark.createDataFrame([(k,) for k in names], "j string")
    got = df.select("j", measures.experiment_kind(F.lit("x.json"), F.parse_json("j")).alias("kind")).collect()
    assert {r.j: r.kind for r in got} == names
    grid = measures.weight_grid(spark, ["lca", "token", "ast"], [0.0, 0.5, 0.5], [[1.0, 0.0], [0.5, 0.5], [1.0, 0.0]]).collect()
    assert len(grid) == 4 and all(math.isclose(sum(r.weights.values()), 1) for r in grid)
