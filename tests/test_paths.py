"""Paths of trees, batched transport, controls and views against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata import index
from lodestrata.operators import batched, controls, curvature, geometry, graphs, ordered, paths, trees, transport

PROGRAMS = {
    "f": "def f(a, b=1):\n    for x in a:\n        if x: return [x, b, (1, 2)]\n    return None\n",
    "g": "class A:\n    def __init__(self, q):\n        self.q = {1: q, 2: [q, q]}\n",
    "h": "x = y = 3\nprint(x * y + 2)\n",
    "bad": "def (:\n",
    "none": None,
    "empty": "",
}


def all_pairs(nodes):
    leaves = [(n["node"], n["ancestors"]) for n in nodes if n["last"] == n["node"]]
    return trees.leaf_pairs(leaves, 10**9, "preorder_first")


def test_python_nodes_are_typed():
    nodes = trees.python_nodes("def f(a, *b):\n    return a\n")
    by = {(n["label"], n["edge"], n["place"]) for n in nodes}
    assert ("Module", "root", 0) in by and ("FunctionDef", "body", 0) in by and ("arguments", "args", 0) in by and ("arg", "vararg", 0) in by and ("Return", "body", 0) in by
    assert [n["token"] for n in nodes if n["edge"] == "id"] == ["a"] and [(n["name"], n["span"]) for n in nodes if n["label"] == "FunctionDef"] == [("f", "1:0")]
    places = [n["place"] for n in trees.python_nodes("a\nb\nc\n") if n["edge"] == "body"]
    assert places == [0, 1, 2] and trees.parse_failure("def (") == "SyntaxError" and trees.parse_failure("x") is None


def test_affine_pairs_visit_all_once():
    for source in ("f", "g", "h"):
        nodes = trees.python_nodes(PROGRAMS[source])
        whole = all_pairs(nodes)
        got = paths.affine_pairs(nodes, None)
        assert len(got) == len(set(got)) == len(whole) and set(got) == set(whole)
        assert paths.affine_pairs(nodes, 7) == got[:7] and paths.affine_pairs(nodes, 0) == [] and paths.affine_pairs(nodes, 10**6) == got
        depths = sorted({d for *_, d in whole})
        assert [d for *_, d in got[: len(depths)]] == depths  # depths take turns
        assert paths.affine_pairs(nodes, 20, "other salt") != got[:20]
    renamed = trees.python_nodes(PROGRAMS["h"].replace("x", "zeta").replace("3", "'text'"))
    assert paths.affine_pairs(renamed, 9) == paths.affine_pairs(trees.python_nodes(PROGRAMS["h"]), 9)  # values tell nothing


def test_affine_pairs_of_a_wide_tree_are_never_listed():
    star = [{"node": i, "parent": None if i == 0 else 0, "depth": int(i > 0), "label": "x", "last": 100_000 if i == 0 else i} for i in range(100_001)]
    got = paths.affine_pairs(star, 64)
    assert len({p[:2] for p in got}) == 64 and all(i < j and a == 0 for i, j, a, _ in got)
    assert max(j for _, j, _, _ in got) > 50_000  # from all over the tree


def test_sampled_paths_equal_the_kernel(spark):
    """The same draw from node tables by joins, in many ranges, and by itself for each tree."""
    rows = spark.createDataFrame([(k, v) for k, v in PROGRAMS.items()], "program string, source string")
    nodes = trees.node_table(rows, "program", "source").cache()
    for most in (5, 400):
        got = {}
        for r in paths.sampled_paths(nodes, "program", most, label="label").orderBy("program", "path_index").collect():
            got.setdefault(r.program, []).append((r.start, r.end, r.lca, r.lca_depth))
            assert r.path_index == len(got[r.program]) - 1
        for name in ("f", "g", "h"):
            assert got[name] == paths.affine_pairs(trees.python_nodes(PROGRAMS[name]), most)
        assert set(got) == {"f", "g", "h"}
    by_policy = trees.terminal_paths(rows, "program", "source", 5).where("program = 'g'").orderBy("path_index").collect()
    assert [(r.start, r.end, r.lca, r.lca_depth) for r in by_policy] == paths.affine_pairs(trees.python_nodes(PROGRAMS["g"]), 5)


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9)) for i in range(500)]
    rng.shuffle(rows)
    got = ordered.running(spark.createDataFrame(rows, "k long, v int"), ["k"], {"before": F.col("v"), "n": F.lit(1)}, range_rows=40).collect()
    sums = dict(zip(range(500), itertools.accumulate([0, *[v for _, v in sorted(rows)]]), strict=False))
    assert {r.k: (int(r.before), int(r.n)) for r in got} == {k: (sums[k], k) for k in range(500)}


def edges_of(nodes, i, j, a):
    up = lambda n: {m for m in nodes[n]["ancestors"] if nodes[m]["depth"] > nodes[a]["depth"]}
    return up(i) | up(j)


def test_path_relations_equal_brute_force(spark):
    nodes = trees.python_nodes(PROGRAMS["f"])
    drawn = paths.affine_pairs(nodes, 40)
    steps = lambda n: nodes[n]["ancestors"][1:]
    rows = spark.createDataFrame([("t", k, steps(i), steps(j), d) for k, (i, j, _, d) in enumerate(drawn)], "tree string, path_index int, start array<int>, end array<int>, lca_depth int")
    apart = lambda x, y: len(set(steps(x)) ^ set(steps(y)))
    got = paths.path_relations(rows, "tree").collect()
    assert len(got) == 40 * 39 // 2
    for r in got:
        (i, j, a, d), (k, l, b, e) = drawn[r.left], drawn[r.right]  # noqa: E741
        x, y = edges_of(nodes, i, j, a), edges_of(nodes, k, l, b)
        assert r.edge_difference == len(x ^ y) and r.edge_jaccard == pytest.approx(1 - len(x & y) / len(x | y))
        assert r.oriented == apart(i, k) + apart(j, l) and r.unoriented == min(r.oriented, apart(i, l) + apart(j, k))
        assert r.lca_depth_difference == abs(d - e) and r.length_difference == abs(len(x) - len(y)) and (r.left_length, r.right_length) == (len(x), len(y))
        assert r.anchored == pytest.approx(math.sqrt(apart(a, b) ** 2 + min(apart(i, k) ** 2 + apart(j, l) ** 2, apart(i, l) ** 2 + apart(j, k) ** 2)))


def test_order_relations_equal_brute_force(spark):
    nodes = trees.python_nodes(PROGRAMS["h"])
    df = trees.node_table(spark.createDataFrame([("h", PROGRAMS["h"])], "program string, source string"), "program", "source")
    got = {(r.left, r.right): (r.label, r.distance, r.direct) for r in paths.order_relations(df, "program", incomparable=True).collect()}
    want = {}
    for x, y in itertools.combinations(nodes, 2):
        above = x["node"] in y["ancestors"]
        want[x["node"], y["node"]] = (int(above), len(set(x["ancestors"]) ^ set(y["ancestors"])), y["parent"] == x["node"])
    assert got == want
    direct = paths.order_relations(df, "program", direct_only=True).collect()
    assert {(r.left, r.right) for r in direct} == {(n["parent"], n["node"]) for n in nodes if n["parent"] is not None}


def test_audit_of_programs(spark):
    rows = spark.createDataFrame(list(PROGRAMS.items()), "program string, source string")
    got = {r.program: r for r in paths.program_audit(rows, "program", "source", 16).collect()}
    for name in ("f", "g", "h"):
        nodes = trees.python_nodes(PROGRAMS[name])
        drawn, r = paths.affine_pairs(nodes, 16), got[name]
        assert r.ok and r.failure is None and r.nodes == len(nodes) and r.pairs == len(all_pairs(nodes)) and r.paths == 16 and sum(r.depths.values()) == 16
        assert r.ends == str(sum(int(hashlib.sha256(f"{i}|{j}".encode()).hexdigest()[:15], 16) for i, j, *_ in reversed(drawn)))
        way = {n["node"]: tuple(nodes[a]["label"] for a in n["ancestors"]) for n in nodes}
        assert r.node_rate == pytest.approx(1 - len(set(way.values())) / len(nodes))
        met = {a for _, _, a, _ in drawn}
        assert r.lca_rate == pytest.approx(1 - len({way[a] for a in met}) / len(met))
        assert r.path_rate == pytest.approx(1 - len({(way[a], *sorted((way[i], way[j]))) for i, j, a, _ in drawn}) / 16)
    assert (got["bad"].ok, got["bad"].failure, got["none"].failure, got["empty"].failure) == (False, "SyntaxError", "no source", "fewer than two leaves")


def test_identifiability_summary(spark):
    rows = [("a", 10, 8, 4, 4, 6, 3, 0.2, 0.0, 0.5), ("b", 30, 30, 2, 1, 2, 2, 0.0, 0.5, 0.0)]
    got = {r.rate: r for r in paths.identifiability_summary(spark.createDataFrame(rows, ["t", *paths.COUNTS, "node_rate", "lca_rate", "path_rate"])).collect()}
    assert got["node"].micro == pytest.approx(2 / 40) and got["path"].macro == pytest.approx(0.25) and got["lca"].q100 == 0.5 and got["lca"].q025 == pytest.approx(0.125)


# Transport


def some_measures(count, seed, product):
    rng = np.random.default_rng(seed)
    return [geometry.Measure(rng.normal(size=(n, len(product.weights), 2)) / 4, np.full(n, 1 / n)) for n in rng.integers(1, 9, count)]


@pytest.mark.parametrize("product", [geometry.Product(1.0, (0.5, 1.0, 1.0), unoriented=True), geometry.Product(0.0, (1.0, 2.0)), geometry.Product((0.0, 1.0, 0.3), (1.0, 1.0, 0.2))])
def test_batches_equal_single_problems(product):
    left, right = some_measures(30, 1, product), some_measures(30, 2, product)
    cost = batched.costs(product, left, right)
    got = batched.objectives(product, left, right, 0.2)
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        n, m = len(x.mass), len(y.mass)
        assert np.allclose(cost[i, :n, :m], product.cost(x, y), atol=1e-12) and not cost[i, n:].any() and not cost[i, :, m:].any()
        plan = transport.sinkhorn_plan(product.cost(x, y), x.mass, y.mass, 0.2, 3000, 1e-13)
        assert got[i] == pytest.approx(transport.entropic_objective(plan, product.cost(x, y), x.mass, y.mass, 0.2), abs=1e-9)
    masses = np.stack([np.pad(x.mass, (0, 9 - len(x.mass))) for x in left])
    with pytest.raises(ValueError):
        batched.sinkhorn_plans(np.zeros((30, 9, 9)), masses, masses * 2, 0.1)
    plans = batched.sinkhorn_plans(np.random.default_rng(0).random((30, 9, 9)), masses, masses[::-1].copy(), 0.05)
    assert np.allclose(plans.sum(2), masses) and np.allclose(plans.sum(1), masses[::-1]) and (plans[masses == 0] == 0).all()


def test_divergences_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(batched, "BLOCK", 7)
    product = geometry.Product(1.0, (1.0, 1.0, 1.0), unoriented=True)
    own = some_measures(25, 3, product)
    rows = spark.createDataFrame([(i, m.points.reshape(len(m.points), -1).tolist()) for i, m in enumerate(own)] + [(99, []), (98, None)], "id long, points array<array<double>>")
    got = {(r["query"], r["item"]): r.distance for r in batched.divergences(rows.where("id % 5 = 0"), rows, product, 0.3).collect()}
    assert len(got) == 5 * 25
    for (q, i), d in got.items():
        assert d == pytest.approx(geometry.sinkhorn_divergence_of(product, own[q], own[i], 0.3), abs=1e-7)
    near = batched.divergences(rows.where("id = 5"), rows, product, 0.3, 4).orderBy("rank").collect()
    order = sorted((round(got[5, i], 9), i) for i in range(25))[:4]
    assert [r["item"] for r in near] == [i for _, i in order] and near[0]["item"] == 5


def gap(x, y, p):
    return sum((x[i, k] - y[j, l]) ** 2 * p[i, j] * p[k, l] for i, j, k, l in itertools.product(range(len(x)), range(len(y)), range(len(x)), range(len(y))))


def test_fused_transport():
    rng = np.random.default_rng(4)
    x = trees.tree_distances([None, 0, 0, 1, 1, 2, 5]).astype(float)
    order = rng.permutation(7)
    y = x[np.ix_(order, order)]
    mass = np.full(7, 1 / 7)
    feature = (np.arange(7)[:, None] != order[None]).astype(float)
    got = transport.fused_gromov_wasserstein(x, y, mass, mass, feature, 0.5, 0.05)
    assert got.objective == pytest.approx(0, abs=1e-6) and got.residual < 1e-9  # the same tree in another order
    plain = transport.fused_gromov_wasserstein(x, y, mass, mass, alpha=1.0, epsilon=0.2)
    assert plain.structure == pytest.approx(0, abs=1e-4)
    z = rng.random((5, 5))
    z = (z + z.T) * (1 - np.eye(5))
    found = transport.fused_gromov_wasserstein(x, z, mass, np.full(5, 0.2), rng.random((7, 5)), 0.7, 0.05)
    assert all(b <= a + 1e-12 for a, b in itertools.pairwise(found.history)) and len(found.history) > 2
    assert found.structure == pytest.approx(gap(x, z, found.plan)) and np.allclose(found.plan.sum(0), 0.2) and np.allclose(found.plan.sum(1), mass)
    for bad in ({"a": mass * 2}, {"features": np.zeros((2, 2))}, {"alpha": 1.5}, {"start": np.eye(7)}, {"epsilon": 0.0}):
        with pytest.raises(ValueError):
            transport.fused_gromov_wasserstein(**({"left": x, "right": y, "a": mass, "b": mass} | bad))


def test_spaces_of_paths(spark):
    relations = spark.createDataFrame([("t", 0, 1, 2.0, 4.0), ("t", 0, 2, 1.0, 0.0), ("t", 1, 2, 4.0, 1.0)], "tree string, left int, right int, u double, v double")
    tokens = spark.createDataFrame([("t", i, [f"x{i}", "y"]) for i in range(3)] + [("s", 0, ["z"])], "tree string, path_index int, tokens array<string>")
    got = {r.tree: r.space for r in batched.path_spaces(relations, tokens, "tree", ("u", "v")).collect()}
    assert np.allclose(got["t"].d, [[0, 0.75, 0.125], [0.75, 0, 0.625], [0.125, 0.625, 0]]) and got["t"].tokens[2] == ["x2", "y"] and got["s"].d == [[0.0]]


def test_index_answers_many_programs(spark):
    rows = spark.createDataFrame([(k, v) for k, v in PROGRAMS.items()], "id string, source string")
    built = index.ProgramIndex.build(rows, "id", "source")
    many = built.nearest(rows, "id", "source", 2).collect()
    assert {r["query"] for r in many} == {"f", "g", "h"} and all(r["item"] == r["query"] and r.distance < 1e-9 for r in many if r["rank"] == 1)
    for name in ("f", "g"):
        one = built.search(PROGRAMS[name], 2).collect()
        assert [(r.id, round(r.distance, 8)) for r in one] == [(r["item"], round(r.distance, 8)) for r in sorted((r for r in many if r["query"] == name), key=lambda r: r["rank"])]


# Controls and views


def test_controls(spark):
    rng = random.Random(3)
    for trial in range(3):
        groups = {i: rng.choice("abcde") for i in range(60)}
        rows = spark.createDataFrame(list(groups.items()), "id long, g string")
        got = {r.id: r.image for r in controls.derangement(rows, "id", "g", f"k{trial}").collect()}
        assert sorted(got) == sorted(got.values()) == list(range(60)) and all(groups[i] != groups[j] for i, j in got.items())
        beside = {r.id: r.image for r in controls.shuffled_within(rows, "id", "g", "k").collect()}
        assert sorted(beside.values()) == list(range(60)) and all(groups[i] == groups[j] and i != j for i, j in beside.items())
    with pytest.raises(ValueError):
        controls.derangement(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, g string"), "id", "g", "k")
    alone = controls.shuffled_within(spark.createDataFrame([(1, "a")], "id long, g string"), "id", "g", "k").first()
    assert alone.image is None


def test_anchors(spark):
    nodes = trees.node_table(spark.createDataFrame([("f", PROGRAMS["f"])], "program string, source string"), "program", "source").cache()
    depth = {n["node"]: n["depth"] for n in trees.python_nodes(PROGRAMS["f"])}
    objects = spark.createDataFrame([("f", k, a) for k, (_, _, a, _) in enumerate(paths.affine_pairs(trees.python_nodes(PROGRAMS["f"]), 30))], "program string, path_index int, lca int")
    got = controls.anchors(objects, nodes, "program", "same_depth").collect()
    assert len(got) == 30
    for r in got:
        alone = sum(d == depth[r.lca] for d in depth.values()) == 1
        assert (r.anchor is None) == alone and (alone or (depth[r.anchor] == depth[r.lca] and r.anchor != r.lca))
    assert {r.anchor for r in controls.anchors(objects, nodes, "program", "root").collect()} == {0} and {r.anchor for r in controls.anchors(objects, nodes, "program", "zero").collect()} == {None}
    with pytest.raises(ValueError):
        controls.anchors(objects, nodes, "program", "other")


def test_weight_choice(spark):
    grid = [(1.0, 0.0), (0.0, 1.0), (0.5, 0.5)]
    ranks = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 1), (2, 1), (2, 1)], "choice int, rank int")
    chosen = lambda **k: [r.choice for r in controls.weight_choice(ranks, grid, **k).collect() if r.chosen]
    assert chosen() == [1] and chosen(guard=0) == [2] and chosen(guard=0, margin=0.0) == [1] and chosen(guard=1, margin=0.3) == [0]


def test_context_features_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(r, k, [rng.choice("ab") for _ in range(rng.randint(0, 5))]) for r in ("u", "v", "w") for k in range({"u": 25, "v": 2, "w": 1}[r])]
    got = {(x.record, x.id): x for x in paths.context_features(spark.createDataFrame(rows, "record string, id int, parts array<string>"), "record", "id", "parts").collect()}
    assert len(got) == len(rows)
    for r, k, p in rows:
        others = [q for s, j, q in rows if s == r and j != k]
        longest = max(1, *(len(q) for s, _, q in rows if s == r), 1)
        shared = [next((i for i, (x, y) in enumerate(zip(p, q, strict=False)) if x != y), min(len(p), len(q))) for q in others]
        far = [len(p) + len(q) - 2 * s for q, s in zip(others, shared, strict=True)]
        x = got[r, k]
        assert x.length == pytest.approx(len(p) / longest)
        assert (x.mean_distance, x.max_distance, x.mean_shared) == pytest.approx((np.mean(far) / (2 * longest), max(far) / (2 * longest), np.mean(shared) / longest) if others else (0, 0, 0))


# Curvature and profiles


def test_curvature_on_and_off_cycles_equals_full_transport(spark):
    rng = random.Random(2)
    pairs = {(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 6), (6, 3)} | {(rng.randrange(i), i) for i in range(7, 30)}
    near = {i: set() for i in range(30)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    far = np.full((30, 30), 99.0)
    for s in range(30):
        front, far[s, s], d = {s}, 0, 0
        while front:
            d += 1
            front = {y for x in front for y in near[x] if far[s, y] == 99}
            for y in front:
                far[s, y] = d
    for idle in (0.0, 0.3):
        got = {(r.left, r.right): r.curvature for r in curvature.ollivier_curvature(spark.createDataFrame(sorted(pairs), "left long, right long"), idle).collect()}
        assert got.keys() == pairs
        for (a, b), c in got.items():
            mass = [np.array([idle if i == x else (1 - idle) / len(near[x]) if i in near[x] else 0.0 for i in range(30)]) for x in (a, b)]
            assert c == pytest.approx(1 - curvature.least_transport(*mass, far))


def test_curvature_of_a_wide_star(spark):
    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("left"), F.col("id").alias("right"))
    got = curvature.ollivier_curvature(star).agg(F.count("*").alias("n"), F.max(F.abs("curvature")).alias("most")).first()
    assert got.n == 100_000 and got.most == pytest.approx(0, abs=1e-9)


def tree_of(names):
    nodes = sorted({"/".join(p.split("/")[:i]) for p in names for i in range(len(p.split("/")) + 1)})
    return [(n, n.rpartition("/")[0] if n else None, len(n.split("/")) if n else 0, n.split("/") if n else []) for n in nodes]


def test_profiles_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(curvature, "NODES_A_BLOCK", 5)
    from lodestrata.functions.distance import path_point

    names = {"t": ["a/b", "a/c/d", "a/c", "src/x/y", "z"], "s": ["q"], "o": [""]}
    rows = [(t, *r) for t, own in names.items() for r in tree_of(own)]
    df = spark.createDataFrame(rows, "tree string, node string, parent string, depth int, parts array<string>")
    point = {(r.tree, r.node): r.p for r in df.select("tree", "node", path_point(F.col("parts")).alias("p")).collect()}
    got = {r.tree: r for r in curvature.profiles(df, "tree").collect()}
    assert set(got) == {"t", "s", "o"}
    for t in names:
        own = [r for r in rows if r[0] == t]
        d = np.array([[len(a[4]) + len(b[4]) - 2 * next((i for i, (x, y) in enumerate(zip(a[4], b[4], strict=False)) if x != y), min(len(a[4]), len(b[4]))) for b in own] for a in own], float)
        x = np.array([point[t, r[1]] for r in own])
        flat = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        room = 1 - (x * x).sum(1)
        curved = np.arccosh(1 + 2 * flat**2 / (room[:, None] * room[None]))
        assert got[t].diameter == d.max() and got[t].edges == len(own) - 1 and got[t].nodes == len(own)
        if len(own) > 1:
            assert got[t].flat_stress == pytest.approx(trees.normalized_stress(d, flat)[1]) and got[t].hyperbolic_stress == pytest.approx(trees.normalized_stress(d, curved)[1])
    for kind in ("length", "size", "branching", "distortion", "all"):
        columns = curvature.profiles(df, "tree").select(*curvature.profile_features(kind)).columns
        assert len(columns) == len(set(columns)) == {"length": 2, "size": 4, "branching": 4, "distortion": 3, "all": 11}[kind]


def test_entry_with_the_subpackage_hidden():
    """Without the training-data subpackage the rest imports and registers its queries."""
    code = "import sys\nsys.modules['lodestrata.llm'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'pipeline' not in q and not any(k.startswith('op1') for k in q) and len(q) > 100 and set(e.oracle_sql()) <= set(q)\n"
    from pathlib import Path

    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1]).returncode == 0


def test_hyperbolicity_of_trees_and_others(spark):
    rows = [("t", []), ("t", ["a"]), ("t", ["a", "b"]), ("t", ["c"]), ("one", []), ("gap", []), ("gap", ["a", "b"])]
    got = curvature.tree_hyperbolicity(spark.createDataFrame(rows, "host string, parts array<string>"), "host").collect()
    assert {r.host: r.hyperbolicity for r in got} == {"t": 0.0, "one": 0.0, "gap": None}


def test_balls_of_a_forest(spark):
    edges = spark.createDataFrame([("r", str(i)) for i in range(30)] + [("3", "3a"), ("3a", "3b"), ("3b", "3c"), ("x", "y")], "left string, right string")
    plain = lambda df: sorted((r.node, r.radius, r["size"]) for r in df.collect())
    assert plain(graphs.forest_ball_sizes(edges, (1, 2, 3))) == plain(graphs.ball_sizes(edges, (1, 2, 3)))


def test_pairs_of_a_large_group_are_work_of_many_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lodestrata.operators import trees

    monkeypatch.setattr(trees, "GROUP_ROWS", 16)
    rows = spark.createDataFrame([("a", f"{i:03d}", i) for i in range(200)] + [("b", "x", 1), ("c", "y", 2), ("c", "z", 3)], "g string, n string, v long")
    pairs = trees.pairs_of_groups(rows, "g", ("l", "lv"), ("r", "rv"))
    got = [(r.g, r.l, r.r, r.lv, r.rv) for r in pairs.collect()]
    assert sorted(got) == [("a", f"{i:03d}", f"{j:03d}", i, j) for i in range(200) for j in range(i + 1, 200)] + [("c", "y", "z", 2, 3)]
    assert pairs.where("g = 'a'").groupBy(F.spark_partition_id().alias("p")).count().count() >= 4


def test_leaf_meetings_compare_each_level_once(spark, tmp_path, monkeypatch):
    from lodestrata.plans import catalog, structures

    paths = ["a/b/c", "a/b/d/e", "a/x", "z", "a/b/d/f", "q/b/d/e", "a/xy", ""]
    rows = [(f"http://{h}/{p}",) for h in ("h1", "h2") for p in paths if h == "h1" or p < "b"]
    spark.createDataFrame(rows, "url string").write.parquet(f"{tmp_path}/pages.parquet")
    want = set()
    for h in ("h1", "h2"):
        own = [p.split("/") for p in paths if p and (h == "h1" or p < "b")]
        for x in own:
            for y in own:
                n = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
                if "/".join(x) < "/".join(y):
                    want.add((h, "/".join(x), "/".join(y), "/".join(x[:n]), len(x) + len(y) - 2 * n, float(n)))
    for levels in (24, 2):
        monkeypatch.setattr(structures, "LEVELS", levels)
        found = catalog.QUERIES["leaf_meetings"](spark, str(tmp_path))
        assert {tuple(r) for r in found.collect()} == want
        assert ("zip_with" in found._jdf.queryExecution().optimizedPlan().toString()) == (levels == 2)
