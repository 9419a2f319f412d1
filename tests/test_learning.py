"""Means in curved space, admission by state, and models learnt from sums, against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import geometry, graphs, learn, paths, riemann, trees
from lodestrata.streaming import admission, events


def test_maps_of_the_ball():
    rng = np.random.default_rng(0)
    for c in (0.0, 0.4, 1.0):
        x, y, z = (rng.normal(size=(20, 3)) / 5 for _ in range(3))
        v = riemann.log_map(x, y, c)
        assert np.allclose(riemann.exp_map(x, v, c), y)
        m = riemann.midpoint(x, y, c)
        assert np.allclose(geometry.apart(x, m, c), geometry.apart(x, y, c) / 2) and np.allclose(geometry.apart(m, y, c), geometry.apart(x, y, c) / 2)
        moved = riemann.transported(x, y, riemann.log_map(x, z, c), c)
        size = lambda p, t: np.linalg.norm(t, axis=1) * (2 / (1 - c * (p * p).sum(1)) if c else 1)  # noqa: B023, E731
        assert np.allclose(size(y, moved), size(x, riemann.log_map(x, z, c)), rtol=1e-5)  # lengths stay
        assert np.allclose(riemann.transported(x, y, v, c), -riemann.log_map(y, x, c), rtol=1e-5)  # and so does the way itself
        if c:
            assert np.allclose(riemann.lowered(riemann.lifted(x, c), c), x)
            assert np.allclose(riemann.lorentz_distance(riemann.lifted(x, c), riemann.lifted(y, c), c), geometry.apart(x, y, c))
            assert np.allclose(geometry.apart(np.zeros_like(x), riemann.scaled(0.5, x, c), c), geometry.apart(np.zeros_like(x), x, c) / 2)


def test_frechet_means(spark):
    rng = np.random.default_rng(1)
    groups = {g: rng.normal(size=(n, 3)) * s + np.array(m) for g, n, s, m in (("a", 40, 0.1, (0.3, 0, 0)), ("b", 1, 0.1, (0, 0.2, 0)), ("c", 25, 0.25, (0, 0, 0)))}
    groups = {g: x / np.maximum(1, 1.2 * np.linalg.norm(x, axis=1, keepdims=True)) for g, x in groups.items()}
    rows = spark.createDataFrame([(g, p.tolist()) for g, x in groups.items() for p in x] + [(None, [0.1, 0.1, 0.1]), ("a", None)], "g string, p array<double>")
    for c in (0.0, 1.0):
        got = {r.g: r for r in riemann.frechet_means(rows.repartition(5), "g", "p", c).collect()}
        assert set(got) == {"a", "b", "c"}
        for g, x in groups.items():
            m = np.array(got[g].mean)
            spread = lambda p: (geometry.apart(x, p[None], c) ** 2).mean()  # noqa: B023, E731
            assert got[g].n == len(x) and got[g].gradient < 1e-6 and got[g].spread == pytest.approx(spread(m))
            assert all(spread(m) <= spread(m + d) + 1e-12 for d in np.concatenate([np.eye(3), -np.eye(3)]) * 1e-3)
            if not c:
                assert np.allclose(m, x.mean(0))


def test_admission_stream_equals_order(spark, tmp_path):
    """One file a batch, in order of ids: the stream turns away what a table in that order would, copies and near copies."""
    rng = random.Random(7)
    base = [[f"w{rng.randrange(4000)}" for _ in range(40)] for _ in range(12)]
    sets = []
    for i in range(60):
        items = list(base[rng.randrange(12)]) if i % 3 else [f"n{i}x{j}" for j in range(30)]
        if i % 4 == 1:
            items[rng.randrange(len(items))] = f"new{i}"
        sets.append((i, items if i % 17 else []))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", admission.STORE)
    try:
        for k in range(4):
            spark.createDataFrame(sets[15 * k : 15 * k + 15], "id long, items array<string>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        table = spark.createDataFrame(sets, "id long, items array<string>")
        stream = events.parquet_stream(spark, str(tmp_path / "in"), table.schema, 1)
        events.run_to_table(admission.matches(stream, 0.8, 16, 4), "matched", str(tmp_path / "state"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    found = {(r.id, r.earlier): r.similarity for r in spark.table("matched").collect()}
    same = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    similar = {(j, i) for (i, a), (j, b) in itertools.combinations(sets, 2) if a and b and same(a, b) >= 0.8}
    assert set(found) <= similar and all(s == pytest.approx(same(sets[i][1], sets[j][1])) for (i, j), s in found.items())
    kept = {r.id for r in admission.admitted(table, spark.table("matched")).collect()}
    assert kept == {i for i, _ in sets} - {j for j, _ in similar}
    assert {r.id for r in admission.admitted_in_order(table, 0.8, 16, 4).collect()} == kept and 0 in kept


def test_distance_student(spark):
    rng = np.random.default_rng(2)
    x = rng.random((400, 3))
    y = 2 * x[:, 0] + 0.5 * x[:, 1] - 3 * x[:, 2] + rng.normal(size=400) * 0.05
    rows = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(400)] + [(999, None, 1.0, 1.0, 1.0)], "id int, a double, b double, c double, t double")
    for parts in (1, 7):
        weights, predict = learn.distance_student(rows.repartition(parts), ["a", "b", "c"], "t", F.col("id") % 2 == 0, 1e-3)
        z = (x[::2] - x[::2].mean(0)) / x[::2].std(0)
        t = (y[::2] - y[::2].mean()) / y[::2].std()
        value = lambda w: ((z @ w - t) ** 2).mean() + 1e-3 * (w**2).sum()  # noqa: B023, E731
        w = np.array([weights[k] for k in "abc"])
        assert w[2] == 0 and (w >= 0).all()  # what lessens the distance has no weight
        assert all(value(w) <= value(np.maximum(w + d, 0)) + 1e-12 for d in np.concatenate([np.eye(3), -np.eye(3)]) * 1e-3)
        assert learn.errors(predict(rows.where("id % 2 = 1 AND id < 400")), "t").first().n == 200
    with pytest.raises(ValueError):
        learn.distance_student(rows.limit(1), ["a"], "t", F.lit(True))


def test_slopes_are_slopes():
    rng = np.random.default_rng(3)
    a, b = (rng.normal(size=(30, 3)) / 6 for _ in range(2))
    label = np.arange(30) % 2
    ga, gb = learn.slopes(label, a, b)
    d = rng.normal(size=(30, 3)) * 1e-6
    assert np.allclose(learn.loss(label, a + d, b - d) - learn.loss(label, a, b), (ga * d).sum(1) - (gb * d).sum(1), atol=1e-9)


def test_order_probe_learns(spark):
    source = "\n".join(f"def f{i}(a, b):\n    if a:\n        return [a, b, {i}]\n    return g(b)\n" for i in range(2))
    nodes = trees.node_table(spark.createDataFrame([("p", source)], "program string, source string"), "program", "source").cache()
    records = graphs.cut(learn.order_split(paths.order_relations(nodes, "program", incomparable=True), "program"))
    judged = records.where("NOT train")
    before = learn.order_scores(learn.order_energies(judged, learn.first_points(nodes, "program", 4, "order"), "program")).first()
    points = graphs.cut(learn.train_order(records.where("train"), nodes, "program", epochs=12))
    after = learn.order_scores(learn.order_energies(judged, points, "program")).first()
    assert after.auc > max(before.auc + 0.03, 0.85) and after.positive_energy < after.negative_energy
    again = {r.node: r.point for r in learn.train_order(records.where("train").repartition(6), nodes.repartition(5), "program", epochs=12).collect()}
    assert all(np.allclose(r.point, again[r.node], atol=1e-6) for r in points.collect())
    energies = [(r.energy, r.label) for r in learn.order_energies(judged, points, "program").collect()]
    wins = np.mean([(q > p) + 0.5 * (q == p) for p, x in energies if x == 1 for q, z in energies if z == 0])
    assert after.auc == pytest.approx(wins)


def test_resampling_deals_rows_into_tasks(spark, monkeypatch):
    from lodestrata.operators import controls

    written = []
    whole = controls.cut
    monkeypatch.setattr(controls, "cut", lambda df: written.append(df) or whole(df))
    rows = spark.createDataFrame([(i % 5, float(i * 7 % 31), float(i)) for i in range(200)], "c int, x double, y double").coalesce(1)
    plain = controls.spearman_bootstrap(rows, "c", "x", "y", 10, "s").first()
    monkeypatch.setattr(controls, "TASK_ROWS", 100)
    dealt = controls.spearman_bootstrap(rows, "c", "x", "y", 10, "s").first()
    assert dealt.clusters == 5 and (dealt.low, dealt.high) == pytest.approx((plain.low, plain.high)) and dealt.low < dealt.high
    before, after = (df._jdf.queryExecution().optimizedPlan().toString() for df in written[-2:])
    assert "RepartitionByExpression [c" in after and ", 21" in after  # 200 rows, ten times, a hundred a task
    assert "sum(w" not in after  # no task sums all replicates of its rows


def test_order_probe_by_blocks_equals_rows(spark, tmp_path, monkeypatch):
    """The query learns and judges in tasks what the rows of all pairs give, also where trees fall into many blocks and energies take turns."""
    from lodestrata.operators import probe
    from lodestrata.plans import structures

    rng = random.Random(5)
    urls = [f"http://h{i % 3}.org/" + "/".join(f"{'xyz'[d % 3]}{rng.randrange(3 + 2 * d)}" for d in range(rng.randrange(1, 6))) for i in range(120)]
    spark.createDataFrame([(i, u) for i, u in enumerate([*urls, "http://alone.org/", None])], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    nodes = graphs.cut(structures.host_nodes(spark, str(tmp_path)).withColumn("ancestors", F.concat(F.array(F.lit("")), F.col("parts"))))
    records = graphs.cut(learn.order_split(paths.order_relations(nodes, "host", incomparable=True), "host"))
    learnt = graphs.cut(learn.train_order(records.where("train"), nodes, "host", epochs=8))
    want = learn.order_scores(learn.order_energies(records.where("NOT train"), learnt, "host")).first()
    assert want.n > 1000 and 0.5 < want.auc < 1 and records.where("NOT train AND label = 1").count() > 100

    def refuse(*_, **__):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(paths, "order_relations", refuse)
    monkeypatch.setattr(probe, "LEAST", 8)
    monkeypatch.setattr(probe, "HELD", 50)
    size, tasks = probe.layout(nodes, "host")
    assert size == 8
    bits = probe.halves(nodes, "host", size, tasks, "split")
    points = graphs.cut(probe.train(nodes, bits, "host", size, tasks, 4, 8, "order"))
    there = {(r.host, r.node): r.point for r in learnt.collect()}
    assert all(np.allclose(r.point, there[r.host, r.node], atol=1e-9) for r in points.collect()) and points.count() == len(there)
    got = probe.scores(points, bits, "host", size, tasks, 4).first()
    assert got.n == want.n and got.auc == pytest.approx(want.auc, abs=1e-9)
    assert (got.positive_energy, got.negative_energy) == pytest.approx((want.positive_energy, want.negative_energy), abs=1e-9)
    row = structures.host_order_probe(spark, str(tmp_path)).first()
    assert (row.n, row.auc) == (want.n, round(want.auc, 4))
    none = probe.order_probe(nodes.where("host = ''"), "host", epochs=1).first()
    assert none.n == 0 and none.auc is None


def test_only_pairs_whose_loss_slopes_are_left():
    from lodestrata.operators import probe

    rng = np.random.default_rng(6)
    for scale in (0.3, 0.6, 0.99):
        a, p = (x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(learn.INNER, scale, (90, 1)) for x in (rng.normal(size=(90, 4)) for _ in range(2)))
        p[:20] = a[:20] * 1.0001
        i, j = (x.ravel() for x in np.indices((90, 90)))
        ga, gb = learn.slopes(np.zeros(8100, int), a[i], p[j])
        some = np.zeros((90, 90), bool)
        some[probe.sloping(a, p, np.ones((90, 90), bool))] = True
        assert not ga[~some.ravel()].any() and not gb[~some.ravel()].any() and some.mean() < 0.7
        assert np.allclose(probe.energies(a[20:], p[20:], np.ones((70, 70), bool)).reshape(70, 70), geometry.cone_energy(a[20:, None], p[None, 20:]), atol=1e-7)
