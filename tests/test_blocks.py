"""Stated queries against a gallery by blocks, held against brute force over all pairs."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from lodestrata.operators import blocks
from lodestrata.plans import catalog

KIND = "id long, label int, v array<double>"


def table(spark, n=240, width=6):
    """Vectors with exact copies, near ones, one of no length and one that is null."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(n, width)).round(3)
    v[40:60] = v[20]
    v[60:65] = v[20] + 1e-7
    v[7] = 0
    rows = [(i, int(rng.integers(4)), None if i == 11 else v[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, KIND).repartition(5), {i: (label, x) for i, label, x in rows}


def ordered(found, q, measure):
    far = {i: measure(np.array(found[q][1]), np.array(x)) for i, (_, x) in found.items() if i != q and x is not None}
    return sorted(far, key=lambda i: (round(far[i], 9), i)) + sorted(i for i in found if i != q and i not in far), far


def euclid(x, y):
    return float(np.sqrt(((x - y) ** 2).sum()))


def cosine(x, y):
    size = np.sqrt((x * x).sum() * (y * y).sum())
    return 1 - (float(x @ y) / size if size else 0.0)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocks, "QUERIES", 10)
    monkeypatch.setattr(blocks, "GALLERY", 64)
    monkeypatch.setattr(blocks, "STRIP", 4)


@pytest.mark.parametrize(("measure", "plain"), [(blocks.euclidean, euclid), (blocks.cosine, cosine)])
def test_nearest_equals_brute_force(spark, small, measure, plain):
    rows, found = table(spark)
    got = {}
    for r in blocks.nearest(rows.where("id % 20 = 0"), rows, measure, 25).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["item"], r.distance, r.relevant))
    assert sorted(got) == list(range(0, 240, 20))
    for q, near in got.items():
        order, far = ordered(found, q, plain)
        assert [i for _, i, _, _ in sorted(near)] == order[:25]
        assert all(abs(d - far[i]) < 1e-9 and same == (found[i][0] == found[q][0]) for _, i, d, same in near)


def test_null_vectors_come_last(spark, tmp_path):
    rows = [(i, i % 2, None if i == 3 else [float(i)] * 64) for i in range(21)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["gallery_top_k"](spark, str(tmp_path)).where("query = 0").orderBy("rank").collect()
    assert [r["item"] for r in got] == [1, 2, 4, 5, 6, 7, 8, 9, 10, 11]


def test_nearest_of_both_and_precision(spark, small):
    rows, found = table(spark)
    asked = rows.where("id % 20 = 0")
    both = {r["query"]: r for r in blocks.nearest_of_both(asked, rows, blocks.euclidean).collect()}
    at_r = {r["query"]: r.map_at_r for r in blocks.average_precision_at_r(asked, rows, blocks.euclidean, 7).collect()}
    for q in range(0, 240, 20):
        order, far = ordered(found, q, euclid)
        same = [found[i][0] == found[q][0] for i in order]
        assert both[q].positive == pytest.approx(min(far[i] for i, s in zip(order, same, strict=True) if s and i in far), abs=1e-9)
        assert both[q].negative == pytest.approx(min(far[i] for i, s in zip(order, same, strict=True) if not s and i in far), abs=1e-9)
        assert at_r[q] == pytest.approx(sum(sum(same[: n + 1]) / (n + 1) for n in range(7) if same[n]) / min(7, sum(same)))


def test_medians_and_costs_of_all_pairs(spark, small):
    rows, found = table(spark)
    asked = rows.where("id % 20 = 0")
    far = {(q, i): euclid(np.array(found[q][1]), np.array(x)) for q in range(0, 240, 20) for i, (_, x) in found.items() if i != q and x is not None}
    for some in (asked, asked.where("id < 20")):
        here = [d for (q, _), d in far.items() if some is asked or q < 20]
        assert blocks.order_statistics(some, rows, [blocks.euclidean, lambda x, y: 0 * blocks.euclidean(x, y)]) == pytest.approx([np.median([d for d in here if d > 0]), 1.0], rel=1e-12)
    got = {(r["query"], r["item"]): r.distance for r in blocks.costs(asked, rows, blocks.euclidean).collect()}
    assert len(got) == 12 * 239 and all(abs(got[k] - d) < 1e-9 for k, d in far.items()) and got[20, 11] is None


def test_student_sees_every_pair(spark, small):
    rows, found = table(spark)
    first = lambda x, y: blocks.euclidean(x[:, :3], y[:, :3])
    weights, errors = blocks.student(rows.where("id % 20 = 0"), rows, [first], blocks.euclidean, "student")
    pairs = [(q, i) for q in range(0, 240, 20) for i, (_, x) in found.items() if i != q and x is not None]
    bits = {p: hashlib.sha256(f"student|{p[0]}|{p[1]}".encode()).hexdigest() for p in pairs}
    at = lambda p, n: euclid(np.array(found[p[0]][1])[:n], np.array(found[p[1]][1])[:n])
    learnt = np.array([(at(p, 3), at(p, 6)) for p in pairs if int(bits[p][:13], 16) / 2**52 < 0.5])
    other = np.array([(at(p, 3), at(p, 6)) for p in pairs if int(bits[p][:13], 16) / 2**52 >= 0.5])
    w = np.corrcoef(learnt.T)[0, 1] / 1.0001
    off = w * (other[:, 0] - learnt[:, 0].mean()) / learnt[:, 0].std() * learnt[:, 1].std() + learnt[:, 1].mean() - other[:, 1]
    row = errors.first()
    assert weights[0] == pytest.approx(w) and row.n == len(other) and row.mae == pytest.approx(np.abs(off).mean()) and row.rmse == pytest.approx(np.sqrt((off * off).mean()))


def test_shingling_bounds_its_batches(spark):
    catalog.shingle_sets(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500 and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20


def test_scores_by_blocks_equal_windows_over_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "HELD", 1000)
    monkeypatch.setattr(blocks, "CHUNK", 50)
    rows, found = table(spark)
    rows = rows.selectExpr("id", "IF(id % 17 = 3, NULL, label) AS label", "v")
    label = {i: None if i % 17 == 3 else x for i, (x, _) in found.items()}
    scored = blocks.scores(rows.where("id % 20 = 0"), rows, blocks.euclidean)
    assert "Window" not in scored._jdf.queryExecution().executedPlan().toString()
    got = {r["query"]: r for r in scored.collect()}
    for q in range(0, 240, 20):
        order, _ = ordered(found, q, euclid)
        places = [n for n, i in enumerate(order, 1) if label[q] is not None and label[i] == label[q]]
        if not places:
            assert q not in got
            continue
        r = got[q]
        assert (r.q_label, r.positives, r.reciprocal_rank) == (label[q], len(places), 1 / places[0])
        assert r.average_precision == pytest.approx(np.mean([n / p for n, p in enumerate(places, 1)]))
        assert (r.recall_5, r.hit_10) == (sum(p <= 5 for p in places) / len(places), int(places[0] <= 10))


def test_blocks_are_not_copied_to_shuffles(spark, small, monkeypatch):
    monkeypatch.setattr(blocks, "HELD", 100)
    rows, _ = table(spark)
    asked = rows.where("id % 20 = 0")
    for found in (blocks.costs(asked, rows, blocks.euclidean), blocks.scores(asked, rows, blocks.euclidean)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "explode" not in plan


def test_costs_take_every_vector_whole(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(5)
    rows = [(i, i % 3, rng.normal(scale=0.1, size=64).astype("f4").tolist()) for i in range(1, 46)]  # two ids alone are divisible by 20
    rows[1] = (2, 2, rows[0][2][:60] + rows[1][2][60:])
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    costs = {(r["left"], r["right"]): r.cost for r in catalog.QUERIES["product_costs"](spark, str(tmp_path)).collect()}
    assert set(costs) == {(i, j) for i in range(1, 46) for j in range(1, 46) if i != j}
    assert all(abs(costs[i, j] - c) < 2e-5 for i, j, c in con.execute(catalog.ORACLE_SQL["product_costs"]).fetchall())
    assert costs[1, 2] > 0  # their last four numbers alone differ


def test_distance_student_learns_from_every_vector(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(6)
    rows = [(i, 0, rng.normal(size=64).astype("f4").tolist()) for i in range(1, 40)]  # one id alone is divisible by 20
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got, want = catalog.QUERIES["distance_student"](spark, str(tmp_path)).first(), con.execute(catalog.ORACLE_SQL["distance_student"]).fetchall()[0]
    halves = [int(hashlib.sha256(f"student|{i}|{j}".encode()).hexdigest()[:13], 16) / 2**52 < 0.5 for i in range(1, 40) for j in range(1, 40) if i != j]
    assert got.n == want[0] == halves.count(False)
    assert tuple(got)[1:] == pytest.approx(want[1:], abs=2e-5)
