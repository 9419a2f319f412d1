"""Functions and operators on small literal tables; catalogue queries against their SQL on the smallest tables."""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import random
import tarfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import distance, hashing, text
from lodestrata.operators import corpus, features, graphs, sampling, stats, transport, trees
from lodestrata.plans import catalog
from lodestrata.sources import readers, writers
from lodestrata.streaming import events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()[0]


def lit_map(d):
    pairs = [x for k, v in d.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    result = duck.execute(catalog.ORACLE_SQL[name])
    at = [d[0] for d in result.description]
    assert sorted(at) == columns
    plain = lambda v: round(float(v), 4) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    assert sorted(str([plain(r[c]) for c in columns]) for r in rows) == sorted(str([plain(r[at.index(c)]) for c in columns]) for r in result.fetchall())


def test_hmac_equals_library(spark):
    for key in (b"k", bytes(range(64)), b"x" * 100):
        assert one(spark, hashing.hmac_sha256(key, F.lit("msg\0é"))) == hmac.new(key, "msg\0é".encode(), hashlib.sha256).hexdigest()
    digest = hashlib.sha256(b"a").hexdigest()
    assert one(spark, hashing.digest_modulo(F.lit(digest), 97)) == int(digest[:16], 16) % 97
    assert one(spark, hashing.blake2b(F.lit("tok"))) == hashlib.blake2b(b"tok", digest_size=8).hexdigest()
    assert one(spark, hashing.stable_label_value(F.lit("ab"))) == pytest.approx(((1 * 97 + 2 * 98) % 997) / 996)


def test_paths_and_sources(spark):
    assert one(spark, text.normalize_path(F.lit("\\a\\.\\b//c/ "))) == "a/b/c"
    assert one(spark, text.path_prefixes(F.lit("a/b"))) == ["", "a", "a/b"]
    assert one(spark, text.normalize_source(F.lit("x \r\ny\t\r\n\n\n"))) == "x\ny\n" == one(spark, text.normalize_source(F.lit("x\ny")))
    assert one(spark, text.subtokens(F.lit("get|name"))) == ["get", "name"]
    assert one(spark, text.html_visible_text(F.lit("<p>A <b>B</b></p><script>x()</script> ﬁn"))) == "a b fin"
    row = one(spark, text.code2vec_contexts(F.lit("lab a,x||y,b bad c,z,d e,||,f ,x,g")))
    assert row.label == "lab" and [(c.start, c.path, c.end) for c in row.contexts] == [("a", ["x", "y"], "b"), ("c", ["z"], "d")]
    found = one(spark, text.extract_paths(F.lit("see src/a.py and ./src/a.py, a/lib/b/c.js `lib/a+b.c` src/Makefile a/b /dev/null .git/x.y")))
    assert found == ["lib/a+b.c", "lib/b/c.js", "src/Makefile", "src/a.py"]
    tokens = ["LongName" * 9, "1.5", ".5", "7.", "a  b", '"' + "x" * 40, "1.2.3"]
    assert [one(spark, text.normalize_token(F.lit(t))) for t in tokens] == ["LongName" * 9, "NUMBER", "NUMBER", "NUMBER", "a b", '"' + "x" * 30 + "...", "1.2.3"]


@pytest.mark.parametrize(
    ("page", "shown"),
    [("<script>never closed <b>x", ""), ("a<!-- c > d --> b <!-- open", "a b"), ("<style>a</style >x<SCRIPT SRC=q>y</SCRIPT>z", "x z"), ("&lt;b&gt; 1 < 2 &amp; Straße", "<b> 1 < 2 & strasse"), ("<a title='x>y'>t</a> <b 'open>u", "t u"), ("p<br>q<styled>r</styled>", "p q r"), (None, ""), ("<" * 50_000 + "a", "<" * 49_999)],
)
def test_visible_text(page, shown):
    assert text.visible(page) == shown


def test_divergences(spark):
    a, b = {"a": 0.25, "b": 0.75}, {"c": 1.0}
    assert one(spark, distance.jensen_shannon_divergence(lit_map(a), lit_map(a))) == pytest.approx(0)
    assert one(spark, distance.jensen_shannon_divergence(lit_map(a), lit_map(b))) == pytest.approx(1)
    assert one(spark, distance.jensen_shannon_divergence(lit_map({}), lit_map({}))) == 0
    assert one(spark, distance.jensen_shannon_divergence(lit_map(a), lit_map({}))) == pytest.approx(0.5)
    assert one(spark, distance.sparse_cosine(lit_map(a), lit_map({}))) == 0
    assert one(spark, distance.sparse_euclidean(lit_map(a), lit_map(b))) == pytest.approx(math.sqrt(0.0625 + 0.5625 + 1))


def test_array_distances(spark):
    arr = lambda s: F.array(*[F.lit(c) for c in s])
    assert one(spark, distance.common_prefix_length(arr("abc"), arr("abd"))) == 2 and one(spark, distance.prefix_trie_distance(arr("abc"), arr("ab"))) == 1
    assert one(spark, distance.edit_distance(arr("kitten"), arr("sitting"))) == 3
    assert one(spark, distance.bigram_jaccard_distance(arr("abc"), arr("abc"))) == 0
    assert one(spark, distance.poincare(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.5), F.lit(0.0)))) == pytest.approx(2 * math.atanh(0.5))
    assert one(spark, distance.four_point_delta(*map(F.lit, (1.0, 2.0, 3.0, 1.0, 2.0, 1.0)))) == 0


def test_components_and_curvature(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)]
    edges = spark.createDataFrame(pairs, "left long, right long")
    nodes = spark.createDataFrame([(i,) for i in [*range(60), *range(100, 131)]], "node long")
    comp = {r.node: r.component for r in graphs.connected_components(nodes, edges).collect()}
    root = {n: n for n in comp}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert comp == root
    star = spark.createDataFrame([("c", x) for x in "abd"], "left string, right string")
    assert {r.curvature for r in graphs.forman_curvature(star).collect()} == {0}
    assert graphs.shortest_paths(star, 5).where("left = 'a' AND right = 'b'").first().distance == 2


def test_strict_join_and_merge(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "d")], "k long, x string")
    assert corpus.strict_join(left, right, ["k"]).count() == 2
    for bad in (left.union(spark.createDataFrame([(9,)], "k long")), left.union(spark.createDataFrame([(3,)], "k long"))):
        with pytest.raises(ValueError):
            corpus.strict_join(bad, right, ["k"])
    with pytest.raises(ValueError):
        corpus.merge_runs(left, left, keys=["k"])
    assert corpus.merge_runs(left, left, keys=["k"], allow_duplicates=True).count() == 2
    with pytest.raises(ValueError):
        corpus.assert_disjoint(left, left, key="k")


def test_splits(spark):
    rows = spark.range(50).withColumnRenamed("id", "k")
    got = {r.k: r for r in sampling.quota_split(rows, "k", b"key", "r", [("train", 10), ("test", 5)]).collect()}
    order = sorted(got, key=lambda k: hmac.new(b"key", f"r\0{k}".encode(), hashlib.sha256).hexdigest())
    assert {got[k].split for k in order[:10]} == {"train"} and {got[k].split for k in order[10:15]} == {"test"} and {got[k].split for k in order[15:]} == {"reserve"}
    weights = spark.createDataFrame([("a", 3), ("b", 3), ("c", 1)], "k string, w long")
    assert {r.k: r.quota for r in sampling.hamilton_quotas(weights, "k", "w", 10).collect()} == {"a": 4, "b": 4, "c": 2}
    assert sum(r.quota for r in sampling.hamilton_quotas(weights, "k", "w", 10).collect()) == 10
    assert sampling.allocation_bound(10, 2) == 10


def test_statistics(spark):
    assert stats.sign_p(5, 0) == pytest.approx(2 / 32) and stats.sign_p(5, 0, False) == pytest.approx(1 / 32) and stats.sign_p(0, 0) == 1
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "s double, y int")
    assert stats.binary_auc(df, "s", "y").first().auc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in (0.35, 0.8, 0.4) for b in (0.1, 0.4)]))
    assert stats.eta_squared(spark.createDataFrame([(1.0, "a"), (1.0, "a"), (2.0, "b")], "v double, g string"), "v", "g").first().eta_squared == pytest.approx(1)
    flat = spark.createDataFrame([(i, 0.0, 1.0) for i in range(20)], "k long, a double, b double")
    ci = stats.bootstrap_ci(flat, "a", "b", "k", 50).first()
    assert ci.low == ci.high == ci.mean == 1 and stats.sign_flip_p(flat, "a", "b", "k", 99).first().p_value < 0.05
    assert stats.sign_flip_p(flat, "b", "a", "k", 99).first().p_value == 1
    assert one(spark, stats.entropy(F.array(F.lit(1.0), F.lit(1.0)))) == 1


def test_ablation_and_weights(spark):
    items = F.array(*[F.lit(c) for c in "abab"])
    assert one(spark, features.lexical_ablation(items, "local")) == ["LEX_LOCAL_0", "LEX_LOCAL_1", "LEX_LOCAL_0", "LEX_LOCAL_1"]
    assert one(spark, features.lexical_ablation(items, "mask")) == [features.MASK] * 4
    assert one(spark, features.lexical_ablation(items, "hash"))[:2] == ["LEX_" + hashlib.blake2b(c.encode(), digest_size=8).hexdigest() for c in "ab"]
    contexts = one(spark, features.ablate_contexts(text.code2vec_contexts(F.lit("lab b,x|y,a a,z,c"))["contexts"], "local"))
    assert [(c.start, c.path, c.end) for c in contexts] == [("LEX_LOCAL_0", ["x", "y"], "LEX_LOCAL_1"), ("LEX_LOCAL_1", ["z"], "LEX_LOCAL_2")]
    with pytest.raises(ValueError):
        features.lexical_ablation(items, "other")


def test_trees(spark):
    nodes = trees.python_nodes("x = 1\n")
    assert nodes[0]["label"] == "Module" and trees.python_nodes("def (") is None
    for n in nodes[1:]:
        assert nodes[n["parent"]]["depth"] == n["depth"] - 1 and n["ancestors"][-2] == n["parent"] and n["last"] <= nodes[n["parent"]]["last"]
    assert trees.renamed("def f(x): return x + 1") == "def v0(v1):\n    return v1 + 1"
    scope = {}
    exec(trees.renamed("import math as m\nclass A:\n    k = 2\n    def g(self, q=1, *rest):\n        return len(rest) + q * self.k\nout = [A().g(3, i) + m.floor(i) for i in (1, 2)]\nout = sum(out)"), scope)
    assert 17 in scope.values()
    for policy in trees.POLICIES[:3]:
        leaves = [(n["node"], n["ancestors"]) for n in nodes if n["last"] == n["node"]]
        assert len(trees.leaf_pairs(leaves, 3, policy)) == min(3, len(leaves) * (len(leaves) - 1) // 2)
    path = np.abs(np.subtract.outer(np.arange(5), np.arange(5))).astype(float)
    ring = np.minimum(path, 5 - path)
    assert trees.hyperbolicity(path) == 0 and trees.hyperbolicity(ring) > 0


def test_program_signatures(spark):
    signs = [trees.structure_signature(p) for p in ("def f(a, b=1):\n    return a.x(b) + 'q'", "def g(u, v=22):  # c\n    return u.y(v) + 'other'", "def g(u, v=2.0):\n    return u.y(v) + 'q'")]
    assert signs[0] == signs[1] != signs[2] and trees.structure_signature("def (") is None and trees.structure_signature(None) is None
    assert trees.lexical_tokens("if x:\n    y = 'a'  # note\n") == ["NAME:if", "NAME:x", "OP::", "NAME:y", "OP:=", "STRING:'a'"]
    got = one(spark, trees.program_signatures(F.lit("x = 1")))
    assert got.tokens == ["NAME:x", "OP:=", "NUMBER:1"] and len(got.structure) == 64


def test_transport():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(6, 2)), rng.normal(size=(5, 2)) + 1
    a, b = np.full(6, 1 / 6), np.full(5, 1 / 5)
    plan = transport.sinkhorn_plan(((x[:, None] - y[None]) ** 2).sum(-1), a, b)
    assert np.allclose(plan.sum(0), b) and np.allclose(plan.sum(1), a) and (plan >= 0).all()
    assert transport.sinkhorn_divergence(x, x, a, a) == pytest.approx(0, abs=1e-9) and transport.sinkhorn_divergence(x, y, a, b) > 0.1
    value, coupling = transport.gromov_wasserstein(np.zeros((3, 3)), np.zeros((3, 3)), np.full(3, 1 / 3), np.full(3, 1 / 3))
    assert value == pytest.approx(0) and np.allclose(coupling.sum(0), 1 / 3)
    assert transport.exact_transport_1d(np.array([0.0, 1.0]), np.array([1.0, 2.0])) == pytest.approx(1)
    v = np.array([0.3, -0.2])
    assert np.allclose(transport.log0(transport.exp0(v, 1.0), 1.0), v) and np.allclose(transport.mobius_add(-v, v, 1.0), 0)


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "task-07.csv").write_text('code\nz\n"a\nb"\n" "\nc\n')
    (tmp_path / "task-x.csv").write_text("code\nq\n")
    got = readers.task_csv(spark, str(tmp_path)).orderBy("row_index").collect()
    assert [(r.record_id, r.row_index, r.code) for r in got] == [("task-07:0", 0, "z"), ("task-07:1", 1, "a\nb"), ("task-07:3", 3, "c")]
    assert [r.row_index for r in readers.task_csv(spark, str(tmp_path), 2).orderBy("row_index").collect()] == [0, 1]
    (tmp_path / "paths.txt").write_text("l a,x,b\n\nm bad\n")
    assert [r.label for r in readers.code2vec(spark, str(tmp_path / "paths.txt"), strict=False).collect()] == ["l"]
    with pytest.raises(Exception, match="no valid path contexts"):
        readers.code2vec(spark, str(tmp_path / "paths.txt")).collect()
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()
    assert [r._corrupt_record for r in readers.jsonl(spark, str(tmp_path / "x.jsonl"), "a int", strict=False).orderBy("a").collect()] == ["broken", None]
    (tmp_path / "src/p1").mkdir(parents=True)
    (tmp_path / "src/p1/s1.py").write_text("x = 1\n")
    row = readers.source_tree(spark, str(tmp_path / "src")).first()
    assert (row.problem_id, row.submission_id, row.source_relpath) == ("p1", "s1", "p1/s1.py")
    (tmp_path / "m.csv").write_text("id,status\n1,ok\n2,no\n")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as archive:
        archive.add(tmp_path / "m.csv", "m.csv")
    assert readers.tar_csv_rows(spark, [str(tmp_path / "t.tar.gz")], "row['status'] = 'ok'").first().row["id"] == "1"
    (tmp_path / "dup.txt").write_text("a,b\nc\n")
    assert readers.duplicate_map(spark, str(tmp_path / "dup.txt")).count() == 3
    df = spark.createDataFrame([(1, "x"), (2, None)], "b long, a string")
    assert json.loads(df.select(writers.canonical_json("b", "a").alias("j")).first().j) == {"a": "x", "b": 1}
    path = str(tmp_path / "out")
    assert writers.write_once_or_verify(df, path) and not writers.write_once_or_verify(df.orderBy(F.desc("b")), path)
    with pytest.raises(ValueError):
        writers.write_once_or_verify(df.limit(1), path)
    assert writers.markdown(df).splitlines()[2] == "| 1 | x |"


def test_stream_equals_table(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.parquet_stream(spark, str(tmp_path / "in"), table.schema)
    events.run_to_table(events.windowed_counts(stream), "hourly", str(tmp_path / "state"), "complete")
    plain = lambda df: sorted((r.window_start, r.event_type, r.n) for r in df.collect())
    assert plain(spark.table("hourly")) == plain(events.windowed_counts(table))


def test_entry_without_llm():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and catalog.FLAGSHIP in catalog.QUERIES


def test_sparse_cosine_takes_every_stated_query(spark, tmp_path):
    rng = random.Random(5)
    docs = {i: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 2) for _ in range(rng.randint(1, 12))) for i in range(0, 101, 5)}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bags = {i: Counter(t.split()) for i, t in docs.items()}
    held = Counter(w for b in bags.values() for w in b)
    weights = {i: {w: n * (math.log((len(docs) + 1) / (held[w] + 1)) + 1) for w, n in b.items()} for i, b in bags.items()}
    norm = {i: math.sqrt(sum(x * x for x in w.values())) for i, w in weights.items()}
    want = {}
    for q in (i for i in docs if i % 20 == 0):
        met = [sum(weights[q][w] * weights[d][w] for w in bags[q].keys() & bags[d].keys()) / norm[q] / norm[d] for d in docs if d != q and bags[q].keys() & bags[d].keys()]
        want[q] = (len(met), max(met), sum(met) / len(met))
    got = {r["query"]: (r.met, r.best, r.mean) for r in catalog.QUERIES["sparse_cosine"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len(want) == 6
    assert all(got[q][0] == want[q][0] and abs(got[q][1] - want[q][1]) < 1e-4 and abs(got[q][2] - want[q][2]) < 1e-4 for q in want)


def test_every_calibration_pair_equals_brute_force(spark):
    sizes = {"a": 700, "b": 300, "c": 1, "d": 65, "e": 3}
    groups = {g: list(range(1000 * k, 1000 * k + n)) for k, (g, n) in enumerate(sizes.items())}
    rows = spark.createDataFrame([(g, i) for g, items in groups.items() for i in items] * 2, "g string, i long")
    key = lambda *fields: hmac.new(catalog.BEACON, b"\0".join(str(f).encode() for f in ("cal", "r1", *fields)), hashlib.sha256).hexdigest()
    same = sorted((key("same_cluster_rank", g, x, y), g, x, g, y) for g, items in groups.items() for n, x in enumerate(items) for y in items[n + 1 :])[:40]
    cross = []
    for g in groups:
        for h in (h for h in groups if h > g):
            x, y = (groups[of][int(key(f"cross_{side}_program", g, h)[:16], 16) % len(groups[of])] for side, of in (("left", g), ("right", h)))
            cross.append((key("cross_cluster_rank", g, h, x, y), g, x, h, y))
    got = sampling.every_calibration_pair(rows, "g", "i", catalog.BEACON, "cal", "r1", 40, 7).collect()
    for kind, want in (("same", same), ("cross", sorted(cross)[:7])):
        assert sorted((r.digest, r.left_group, r.left_item, r.right_group, r.right_item) for r in got if r.pair_type == kind) == want


def test_sparse_cosine_sums_equal_brute_force_by_blocks(spark, monkeypatch):
    from lodestrata.operators import features

    for name, value in (("QUERIES", 7), ("GALLERY", 20), ("STRIP", 6), ("AT_ONCE", 50), ("OFTEN", 0.3)):
        monkeypatch.setattr(features, name, value)
    rng = random.Random(8)
    bags = {i: {w: rng.randint(1, 9) / 4 for w in (f"w{int(rng.paretovariate(0.4)) % 50}" for _ in range(rng.randint(1, 9)))} | ({"all": 0.5} if i % 3 else {}) for i in range(90)}
    rows = spark.createDataFrame([(i, w, x) for i, b in bags.items() for w, x in b.items()], "id long, item string, weight double").repartition(5)
    norm = {i: math.sqrt(sum(x * x for x in b.values())) for i, b in bags.items()}
    found = features.sparse_cosine_sums(rows.where("id % 5 = 0").select("id"), rows, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "SortMergeJoin [item" not in plan  # pairs are summed in the tasks that make them
    got = {r["query"]: (r.met, r.best, r.total) for r in found.collect()}
    for q in range(0, 90, 5):
        met = [sum(x * bags[d][w] for w, x in bags[q].items() if w in bags[d]) / norm[q] / norm[d] for d in bags if d != q and bags[q].keys() & bags[d].keys()]
        assert got.pop(q) == (len(met), pytest.approx(max(met)), pytest.approx(sum(met)))
    assert not got


def test_calibration_pairs_broadcast_no_items(spark, monkeypatch):
    monkeypatch.setattr(sampling, "PAIR_BLOCK", 16)
    rows = spark.range(300).selectExpr("CAST(id % 3 AS string) AS g", "CAST(id AS string) AS i")
    key = lambda g, x, y: hmac.new(catalog.BEACON, b"\0".join(f.encode() for f in ("cal", "r1", "same_cluster_rank", g, x, y)), hashlib.sha256).hexdigest()
    items = [(str(n % 3), str(n)) for n in range(300)]
    want = sorted((key(g, x, y), x, y) for g, x in items for h, y in items if g == h and x < y)[:30]
    found = sampling.every_calibration_pair(rows, "g", "i", catalog.BEACON, "cal", "r1", 30, 0)
    assert sorted((r.digest, r.left_item, r.right_item) for r in found.collect()) == want
    pairs = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in pairs or "leftHint=(strategy=merge)" in pairs


def test_calibration_pairs_are_digested_by_many_tasks_and_are_never_rows(spark):
    rows = spark.range(-300, 900).selectExpr("CAST(id % 2 AS int) AS g", "id AS i")
    key = lambda g, x, y: hmac.new(catalog.BEACON, b"\0".join(str(f).encode() for f in ("cal", "r1", "same_cluster_rank", g, x, y)), hashlib.sha256).hexdigest()
    groups = {g: [i for i in range(-300, 900) if int(math.fmod(i, 2)) == g] for g in (-1, 0, 1)}
    want = sorted((key(g, x, y), g, x, y) for g, items in groups.items() for n, x in enumerate(items) for y in items[n + 1 :])[:25]
    found = sampling.every_calibration_pair(rows, "g", "i", catalog.BEACON, "cal", "r1", 25, 0)
    assert [(r.digest, r.left_group, r.left_item, r.right_item) for r in sorted(found.collect(), key=lambda r: r.digest)] == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "explode(x" not in plan and "explode(y" not in plan


def test_fuzzy_pairs_write_items_of_near_sets_alone(spark, monkeypatch):
    rng, cut, written = random.Random(4), corpus.cut, []
    bags = {}
    for base in range(0, 300, 3):
        own = [f"i{rng.randrange(10**6)}" for _ in range(40)]
        bags |= {base: own, base + 1: own[rng.randrange(9) :], base + 2: rng.sample(own, 40) if base % 2 else own[:20]}
    rows = spark.createDataFrame(list(bags.items()), "id long, items array<string>").repartition(3)
    monkeypatch.setattr(corpus, "cut", lambda df: (out := cut(df), written.append((out.columns, out.count())))[0])
    got = {(r.left, r.right): r.similarity for r in corpus.fuzzy_pairs(rows, 0.9, 64, 4).collect()}
    first = {}
    for i, items in bags.items():
        first.setdefault(frozenset(items), i)
    near = {(i, j): len(a & b) / len(a | b) for a, i in first.items() for b, j in first.items() if i < j and len(a & b) / len(a | b) >= 0.9}
    assert got == pytest.approx(near) and len(near) > 20
    assert all("items" not in columns or n <= 2 * len(near) for columns, n in written)
    assert corpus.least_bands(0.9, 64, 4) == 11 and corpus.least_bands(0.9, 32, 8) == 1


def test_sparse_cosine_shuffles_no_more_copies_for_more_blocks(spark, monkeypatch):
    for name, value in (("QUERIES", 3), ("GALLERY", 20), ("STRIP", 6), ("AT_ONCE", 50), ("OFTEN", 0.3)):
        monkeypatch.setattr(features, name, value)
    rng = random.Random(9)
    bags = {i: {w: rng.randint(1, 9) / 4 for w in (f"w{int(rng.paretovariate(0.4)) % 50}" for _ in range(rng.randint(1, 9)))} for i in range(90)}
    rows = spark.createDataFrame([(i, w, x) for i, b in bags.items() for w, x in b.items()], "id long, item string, weight double").repartition(5)
    norm = {i: math.sqrt(sum(x * x for x in b.values())) for i, b in bags.items()}
    found = features.sparse_cosine_sums(rows.where("id % 5 = 0").select("id"), rows, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "explode" not in plan
    got = {r["query"]: (r.met, r.best, r.total) for r in found.collect()}
    for q in range(0, 90, 5):
        met = [sum(x * bags[d][w] for w, x in bags[q].items() if w in bags[d]) / norm[q] / norm[d] for d in bags if d != q and bags[q].keys() & bags[d].keys()]
        assert not met or got.pop(q) == (len(met), pytest.approx(max(met)), pytest.approx(sum(met)))
    assert not got
