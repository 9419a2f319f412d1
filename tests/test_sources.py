"""Scans and sinks on small folders."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile

import pytest

from lodestrata.operators import graphs
from lodestrata.sources import readers, writers


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_strict_json_lines(spark, tmp_path):
    put(tmp_path / "a.jsonl", '{"x": 1}\n\n{"x": 2}\n')
    got = readers.jsonl_strict(spark, str(tmp_path / "a.jsonl"), "x int").orderBy("line").collect()
    assert [(r.line, r.x) for r in got] == [(1, 1), (3, 2)]
    put(tmp_path / "b.jsonl", '{"x": 1}\n[3]\n')
    with pytest.raises(Exception, match="b.jsonl:2 is not a JSON object"):
        readers.jsonl_strict(spark, str(tmp_path / "b.jsonl"), "x int").collect()


def test_discovered_tables(spark, tmp_path):
    put(tmp_path / "t/a.csv", 'code,label\n"x\ny",1\n ,2\n')
    put(tmp_path / "t/u/b.jsonl", '{"code": "z", "label": "3"}\n{"code": "q"}\n')
    put(tmp_path / "t/c.json", '[{"code": "w", "label": "4"}]')
    assert sorted(r.code for r in readers.discovered_tables(spark, str(tmp_path / "t"), "code", "label").collect()) == ["w", "x\ny", "z"]
    put(tmp_path / "none/x.txt", "")
    with pytest.raises(ValueError):
        readers.discovered_tables(spark, str(tmp_path / "none"), "code", "label")


def test_layouts(spark, tmp_path):
    for name in ("g/t1/a.py", "g/t1/deep/b.py", "g/top.py", "c/data/p1/Python/s.py", "c/data/p1/Ruby/s.py", "c/data/p2/s.py", "p/7/1.py", "p/12.py"):
        put(tmp_path / name, "x = 1\n")
    got = lambda root, layout: sorted((r.task, r.source_relpath) for r in readers.task_sources(spark, str(tmp_path / root), layout).collect())
    assert got("g", "generic") == [("t1", "t1/a.py"), ("t1", "t1/deep/b.py")]
    assert got("c", "codenet") == [("p1", "data/p1/Python/s.py")]
    assert got("p", "poj104") == [("12", "12.py"), ("7", "7/1.py")]
    with pytest.raises(ValueError):
        readers.task_sources(spark, str(tmp_path / "g"), "other")


def test_inventories(spark, tmp_path):
    put(tmp_path / "d/x.train.c2s", "a\nb\n")
    put(tmp_path / "d/x.valid.c2v", "a\n")
    got = {r.split: r.lines for r in readers.split_inventory(spark, str(tmp_path / "d")).collect()}
    assert got == {"train": 2, "val": 1}
    there, gone = str(tmp_path / "d/x.train.c2s"), str(tmp_path / "no")
    status = {r.path: (r.exists, r.bytes, r.size_matches) for r in readers.archive_status(spark, {there: 4, gone: None}).collect()}
    assert status == {there: (True, 4, True), gone: (False, None, False)}
    put(tmp_path / "m.json", json.dumps({"version": 1, "tasks": [{"id": 1, "path": "a"}, {"id": 2, "path": "b"}]}, indent=2))
    assert readers.json_documents(spark, str(tmp_path / "m.json")).selectExpr("variant_get(document, '$.version', 'int') AS v").first().v == 1
    assert [tuple(r) for r in readers.manifest_tasks(spark, str(tmp_path / "m.json"), "tasks", "id int, path string").collect()] == [(1, "a"), (2, "b")]


def test_verified_split(spark):
    plan = spark.createDataFrame([(1, "h1", "train"), (2, "h2", "train"), (3, "h3", "test")], "k int, sha string, split string")
    sources = spark.createDataFrame([(1, "h1", "x"), (2, "h2", "y"), (3, "other", "z")], "k int, sha string, code string")
    assert readers.verified_split(plan, sources, "k", "sha", "train", 2).count() == 2
    for split, n in (("train", 3), ("test", 1)):
        with pytest.raises(ValueError):
            readers.verified_split(plan, sources, "k", "sha", split, n)


def test_atomic_and_archived(spark, tmp_path):
    for value in ({"b": 1, "a": "ü"}, {"c": []}):
        said = writers.write_json_atomically(spark, str(tmp_path / "v.json"), value)
        content = (tmp_path / "v.json").read_bytes()
        assert json.loads(content) == value and said == {"path": "v.json", "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".part")]
    df = spark.createDataFrame([("b", b"2"), ("a", b"1")], "name string, content binary").coalesce(1)
    archive = writers.tar_archives(df, "name", "content").first().archive
    with tarfile.open(fileobj=io.BytesIO(bytes(archive))) as tar:
        assert [(m.name, tar.extractfile(m).read()) for m in tar] == [("a", b"1"), ("b", b"2")]
    writers.write_signatures(spark.createDataFrame([(2, [3, 4]), (1, [5, 6])], "k long, s array<int>").coalesce(1), str(tmp_path / "sig"), "k", "s")
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "sig")).collect()] == [(1, [5, 6]), (2, [3, 4])]


def test_chain_from_files_to_eligible_programs(spark, tmp_path):
    """Copies of three kinds and a near copy fall to the first by path; problems that share programs are one cluster."""
    from lodestrata.operators import eligibility

    long = "\n".join(f"value_{i} = compute(value_{i - 1}, {i})" for i in range(1, 60))
    near = long.replace("compute(value_30, 31)", "other(value_30, 31)")
    files = {
        "p1/a.py": b"x = 1\nprint(x)\n", "p1/b.py": b"x = 1\nprint(x)\n",  # the same bytes
        "p1/c.py": b"x = 1  \r\nprint(x)\n\n\n",  # the same text but for layout
        "p2/a.py": b"y = 2\nprint(y)\n",  # the same structure
        "p2/b.py": b"def (:\n", "p2/c.py": b"\xff\xfe\x00", "p2/d.py": "# -*- coding: latin-1 -*-\ns = '\xe9'\n".encode("latin-1"),
        "p3/a.py": long.encode(), "p3/b.py": near.encode(), "p3/c.py": b"import os\n",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = graphs.cut(eligibility.inventory(readers.source_tree(spark, str(tmp_path))))
    whole = graphs.cut(eligibility.near_retained(eligibility.exact_retained(rows, "source_relpath", "parse_ok"), "source_relpath", "shingles", 0.8, 32, 4))
    got = {r.source_relpath: r for r in whole.collect()}
    assert {n for n, r in got.items() if r.component == "p1/a.py"} == {"p1/a.py", "p1/b.py", "p1/c.py", "p2/a.py"}
    assert {n for n, r in got.items() if not r.parse_ok} == {"p2/b.py", "p2/c.py"} and not got["p2/c.py"].decode_ok and got["p2/d.py"].encoding == "iso-8859-1"
    assert {n for n, r in got.items() if r.retained} == {"p1/a.py", "p2/d.py", "p3/a.py", "p3/b.py", "p3/c.py"}
    assert {n for n, r in got.items() if r.near_retained} == {"p1/a.py", "p2/d.py", "p3/a.py", "p3/c.py"}
    found = {tuple(r["groups"]): (r.retained, r.eligible) for r in eligibility.clusters(whole, "problem_id", "d2", "near_retained", 1, 0.05, 2).collect()}
    assert found == {("p1", "p2"): (2, True), ("p3",): (2, True)}
    stats = {r.problem_id: r for r in eligibility.group_summary(whole, "problem_id", "parse_ok").collect()}
    assert (stats["p1"].files, stats["p1"].exact_removed, stats["p2"].parse_ok, stats["p2"].exact_removed) == (3, 2, 2, 1)


def test_line_numbers_by_splits(spark, tmp_path):
    """Files of many splits have the numbers that reading them whole gives."""
    texts = {f"f{k}.txt": [f"{k} {i} " + "x" * (i % 37) for i in range(1, n + 1)] for k, n in enumerate((1, 900, 40))}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = readers.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.path.rsplit("/")[-1], r.line, r.value) for r in got) == sorted((n, i, v) for n, lines in texts.items() for i, v in enumerate(lines, 1))
