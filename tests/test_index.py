"""The index of programs: nearest first, saved and loaded, compared and explained."""

from __future__ import annotations

import json

import pytest

from lodestrata import index

PROGRAMS = {"sum": "def f(xs):\n    s = 0\n    for x in xs:\n        s = s + x\n    return s\n", "total": "def total(items):\n    t = 0\n    for item in items:\n        t = t + item\n    return t\n", "cls": "class A:\n    def __init__(self, q):\n        self.q = {1: q, 2: [q, q]}\n", "broken": "def (:\n", "one": "x"}


def test_search_save_and_load(spark, tmp_path):
    (tmp_path / "src/p").mkdir(parents=True)
    for name, source in PROGRAMS.items():
        (tmp_path / f"src/p/{name}.py").write_text(source)
    built = index.ProgramIndex.of_folder(spark, str(tmp_path / "src"))
    built.save(str(tmp_path / "out"))
    with pytest.raises(Exception):
        built.save(str(tmp_path / "out"))
    loaded = index.ProgramIndex.load(spark, str(tmp_path / "out"))
    got = loaded.search(PROGRAMS["sum"], 3).collect()
    assert [r.rank for r in got] == [1, 2, 3] and {got[0].id, got[1].id} == {"p/sum.py", "p/total.py"}  # they differ in names only
    assert got[0].distance == pytest.approx(0, abs=1e-6) and got[2].distance > got[1].distance
    for r in got:
        assert r.distance == pytest.approx(index.compared(PROGRAMS["sum"], PROGRAMS[r.id[2:-3]])["distance"])
    assert loaded.audit()["programs"] == loaded.entries.count() >= 3
    with pytest.raises(ValueError):
        loaded.search("def (")


def test_compare_and_explain(capsys, tmp_path):
    for name in ("sum", "cls"):
        (tmp_path / f"{name}.py").write_text(PROGRAMS[name])
    found = index.compared(PROGRAMS["sum"], PROGRAMS["cls"], "flat", 4)
    masses = [p["mass"] for p in found["alignments"]]
    assert found["distance"] > 0 and found["plan"]["feasible"] and masses == sorted(masses, reverse=True) and len(masses) == 4
    assert index.compared(PROGRAMS["sum"], PROGRAMS["cls"])["distance"] == pytest.approx(index.compared(PROGRAMS["cls"], PROGRAMS["sum"])["distance"], rel=1e-5)
    assert index.main(["explain", str(tmp_path / "sum.py"), str(tmp_path / "cls.py"), "--top-k", "2"]) == 0
    assert len(json.loads(capsys.readouterr().out)["alignments"]) == 2
    assert index.main(["geometries"]) == 0 and "near_flat" in capsys.readouterr().out
    assert index.encoded("x = 1", 5)[1][0]["lca"] and index.encoded(None) is None and index.encoded("def (") is None
