"""Lexical search, mixing and the filter audit against brute force, on odd input too; their SQL runs with the other queries'."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import audit, lexical, mixing
from lodestrata.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, "b"), (4, "Ünïcödé ÉCOLE 12 !? abc", "de", None), (4, "Ünïcödé ÉCOLE 12 !? abc", "de", None), (5, "word " * 3000, "de", "c"), (6, "x" * 20000, "", "d"), (None, "abc def", "en", "b"), (None, None, None, None), (7, "abc\x0bdef ghi $ ABC", "fr", "c"), (8, "abc def", "en", "")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, repeated and very long texts, and columns named like results."""
    rows = [(*r, 1.5, "x", "y", "z") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, Size string, copies string, part string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def against_sql(spark, name, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, wanted)) and wanted


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_mixing", "op13_filter_audit"])
def test_equals_sql(spark, name):
    against_sql(spark, name, SF)


# op11


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(docs, items, k):
    """Every document against every item, in whole numbers."""
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = {}
    for item, text in items:
        found = []
        for i, c, size in held:
            m = 50 + 50 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if t in c)
            if s > 0:
                found.append((-s, i is None, i))
        out[item] = [(i, -s) for s, _, i in sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k]]
    return {item: rows for item, rows in out.items() if rows}


def searched(docs, items, k):
    out = {}
    for r in lexical.search(lexical.build(docs), items, k).orderBy("item_id", "rank").collect():
        rows = out.setdefault(r.item_id, [])
        assert r["rank"] == len(rows) + 1
        rows.append((r.doc_id, r.score))
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    """Many small shards, rounds that stop early, ties and copies."""
    monkeypatch.setattr(lexical, "SHARD", 8)
    monkeypatch.setattr(lexical, "FIRST", 2)
    monkeypatch.setattr(lexical, "GROWTH", 2)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    topics = [rng.sample(vocabulary, 30) for _ in range(12)]
    docs = [(i, " ".join(rng.choice(topics[i % 12]) if rng.random() < 0.8 else rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for i in range(900)]
    docs += [(900 + i, docs[7][1]) for i in range(70)]  # ties
    items = [(q, " ".join(rng.choice(topics[q % 12]) for _ in range(rng.randint(1, 9)))) for q in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = searched(df, spark.createDataFrame(items, "item_id long, text string"), 10)
    assert got == plain_search(docs, items, 10)


def test_bisection_gathers_topics():
    rng = random.Random(6)
    topics = [[f"t{k}x{i}" for i in range(25)] for k in range(16)]
    docs = [sorted(set(lexical.buckets(w.encode() for w in rng.sample(topics[i % 16], 12)))) for i in range(640)]
    leaf = lexical.Tree(docs).leaves(np.concatenate([np.array(d) for d in docs]), np.array([len(d) for d in docs]))
    assert np.mean([len({i % 16 for i in np.flatnonzero(leaf == x)}) for x in set(leaf.tolist())]) < 3  # dealt at random, a leaf would hold about 7


def test_search_odd(spark, odd, empty):
    items = [(1, "abc DEF"), (2, None), (3, ""), (4, "école ÉCOLE"), (5, "word x" + "x" * 19999), (6, "abc abc"), (6, "ghi"), (None, "abc"), (7, "unknown")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("r"))
    merged = [(1, "abc DEF"), (4, "école ÉCOLE"), (5, items[4][1]), (6, "abc ghi")]
    docs = [(r[0], r[1]) for r in ODD]
    assert searched(odd, asked, 50) == plain_search(docs, merged, 50)
    assert searched(empty, asked, 50) == {} and searched(odd, asked.limit(0), 50) == {}
    assert searched(odd.where("doc_id < 3"), asked, 50) == {}


# op12


def plain_targets(sizes, weights=(5, 2, 1), stop=3):
    """By rounds: who is above the stop is held there, and the others share the rest."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        share = left / sum(weight[s] for s in free)
        above = {s for s in free if share * weight[s] > stop * sizes[s]}
        for s in above or free:
            out[s] = stop * sizes[s] if above else share * weight[s]
        left -= sum(stop * sizes[s] for s in above)
        free -= above or free
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_rounds(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "RANK_ROWS", 7)  # many ranges
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 5, 50, 5000]) * rng.randint(0, 9) for s in [None, "", "é", "z", "Z", *(f"s{i}" for i in range(30))]}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r for r in mixing.targets(rows).collect()}
    for s, t in plain_targets(sizes).items():
        assert got[s].target == pytest.approx(t) and got[s].source_size == sizes[s] and got[s].rate <= 3


def test_mixture(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mixed(docs).collect()
    again = {(r.doc_id, r.copies) for r in mixing.mixed(docs.repartition(7)).collect()}
    assert {(r.doc_id, r.copies) for r in got} == again and docs.columns == got[0].asDict().keys() - set() or list(got[0].asDict())[: len(docs.columns)] == docs.columns
    for r in got:
        rate = r.target / r.source_size
        assert r.copies in (math.floor(rate), math.floor(rate) + 1) and r.copies <= 3 and r.size == len(WORD.findall(r.text)) and r.taken == r.size * r.copies
    assert mixing.mixture(docs).count() == sum(r.copies for r in got)
    found = mixing.mixed(odd).collect()
    assert [c.lower() for c in mixing.mixed(odd).columns].count("size") == 1 and len(found) == len(ODD)
    assert {r.size for r in found if r.text is None} == {0} and {r.size for r in found if r.doc_id == 5} == {3000} and {r.size for r in found if r.doc_id == 7} == {5 - 1}
    assert len({r.copies for r in found if r.doc_id == 4}) == 1
    assert mixing.mixed(empty).count() == 0 and mixing.mixture(odd.where("doc_id < 3")).count() == 0


def test_taken_comes_near_target(spark):
    rows = spark.range(40000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    for r in mixing.mixed(rows).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.04 * r.target


def test_draw_is_even(spark):
    u = [r.u for r in spark.range(4000).select(mixing.drawn(F.col("id"), F.lit(None).cast("string"), "s").alias("u")).collect()]
    assert min(u) >= 0 and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02
    assert u[7] == int(hashlib.md5(b"s:7").hexdigest()[:13], 16) / 2**52


# op13


def plain_audit(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, lang, *_ in docs:
        t = t or ""
        w = WORD.findall(t)
        failing = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        rows.append((lang or "", {f for f, x in failing.items() if x}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], Counter()
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [r for r in own if f in r[1] and not r[1] & before]
                shapley[f] += len(here)
                out[part, "".join(order), step] = [sum(not r[1] & (before | {f}) for r in own), len(here), sum(f in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {f} for r in own), sum(r[2] for r in here), sum(r[3] for r in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(docs, labels).collect()}


def test_audit_equals_brute_force(spark, odd, empty):
    labels = [(1, 1, 0), (2, 0, 1), (4, 1, 1), (4, 0, 0), (5, None, 1), (6, 1, None), (None, 1, 1), (99, 1, 1)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("x"))
    assert audited(odd, told) == plain_audit(ODD, labels)
    assert audited(empty, told) == {} and audited(odd, told.limit(0)) == plain_audit(ODD, [])
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["a", "B", "c", "$", "dd", f"u{rng.randint(0, 500)}"]) for _ in range(rng.choice([5, 150, 250, 400]))) if i % 4 else "same text", f"p{rng.randint(0, 40)}") for i in range(600)]
    rows = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, lang string, source string").repartition(5)
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 600, 2)]
    assert audited(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) == plain_audit(docs, labels)


def test_orders_of_the_audit():
    assert len(audit.steps()) == 600 and len({s[0] for s in audit.steps()}) == 120
