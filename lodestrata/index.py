"""Search for programs alike: a program is a measure of paths between leaves of its syntax tree.

Paths are drawn by affine order, over all depths of their ancestors. Each stands for three points of the hyperbolic ball, its
common ancestor and its two ends: two coordinates by the node's sector of the tree and its depth, two by its label. Programs are as
far apart as the debiased transport between their paths; a program's term against itself is computed once, with its entry.
Nothing is learned, so that equal programs are encoded alike everywhere. An index is a table, saved as
Parquet; a search is a scan of it with a bounded top.

    python -m lodestrata.index index FOLDER OUT | search OUT FILE | compare A B | explain A B | audit OUT | geometries
"""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.batched import divergences, objectives, self_terms
from lodestrata.operators.geometry import Measure, Product, plan_diagnostics, sinkhorn_divergence_of
from lodestrata.operators.paths import affine_pairs
from lodestrata.operators.trees import python_nodes
from lodestrata.sources.readers import source_tree

#: Paths of a program, as a feature of its encoding, and the share of entropy in a distance.
PATHS, EPSILON = 32, 0.05
#: Named geometries: curvature, and whether paths are read in both directions.
GEOMETRIES = {"hyperbolic": (1.0, True), "near_flat": (1e-4, True), "flat": (0.0, True), "directed": (1.0, False)}
#: Coordinates of a point, how far out a label lies, and how fast nodes move out with their depth.
COORDINATES, LABEL_RADIUS, PACE = 4, 0.3, 0.3
#: An encoded program: its paths' points (ancestor, start, end) and labels.
ENCODED = "points array<array<double>>, paths array<struct<start: string, lca: string, end: string, length: int>>"


def places(nodes: list[dict]) -> np.ndarray:
    """A point a node: its angle halves its sector, which it shares out among its children; its label turns the other two coordinates."""
    children = np.bincount([n["parent"] for n in nodes if n["parent"] is not None], minlength=len(nodes))
    sectors, out = np.zeros((len(nodes), 2)), np.zeros((len(nodes), COORDINATES))
    for n in nodes:
        i, up = n["node"], n["parent"]
        if up is None:
            sectors[i] = 0.0, 2 * np.pi
        else:
            start, width = sectors[up]
            sectors[i] = start + width * n["child_index"] / children[up], width / children[up]
        angle, turn = sectors[i][0] + sectors[i][1] / 2, int(hashlib.sha256(n["label"].encode()).hexdigest()[:8], 16) / 2**32 * 2 * np.pi
        radius = 0.9 * np.tanh(PACE * n["depth"])
        out[i] = radius * np.cos(angle), radius * np.sin(angle), LABEL_RADIUS * np.cos(turn), LABEL_RADIUS * np.sin(turn)
    return out


def encoded(source: str | None, most: int = PATHS) -> tuple[list[list[float]], list[dict]] | None:
    """Points and labels of a program's paths; null where it does not parse or has fewer than two leaves."""
    nodes = python_nodes(source)
    if not nodes:
        return None
    found = affine_pairs(nodes, most)
    if not found:
        return None
    place = places(nodes)
    points = [np.concatenate([place[a], place[i], place[j]]).tolist() for i, j, a, _ in found]
    label = lambda i: nodes[i]["label"]
    return points, [{"start": label(i), "lca": label(a), "end": label(j), "length": nodes[i]["depth"] + nodes[j]["depth"] - 2 * d} for i, j, a, d in found]


def measure(points) -> Measure:
    array = np.array([list(p) for p in points], float).reshape(len(points), 3, COORDINATES)
    return Measure(array, np.full(len(array), 1 / len(array)))


def product(geometry: str) -> Product:
    curvature, unoriented = GEOMETRIES[geometry]
    return Product(curvature, unoriented=unoriented)


class ProgramIndex:
    """Encoded programs: id, points and paths, one row a program."""

    def __init__(self, entries: DataFrame, geometry: str = "hyperbolic") -> None:
        self.entries, self.geometry = entries, geometry

    @staticmethod
    def encode(programs: DataFrame, key: str, source: str) -> DataFrame:
        """id, points and paths of the programs that parse and have a path."""

        @F.pandas_udf(ENCODED)
        def encode(sources: pd.Series) -> pd.DataFrame:
            both = [encoded(s) or (None, None) for s in sources]
            return pd.DataFrame({"points": pd.Series([p for p, _ in both], dtype=object), "paths": pd.Series([q for _, q in both], dtype=object)})

        rows = programs.select(F.col(key).cast("string").alias("id"), encode(F.col(source)).alias("e")).select("id", "e.*")
        return rows.where("points IS NOT NULL")

    @classmethod
    def build(cls, programs: DataFrame, key: str, source: str, geometry: str = "hyperbolic") -> ProgramIndex:
        """Of all programs that parse; a null source is left out, repeated rows are so many entries."""
        return cls(self_terms(cls.encode(programs, key, source), product(geometry), EPSILON), geometry)

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, geometry: str = "hyperbolic") -> ProgramIndex:
        files = source_tree(spark, folder).select("source_relpath", F.decode("content", "utf-8").alias("source"))
        return cls.build(files, "source_relpath", "source", geometry)

    def save(self, folder: str) -> None:
        """Written once: an index that is there already is an error."""
        self.entries.withColumn("geometry", F.lit(self.geometry)).write.parquet(folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> ProgramIndex:
        rows = spark.read.parquet(folder)
        row = rows.select("geometry").head()
        return cls(rows.drop("geometry"), row[0] if row else "hyperbolic")

    def search(self, source: str, top_k: int = 20) -> DataFrame:
        """rank, id and distance of the top_k nearest programs, ties by id."""
        query = encoded(source)
        if query is None:
            raise ValueError("the query has no path between two leaves")
        asked, geometry = measure(query[0]), product(self.geometry)

        own = float(objectives(geometry, [asked], [asked], EPSILON)[0])

        @F.pandas_udf("double")
        def far(points: pd.Series, terms: pd.Series) -> pd.Series:
            cross = objectives(geometry, [asked] * len(points), [measure(p) for p in points], EPSILON)
            return pd.Series(np.maximum(cross - (own + terms.to_numpy()) / 2, 0))

        near = self.entries.select("id", far("points", "self_term").alias("distance")).orderBy(F.round("distance", 9), "id").limit(top_k)
        rows = near.collect()  # top_k
        return near.sparkSession.createDataFrame([(i, r.id, r.distance) for i, r in enumerate(rows, 1)], "rank int, id string, distance double")

    def nearest(self, programs: DataFrame, key: str, source: str, top_k: int = 20) -> DataFrame:
        """query, item, distance and rank: the top_k nearest entries of each of many programs, blocks of programs against blocks of entries; ties by id."""
        return divergences(self.encode(programs, key, source), self.entries, product(self.geometry), EPSILON, top_k)

    def audit(self) -> dict[str, float]:
        """Programs, paths a program, and the mean length and depth of their paths."""
        rows = self.entries.select(F.size("paths").alias("n"), F.aggregate("paths", F.lit(0), lambda a, p: a + p["length"]).alias("l"))
        return rows.agg(F.count("*").alias("programs"), F.avg("n").alias("paths_mean"), F.min("n").alias("paths_least"), F.max("n").alias("paths_most"), (F.sum("l") / F.sum("n")).alias("length_mean")).first().asDict()


def compared(left: str, right: str, geometry: str = "hyperbolic", top: int = 5) -> dict:
    """Distance of two programs, how well the plan between them keeps their masses, and its heaviest pairs of paths by (mass falling, cost, places)."""
    a, b = encoded(left), encoded(right)
    if a is None or b is None:
        raise ValueError("a program has no path between two leaves")
    space, x, y = product(geometry), measure(a[0]), measure(b[0])
    plan, cost = space.plan(x, y, EPSILON), space.cost(x, y)
    order = sorted((-plan[i, j], cost[i, j], i, j) for i in range(len(plan)) for j in range(plan.shape[1]))[:top]
    pairs = [{"left": a[1][i], "right": b[1][j], "mass": -m, "cost": c} for m, c, i, j in order]
    return {"distance": sinkhorn_divergence_of(space, x, y, EPSILON), "plan": plan_diagnostics(plan, x.mass, y.mass), "alignments": pairs}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestrata.index")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, names in {"index": ("folder", "out"), "search": ("out", "file"), "compare": ("left", "right"), "explain": ("left", "right"), "audit": ("out",), "geometries": ()}.items():
        sub = verbs.add_parser(verb)
        for name in names:
            sub.add_argument(name)
        sub.add_argument("--geometry", choices=GEOMETRIES, default="hyperbolic")
        sub.add_argument("--top-k", type=int, default=20)
    args = parser.parse_args(arguments)
    if args.verb == "geometries":
        out: object = {k: {"curvature": c, "unoriented": u} for k, (c, u) in GEOMETRIES.items()}
    elif args.verb in ("compare", "explain"):
        out = compared(Path(args.left).read_text(), Path(args.right).read_text(), args.geometry, args.top_k)
        if args.verb == "compare":
            out = {"distance": out["distance"]}
    else:
        spark = SparkSession.builder.appName("lodestrata").getOrCreate()
        if args.verb == "index":
            ProgramIndex.of_folder(spark, args.folder, args.geometry).save(args.out)
            out = ProgramIndex.load(spark, args.out).audit()
        elif args.verb == "audit":
            out = ProgramIndex.load(spark, args.out).audit()
        else:
            out = [r.asDict() for r in ProgramIndex.load(spark, args.out).search(Path(args.file).read_text(), args.top_k).collect()]
    print(json.dumps(out, default=float))
    return 0


if __name__ == "__main__":
    sys.exit(main())
