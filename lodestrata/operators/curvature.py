"""Curvature of edges by optimal transport, and geometric profiles of trees of paths."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.distance import path_point
from lodestrata.operators.graphs import cut, discard, shortest_paths


def least_transport(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> float:
    """Least cost of carrying supply to demand (equal sums), by shortest augmenting paths over reduced costs."""
    left, need = np.asarray(supply, float).copy(), np.asarray(demand, float).copy()
    if abs(left.sum() - need.sum()) > 1e-9:
        raise ValueError("supply and demand differ in sum")
    n, m = len(left), len(need)
    flow, high, low = np.zeros((n, m)), np.zeros(n), np.zeros(m)  # potentials of sources and sinks
    while left.max(initial=0) > 1e-12:
        reach, before = np.full(n + m, np.inf), np.full(n + m, -1)
        queue = [(0.0, int(i)) for i in np.flatnonzero(left > 1e-12)]
        for _, i in queue:
            reach[i] = 0.0
        heapq.heapify(queue)
        done = np.zeros(n + m, bool)
        end = -1
        while queue:
            d, v = heapq.heappop(queue)
            if done[v]:
                continue
            done[v] = True
            if v >= n and need[v - n] > 1e-12:
                end = v
                break
            if v < n:
                to, step = np.arange(n, n + m), np.maximum(cost[v] - high[v] - low, 0)
            else:
                to = np.flatnonzero(flow[:, v - n] > 1e-12)
                step = np.zeros(len(to))  # along flow the reduced cost is zero
            for u, s in zip(to.tolist(), step.tolist(), strict=True):
                if not done[u] and d + s < reach[u] - 1e-15:
                    reach[u], before[u] = d + s, v
                    heapq.heappush(queue, (d + s, u))
        if end < 0:
            break  # what is left is rounding
        far = reach[end]
        high += far - np.minimum(reach[:n], far)
        low -= far - np.minimum(reach[n:], far)
        way = [end]
        while before[way[-1]] >= 0:
            way.append(int(before[way[-1]]))
        way.reverse()
        amount = min([left[way[0]], need[end - n], *[flow[b, a - n] for a, b in zip(way, way[1:], strict=False) if a >= n]])
        for a, b in zip(way, way[1:], strict=False):
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        left[way[0]] -= amount
        need[end - n] -= amount
    return float((flow * cost).sum())


#: Rounds in which nodes of one neighbour are taken off, at most.
PEELS = 12


def cycle_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose ends may lie on cycles, and the others: nodes of one neighbour are taken off in rounds, and lie on none."""
    rest = cut(edges.select("left", "right"))
    for _ in range(PEELS):
        ends = rest.select(F.col("left").alias("node")).union(rest.select("right"))
        single = ends.groupBy("node").agg(F.count("*").alias("n")).where("n = 1").select("node")
        fewer = rest.join(single.toDF("left"), "left", "left_anti").join(single.toDF("right"), "right", "left_anti").select("left", "right")
        before, rest = rest, cut(fewer)
        left, had = rest.count(), before.count()
        discard(before)
        if not left or left == had:
            break
    return rest, edges.join(rest, ["left", "right"], "left_anti")


def ollivier_curvature(edges: DataFrame, idleness: float = 0.0) -> DataFrame:
    """left, right and 1 - W of each edge, W the least transport between the lazy walks from its ends.

    A walk stays with idleness, else takes a neighbour. An edge on no cycle has what its ends' degrees say: around it
    the graph is a tree, and the least transport of a tree is the sum, over its edges, of the masses that must cross them. Ends
    of the others are one step apart, so that distances between their neighbours are 3 at most: a bounded search gives
    them, and each edge's small problem is a group. Edges are undirected, each once, without loops.
    """
    if not 0 <= idleness <= 1:
        raise ValueError("idleness is in 0 to 1")
    both = edges.select("left", "right").union(edges.select(F.col("right"), F.col("left"))).toDF("node", "to").distinct()
    degree = cut(both.groupBy("node").agg(F.count("*").alias("degree")))
    cyclic, plain = cycle_edges(edges.select("left", "right"))
    moving = F.lit(1.0 - idleness)
    leaving = lambda d: (d - 1) * moving / d  # noqa: E731  to the other neighbours of an end
    of_ends = plain.join(degree.toDF("left", "dl"), "left").join(degree.toDF("right", "dr"), "right")
    across = F.abs(1 - moving / F.col("dl") - moving / F.col("dr"))
    closed = of_ends.select("left", "right", (1 - (leaving(F.col("dl")) + leaving(F.col("dr")) + across)).alias("curvature"))
    if cyclic.isEmpty():
        return closed
    walk = both.join(degree, "node").select("node", "to", (moving / F.col("degree")).alias("mass"))
    if idleness:
        walk = walk.union(degree.select("node", F.col("node").alias("to"), F.lit(float(idleness)).alias("mass")))
    ends = cyclic.join(walk.select(F.col("node").alias("left"), F.col("to").alias("a"), F.col("mass").alias("a_mass")), "left").join(walk.select(F.col("node").alias("right"), F.col("to").alias("b"), F.col("mass").alias("b_mass")), "right")
    near = shortest_paths(edges, 3).select(F.col("left").alias("a"), F.col("right").alias("b"), "distance")
    costs = ends.join(near, ["a", "b"])
    kind = dict(edges.dtypes)["left"]

    def curve(key, frame: pd.DataFrame) -> pd.DataFrame:
        a, rows = np.unique(frame["a"].to_numpy(), return_inverse=True)
        b, columns = np.unique(frame["b"].to_numpy(), return_inverse=True)
        cost, supply, demand = np.zeros((len(a), len(b))), np.zeros(len(a)), np.zeros(len(b))
        cost[rows, columns] = frame["distance"]
        supply[rows], demand[columns] = frame["a_mass"], frame["b_mass"]
        return pd.DataFrame({"left": [key[0]], "right": [key[1]], "curvature": [1.0 - least_transport(supply, demand, cost)]})

    return closed.union(costs.groupBy("left", "right").applyInPandas(curve, f"left {kind}, right {kind}, curvature double"))


def branching(nodes: DataFrame, tree: str) -> DataFrame:
    """Of each tree of nodes(tree, node, parent): nodes, leaf fraction, mean and most children of inner nodes, and the entropy of child counts."""
    children = nodes.where("parent IS NOT NULL").groupBy(tree, F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    counts = nodes.select(tree, "node").join(children, [tree, "node"], "left").na.fill(0, ["children"])
    levels = counts.groupBy(tree, "children").agg(F.count("*").alias("n"))
    n, c = F.sum("n"), F.col("children")
    whole = levels.groupBy(tree).agg(n.alias("nodes"), (F.sum(F.when(c == 0, F.col("n")).otherwise(0)) / n).alias("leaf_fraction"), F.coalesce(F.sum(c * F.col("n")) / F.sum(F.when(c > 0, F.col("n"))), F.lit(0.0)).alias("mean_branching"), F.max(c).alias("max_branching"), F.collect_list(F.col("n").cast("double")).alias("levels"))  # few counts a tree
    from lodestrata.operators.stats import entropy

    return whole.withColumn("branching_entropy", entropy(F.col("levels"))).drop("levels")


def diameters(nodes: DataFrame, tree: str) -> DataFrame:
    """tree and diameter of trees of nodes(tree, parts), parts being the steps from the root: the two deepest branches of some node, which meet there."""
    steps = F.explode(F.sequence(F.lit(0), F.size("parts")))
    above = nodes.select(tree, "parts", steps.alias("at"))
    branches = above.groupBy(tree, F.slice("parts", 1, F.col("at")).alias("top"), F.slice("parts", 1, F.col("at") + 1).alias("branch")).agg(F.max(F.size("parts") - F.col("at")).alias("height"))
    rank = F.row_number().over(Window.partitionBy(tree, "top").orderBy(F.desc("height")))
    two = branches.where("height > 0 OR size(top) = 0").withColumn("rank", rank).where("rank <= 2")
    return two.groupBy(tree, "top").agg(F.sum("height").alias("across")).groupBy(tree).agg(F.max("across").cast("double").alias("diameter"))


def tree_hyperbolicity(nodes: DataFrame, tree: str) -> DataFrame:
    """tree and hyperbolicity (the largest four_point_delta() over all fours of nodes) of trees of nodes(tree, parts): 0 if every node but one root hangs from a node that is there, else null.

    In a tree the two larger sums of opposite pairs of any four nodes are equal, so that no four need be made; whether it is one is counted.
    """
    own = nodes.select(tree, "parts").distinct()
    up = own.where("size(parts) > 0").select(tree, F.slice("parts", 1, F.size("parts") - 1).alias("parts"))
    hung = up.join(own, [tree, "parts"], "left_semi").groupBy(tree).agg(F.count("*").alias("hung"))
    counted = own.groupBy(tree).agg(F.count("*").alias("nodes")).join(hung, tree, "left")
    return counted.select(tree, F.when(F.coalesce("hung", F.lit(0)) == F.col("nodes") - 1, F.lit(0.0)).alias("hyperbolicity"))


#: Nodes of a block that is held against another.
NODES_A_BLOCK = 512


def stresses(nodes: DataFrame, tree: str) -> DataFrame:
    """tree, flat_stress, hyperbolic_stress and advantage: how far distances in the disk, best scaled, are from those in the tree, over all pairs of a tree's nodes.

    Nodes are placed by path_point(). Pairs are summed in blocks of nodes by blocks: a block gives five sums, and no task holds more than
    two blocks, whatever a tree's size. A tree of one node has stress 0.
    """
    placed = nodes.select(tree, "parts", path_point(F.col("parts")).alias("point"))
    sizes = nodes.groupBy(tree).agg(F.ceil(F.count("*") / NODES_A_BLOCK).alias("blocks"))
    rows = cut(placed.join(sizes, tree).withColumn("block", F.pmod(F.xxhash64("parts"), F.col("blocks"))))
    first = rows.select(tree, "parts", "point", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"))
    second = rows.select(F.col(tree).alias("of"), "parts", "point", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("k"), F.col("block").alias("l"))
    kind = dict(nodes.dtypes)[tree]

    def ways(parts: pd.Series, deep: int, known: dict) -> np.ndarray:
        """The number of each prefix of each path, 0 where it is shorter."""
        out = np.zeros((len(parts), deep), np.int64)
        for row, p in enumerate(parts):
            for d in range(len(p)):
                out[row, d] = known.setdefault(tuple(p[: d + 1]), len(known) + 1)
        return out

    def sums(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({tree: [], "d": [], "fd": [], "ff": [], "hd": [], "hh": []})
        deep = max(1, *(len(p) for p in left["parts"]), *(len(p) for p in right["parts"]))
        known: dict = {}
        a, b = ways(left["parts"], deep, known), ways(right["parts"], deep, known)
        shared = ((a[:, None] == b[None]) & (a[:, None] > 0)).sum(2)
        d = (a > 0).sum(1)[:, None] + (b > 0).sum(1)[None] - 2.0 * shared
        x, y = np.stack(left["point"].to_numpy()), np.stack(right["point"].to_numpy())
        flat = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
        room = (1 - (x * x).sum(1))[:, None] * (1 - (y * y).sum(1))[None]
        curved = np.arccosh(1 + 2 * flat**2 / np.maximum(room, 1e-15))
        share = 0.5 if key[1] == key[2] else 1.0  # a block against itself has every pair twice
        found = [share * float((u * v).sum()) for u, v in ((d, d), (flat, d), (flat, flat), (curved, d), (curved, curved))]
        return pd.DataFrame([[key[0], *found]], columns=[tree, "d", "fd", "ff", "hd", "hh"])

    parts = first.groupBy(tree, "i", "j").cogroup(second.groupBy("of", "k", "l")).applyInPandas(sums, f"{tree} {kind}, d double, fd double, ff double, hd double, hh double")
    whole = parts.groupBy(tree).agg(*[F.sum(c).alias(c) for c in ("d", "fd", "ff", "hd", "hh")])
    tiny = F.lit(1e-12)
    off = lambda de, ee: F.sqrt(F.greatest(F.col("d") - F.col(de) * F.col(de) / F.greatest(F.col(ee), tiny), F.lit(0.0)) / F.greatest(F.col("d"), tiny))
    out = whole.select(tree, off("fd", "ff").alias("flat_stress"), off("hd", "hh").alias("hyperbolic_stress"))
    return out.withColumn("advantage", (F.col("flat_stress") - F.col("hyperbolic_stress")) / F.greatest("flat_stress", "hyperbolic_stress", tiny))


def profiles(nodes: DataFrame, tree: str) -> DataFrame:
    """Of each tree of nodes(tree, node, parent, depth, parts): edges, depth, diameter, branching() and stresses(). Four-point deltas of a tree are 0, and are left out."""
    shape = branching(nodes, tree)
    deep = nodes.groupBy(tree).agg((F.count("*") - 1).alias("edges"), F.max("depth").alias("max_depth"))
    return shape.join(deep, tree).join(diameters(nodes, tree), tree).join(stresses(nodes, tree), tree)


def profile_features(kind: str) -> list[Column]:
    """Columns of a profile for learning from: length, size, branching, distortion or all."""
    sets = {
        "length": [F.log1p("nodes").alias("log_nodes"), F.log1p("edges").alias("log_edges")],
        "size": [F.log1p("nodes").alias("log_nodes"), F.log1p("edges").alias("log_edges"), *[F.col(c).cast("double").alias(c) for c in ("max_depth", "diameter")]],
        "branching": [F.col(c).cast("double").alias(c) for c in ("leaf_fraction", "mean_branching", "max_branching", "branching_entropy")],
        "distortion": [F.col(c).alias(c) for c in ("flat_stress", "hyperbolic_stress", "advantage")],
    }
    if kind == "all":
        return [c for name in ("size", "branching", "distortion") for c in sets[name]]
    return sets[kind]
