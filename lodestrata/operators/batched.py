"""Transport between many measures at once: padded problems in one iteration, self terms computed once, blocks of queries by blocks of a gallery.

A measure is a row: id, objects (arrays of factors times coordinates) and their masses, equal ones where none are given.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.geometry import ITERATIONS, Measure, Product, apart, into_ball, padded, rounded_plans
from lodestrata.operators.graphs import cut

#: Measures of a block, and problems that are iterated together.
BLOCK, TOGETHER = 128, 256
#: How near a plan's sums come to the masses before it is rounded.
TOLERANCE = 1e-12


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    """Over one axis; of nothing but minus infinities it is minus infinity."""
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def sinkhorn_plans(cost: np.ndarray, a: np.ndarray, b: np.ndarray, epsilon: float, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Entropic plans of a stack of problems, padded with massless rows and columns: every problem leaves the iteration when its own sums are right.

    The plans are rounded, so that their sums are exact.
    """
    if epsilon <= 0:
        raise ValueError("epsilon must be above 0")
    if np.abs(a.sum(1) - b.sum(1)).max(initial=0) > 1e-9:
        raise ValueError("the masses of a problem differ in sum")
    with np.errstate(divide="ignore"):
        log_a, log_b = np.log(a), np.log(b)
    kernel, f, g = -cost / epsilon, np.zeros_like(a), np.where(b > 0, 0.0, -np.inf)
    f[a == 0] = -np.inf
    going = np.arange(len(cost))
    for _ in range(iterations):
        k, gg = kernel[going], g[going]
        ff = log_a[going] - np.where(a[going] > 0, logsumexp(k + gg[:, None], 2), 0.0)
        gg = log_b[going] - np.where(b[going] > 0, logsumexp(k + ff[:, :, None], 1), 0.0)
        f[going], g[going] = ff, gg
        off = np.abs(np.exp(k + ff[:, :, None] + gg[:, None]).sum(2) - a[going]).max(1)
        going = going[off >= tolerance]
        if not len(going):
            break
    return rounded_plans(np.exp(kernel + f[:, :, None] + g[:, None]), a, b)


def costs(product: Product, left: list[Measure], right: list[Measure]) -> np.ndarray:
    """Costs of pairs of measures by the product's distances, all at once; rows and columns of padding are 0."""
    (x, a), (y, b) = padded(left), padded(right)

    def ordered(y: np.ndarray) -> np.ndarray:
        parts = [w * apart(into_ball(x[:, :, None, i], c), into_ball(y[:, None, :, i], c), c) ** 2 for i, (w, c) in enumerate(zip(product.weights, product.curvatures, strict=True))]
        return np.sum(parts, 0)

    def sides(which: str) -> np.ndarray | float:
        if left[0].side is None:
            return 0.0
        u, v = (np.zeros((len(ms), m, left[0].side.shape[1])) for ms, m in ((left, x.shape[1]), (right, y.shape[1])))
        for i, (l, r) in enumerate(zip(left, right, strict=True)):  # noqa: E741
            own = r.side if which == "side" or r.reversed_side is None else r.reversed_side
            u[i, : len(l.side)], v[i, : len(own)] = l.side, own
        return product.side_weight * ((u[:, :, None] - v[:, None]) ** 2).sum(-1)

    out = ordered(y) + sides("side")
    if product.unoriented:
        out = np.minimum(out, ordered(y[:, :, [0, 2, 1]]) + sides("reversed"))
    there = (np.arange(x.shape[1])[None] < np.array([len(m.points) for m in left])[:, None])[:, :, None] & (np.arange(y.shape[1])[None] < np.array([len(m.points) for m in right])[:, None])[:, None]
    return np.where(there, out, 0.0)


def objectives(product: Product, left: list[Measure], right: list[Measure], epsilon: float) -> np.ndarray:
    """Entropic objective of each pair: cost of its plan, and epsilon times the plan's divergence from the product of the masses."""
    out = []
    for i in range(0, len(left), TOGETHER):
        xs, ys = left[i : i + TOGETHER], right[i : i + TOGETHER]
        cost, a, b = costs(product, xs, ys), padded(xs)[1], padded(ys)[1]
        plan = sinkhorn_plans(cost, a, b, epsilon)
        whole = a[:, :, None] * b[:, None]
        some = plan > 0
        log = np.zeros_like(plan)
        log[some] = np.log(plan[some] / whole[some])
        out.append((plan * cost).sum((1, 2)) + epsilon * (plan * log).sum((1, 2)))
    return np.concatenate(out) if out else np.zeros(0)


def measures(points: pd.Series, factors: int) -> list[Measure]:
    arrays = [np.array([np.asarray(r, float) for r in p]) for p in points]
    return [Measure(p.reshape(len(p), factors, -1), np.full(len(p), 1 / len(p))) for p in arrays]


def self_terms(rows: DataFrame, product: Product, epsilon: float, points: str = "points") -> DataFrame:
    """rows with self_term: the objective of each measure against itself, once a measure; null for a measure without objects."""
    factors = len(product.weights)

    @F.pandas_udf("double")
    def term(values: pd.Series) -> pd.Series:
        out, some = pd.Series(np.nan, values.index), values[[v is not None and len(v) > 0 for v in values]]
        if len(some):
            own = measures(some, factors)
            out[some.index] = objectives(product, own, own, epsilon)
        return out

    value = term(F.col(points))
    return rows.withColumn("self_term", F.when(F.size(points) > 0, value))


def divergences(queries: DataFrame, gallery: DataFrame, product: Product, epsilon: float, most: int | None = None, id: str = "id", points: str = "points") -> DataFrame:
    """query, item and distance: the debiased divergence, not below 0, of each query from each item of the gallery; most: that many nearest of each query, by distances of nine digits, ties by item.

    Self terms are taken from a column self_term, or computed once a measure, before anything is paired. Blocks of queries, BLOCK each, meet blocks of the gallery, one
    task a pair of blocks; with most, a block hands on only what can be among the nearest. Measures without objects are left out.
    """
    sides = []
    for rows, name in ((queries, "query"), (gallery, "item")):
        own = rows.select(F.col(id).alias(name), F.col(points).alias("points"), *[c for c in rows.columns if c == "self_term"])
        own = cut((own if "self_term" in own.columns else self_terms(own, product, epsilon)).where("self_term IS NOT NULL"))
        sides.append((own, max(1, -(-own.count() // BLOCK))))
    (asked, q), (there, g) = sides
    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select("*", block("query", q).alias("qb"), every(g).alias("gb"))
    there = there.select("*", every(q).alias("at_qb"), block("item", g).alias("at_gb"))
    factors = len(product.weights)
    kinds = {n: dict(s.dtypes)[n] for s, n in ((asked, "query"), (there, "item"))}

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": left["query"][:0], "item": right["item"][:0], "distance": np.zeros(0)})
        xs, ys = measures(left["points"], factors), measures(right["points"], factors)
        out = []
        for i, x in enumerate(xs):
            cross = objectives(product, [x] * len(ys), ys, epsilon)
            far = np.maximum(cross - (left["self_term"].iloc[i] + right["self_term"].to_numpy()) / 2, 0)
            found = pd.DataFrame({"query": [left["query"].iloc[i]] * len(ys), "item": right["item"].to_numpy(), "distance": far})
            out.append(found if most is None else found.assign(near=far.round(9)).sort_values(["near", "item"]).head(most).drop(columns="near"))
        return pd.concat(out)

    found = asked.groupBy("qb", "gb").cogroup(there.groupBy("at_qb", "at_gb")).applyInPandas(compare, f"query {kinds['query']}, item {kinds['item']}, distance double")
    if most is None:
        return found
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("distance", 9), "item"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def relation_space(relations: np.ndarray) -> np.ndarray:
    """One distance of several relation matrices: each by its largest value, then their mean."""
    tops = relations.max((1, 2), keepdims=True)
    return (relations / np.where(tops > 1e-12, tops, 1.0)).mean(0)


def fused_distances(left: str, right: str, alpha: float = 0.5, epsilon: float = 0.05) -> Column:
    """objective, structure, feature and residual of the fused Gromov-Wasserstein plan between two columns of spaces.

    A space is a struct of d (its distances, an array of rows) and tokens (an array of token sets, one an object); the features of two objects
    differ by the Jaccard distance of their tokens. Null where a space is null or empty.
    """
    from lodestrata.operators.transport import fused_gromov_wasserstein

    @F.pandas_udf("objective double, structure double, feature double, residual double, rounds int")
    def solve(dx: pd.Series, tx: pd.Series, dy: pd.Series, ty: pd.Series) -> pd.DataFrame:
        out = []
        for a, p, b, q in zip(dx, tx, dy, ty, strict=True):
            if a is None or b is None or not len(a) or not len(b):
                out.append((None,) * 5)
                continue
            x, y = (np.array([np.asarray(r, float) for r in d]) for d in (a, b))
            feature = np.array([[jaccard_distance(set(s), set(t)) for t in q] for s in p])
            got = fused_gromov_wasserstein(x, y, np.full(len(x), 1 / len(x)), np.full(len(y), 1 / len(y)), feature, alpha, epsilon)
            out.append((got.objective, got.structure, got.feature, got.residual, len(got.history) - 1))
        return pd.DataFrame(out, columns=["objective", "structure", "feature", "residual", "rounds"])

    return solve(f"{left}.d", f"{left}.tokens", f"{right}.d", f"{right}.tokens")


def jaccard_distance(left: set[str], right: set[str]) -> float:
    return 1 - len(left & right) / len(left | right) if left or right else 0.0


def path_spaces(relations: DataFrame, tokens: DataFrame, tree: str, names: tuple[str, ...]) -> DataFrame:
    """tree and its space: of relations(tree, left, right, ...) the named ones, joined by relation_space(), and tokens(tree, path_index, tokens)."""
    objects = tokens.groupBy(tree).agg(F.sort_array(F.collect_list(F.struct("path_index", "tokens"))).alias("objects"))  # as many as paths were drawn
    pairs = relations.groupBy(tree).agg(F.collect_list(F.struct("left", "right", F.array(*[F.col(n).cast("double") for n in names]).alias("v"))).alias("pairs"))

    @F.pandas_udf("array<array<double>>")
    def space(objects: pd.Series, pairs: pd.Series) -> pd.Series:
        out = []
        for own, found in zip(objects, pairs, strict=True):
            at = {o["path_index"]: i for i, o in enumerate(own)}
            d = np.zeros((len(names), len(own), len(own)))
            for p in found if found is not None else ():
                i, j = at[p["left"]], at[p["right"]]
                d[:, i, j] = d[:, j, i] = p["v"]
            out.append(relation_space(d).tolist())
        return pd.Series(out, dtype=object)

    whole = objects.join(pairs, tree, "left")
    return whole.select(tree, F.struct(space("objects", "pairs").alias("d"), F.col("objects.tokens").alias("tokens")).alias("space"))

