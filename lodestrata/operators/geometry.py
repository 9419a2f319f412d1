"""Kernels on points of spaces of constant curvature, alone and as products, for weighted path objects.

A measure is an array of objects (rows) by factors by coordinates with a mass each. All is NumPy on one
pair of measures, to be called in Arrow batches; curvature c is 0 for flat space, else the ball of curvature -c.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.operators.transport import entropic_objective, exp0, log0, mobius_add, sinkhorn_plan

#: How close to the rim a point of the ball may lie.
RIM = 1e-5
#: Steps of a transport plan, at most: it ends once its sums are right.
ITERATIONS = 3000


def into_ball(x: np.ndarray, curvature: float) -> np.ndarray:
    """x, drawn in to just inside the ball where it lies on its rim or beyond; as it is in flat space."""
    if not curvature:
        return x
    length = np.linalg.norm(x, axis=-1, keepdims=True)
    return x * np.minimum(1.0, (1 - RIM) / np.sqrt(curvature) / np.maximum(length, 1e-15))


def apart(x: np.ndarray, y: np.ndarray, curvature: float) -> np.ndarray:
    """Geodesic distance over the last axis."""
    gap = np.linalg.norm(x - y, axis=-1)
    if not curvature:
        return gap
    room = (1 - curvature * (x * x).sum(-1)) * (1 - curvature * (y * y).sum(-1))
    return 2 / np.sqrt(curvature) * np.arcsinh(np.sqrt(curvature) * gap / np.sqrt(np.maximum(room, 1e-30)))


@dataclass
class Measure:
    """points: objects by factors by coordinates; mass: one each; side: features of the objects, and of their reversals."""

    points: np.ndarray
    mass: np.ndarray
    side: np.ndarray | None = None
    reversed_side: np.ndarray | None = None


@dataclass
class Product:
    """A product of factors, each with its curvature (one number: the same for all) and weight.

    unoriented: of three factors (common ancestor, start, end), the better of both orders of the ends counts.
    """

    curvature: float | tuple[float, ...] = 0.0
    weights: tuple[float, ...] = (1.0, 1.0, 1.0)
    side_weight: float = 1.0
    unoriented: bool = False
    curvatures: tuple[float, ...] = field(init=False)

    def __post_init__(self) -> None:
        self.curvatures = tuple(self.curvature) if isinstance(self.curvature, tuple) else (self.curvature,) * len(self.weights)
        if not self.weights or len(self.curvatures) != len(self.weights) or min(*self.weights, *self.curvatures, self.side_weight) < 0:
            raise ValueError("as many curvatures as weights are needed, none below 0")
        if self.unoriented and (len(self.weights) != 3 or self.weights[1] != self.weights[2] or self.curvatures[1] != self.curvatures[2]):
            raise ValueError("both ends must count alike")

    def ordered(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        parts = [w * apart(into_ball(x[:, None, i], c), into_ball(y[None, :, i], c), c) ** 2 for i, (w, c) in enumerate(zip(self.weights, self.curvatures, strict=True))]
        return np.sum(parts, 0)

    def side_cost(self, left: np.ndarray | None, right: np.ndarray | None) -> np.ndarray | float:
        if (left is None) != (right is None):
            raise ValueError("both measures have side features or neither has")
        return 0.0 if left is None else self.side_weight * ((left[:, None] - right[None]) ** 2).sum(-1)

    def cost(self, left: Measure, right: Measure) -> np.ndarray:
        """Cost of each object of left (rows) against each of right."""
        if left.points.shape[1:] != right.points.shape[1:] or left.points.shape[1] != len(self.weights):
            raise ValueError("measures differ in factors or coordinates")
        direct = self.ordered(left.points, right.points) + self.side_cost(left.side, right.side)
        if not self.unoriented:
            return direct
        turned = right.side if right.reversed_side is None else right.reversed_side
        return np.minimum(direct, self.ordered(left.points, right.points[:, [0, 2, 1]]) + self.side_cost(left.side, turned))

    def plan(self, left: Measure, right: Measure, epsilon: float) -> np.ndarray:
        return sinkhorn_plan(self.cost(left, right), left.mass, right.mass, epsilon, ITERATIONS)

    def scaled(self, measure: Measure, factors: tuple[float, ...]) -> Measure:
        """The measure with each factor's points scaled."""
        return Measure(measure.points * np.array(factors)[None, :, None], measure.mass, measure.side, measure.reversed_side)


def concatenated_cost(left: Measure, right: Measure, weights: tuple[float, ...]) -> np.ndarray:
    """Squared flat distance of objects whose factors, each weighted by a root, are joined to one vector."""
    join = lambda m: (m.points * np.sqrt(np.array(weights))[None, :, None]).reshape(len(m.points), -1)
    return ((join(left)[:, None] - join(right)[None]) ** 2).sum(-1)


def role_weights(pairs: list[tuple[Measure, Measure]]) -> np.ndarray:
    """Weights that give every factor the same median positive squared distance over the pairs; 1 where none is positive."""
    out = []
    for i in range(pairs[0][0].points.shape[1]):
        d = np.concatenate([(apart(a.points[:, None, i], b.points[None, :, i], 0.0) ** 2).ravel() for a, b in pairs])
        out.append(1 / np.median(d[d > 0]) if (d > 0).any() else 1.0)
    return np.array(out)


def matched_weights(weights: tuple[float, ...], curvatures: tuple[float, ...]) -> tuple[float, ...]:
    """Weights for flat factors that stand for curved ones near the centre, where the ball's distance is twice the flat one."""
    return tuple(w * (4.0 if not c else 1.0) for w, c in zip(weights, curvatures, strict=True))


def on_geodesic(x: np.ndarray, y: np.ndarray, shares: np.ndarray, curvature: float) -> np.ndarray:
    """Points at these shares of the way from x to y: by the tangent at x, scaled and mapped back."""
    if not curvature:
        return x + shares[:, None] * (y - x)
    tangent = log0(mobius_add(-x, y, curvature), curvature)
    return np.array([mobius_add(x, exp0(s * tangent, curvature), curvature) for s in shares])


def hausdorff(x: np.ndarray, y: np.ndarray, curvature: float) -> float:
    """The farthest that a point of either finite set lies from the other."""
    d = apart(x[:, None], y[None], curvature)
    return float(max(d.min(1).max(), d.min(0).max()))


def geodesic_hausdorff(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], curvature: float, count: int = 17) -> float:
    """Hausdorff distance of two geodesics, each by count points from end to end."""
    shares = np.linspace(0, 1, count)
    return hausdorff(on_geodesic(*left, shares, curvature), on_geodesic(*right, shares, curvature), curvature)


def gromov_product(x: np.ndarray, y: np.ndarray, base: np.ndarray, curvature: float) -> np.ndarray:
    """Half of what two points' distances from the base exceed their own by."""
    return (apart(x, base, curvature) + apart(y, base, curvature) - apart(x, y, curvature)) / 2


def end_product(start: tuple, end: tuple, curvature: float, weights: tuple[float, float] = (1.0, 1.0), unoriented: bool = False) -> np.ndarray:
    """Root of the weighted squared distances of two objects' starts and ends; unoriented: the lesser of both orders."""
    square = lambda a, b: weights[0] * apart(start[0], a, curvature) ** 2 + weights[1] * apart(end[0], b, curvature) ** 2
    direct = square(start[1], end[1])
    return np.sqrt(np.minimum(direct, square(end[1], start[1])) if unoriented else direct)


def cone_energy(apex: np.ndarray, point: np.ndarray, curvature: float = 1.0, k: float = 0.1) -> np.ndarray:
    """By how much the angle at apex between the outward ray and the way to point exceeds the apex's half aperture: 0 inside its cone."""
    c = np.sqrt(curvature)
    a, p = into_ball(apex * c, 1.0), into_ball(point * c, 1.0)
    aa, pp, ap = (a * a).sum(-1), (p * p).sum(-1), (a * p).sum(-1)
    half = np.arcsin(np.clip(k * (1 - aa) / np.sqrt(np.maximum(aa, 1e-15)), -1, 1))
    above = ap * (1 + aa) - aa * (1 + pp)
    below = np.sqrt(np.maximum(aa, 1e-15)) * np.linalg.norm(a - p, axis=-1) * np.sqrt(np.maximum(1 + aa * pp - 2 * ap, 1e-15))
    return np.maximum(0, np.arccos(np.clip(above / np.maximum(below, 1e-15), -1, 1)) - half)


def uniform_coupling(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.outer(left, right)


def permutation_coupling(left: np.ndarray, order: np.ndarray) -> np.ndarray:
    """All mass of left's i-th to right's order[i]-th."""
    out = np.zeros((len(left), len(left)))
    out[np.arange(len(left)), order] = left
    return out


def plan_diagnostics(plan: np.ndarray, left: np.ndarray, right: np.ndarray, tolerance: float = 1e-6) -> dict[str, float | bool]:
    """How far a plan's sums are from the masses, its mass, entropy and whether it is within tolerance."""
    row, column = float(np.abs(plan.sum(1) - left).max(initial=0)), float(np.abs(plan.sum(0) - right).max(initial=0))
    some = plan[plan > 0]
    return {"row_residual": row, "column_residual": column, "mass": float(plan.sum()), "entropy": float(-(some * np.log(some)).sum()), "feasible": max(row, column) <= tolerance}


def padded(measures: list[Measure]) -> tuple[np.ndarray, np.ndarray]:
    """Points and masses of several measures in one array, shorter ones filled with massless points at the centre."""
    most = max(len(m.points) for m in measures)
    points = np.zeros((len(measures), most, *measures[0].points.shape[1:]))
    mass = np.zeros((len(measures), most))
    for i, m in enumerate(measures):
        points[i, : len(m.points)], mass[i, : len(m.mass)] = m.points, m.mass
    return points, mass


def rounded_plans(plans: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Plans with exact sums: rows, then columns are scaled down to their masses, and what is missing goes in as one rank."""
    rows = np.minimum(1, left / np.maximum(plans.sum(2), 1e-300))
    out = plans * rows[:, :, None]
    out = out * np.minimum(1, right / np.maximum(out.sum(1), 1e-300))[:, None]
    a, b = left - out.sum(2), right - out.sum(1)
    total = np.maximum(a.sum(1), 1e-300)
    return out + a[:, :, None] * b[:, None] / total[:, None, None]


def product_cost(left: Column, right: Column, factors: int, curvature: float) -> Column:
    """Sum of squared geodesic distances of two objects, each an array of factors times coordinates: batches of pairs at once."""

    @F.pandas_udf("double")
    def cost(xs: pd.Series, ys: pd.Series) -> pd.Series:
        x, y = (into_ball(np.stack(v.to_numpy()).astype("f8").reshape(len(v), factors, -1), curvature) for v in (xs, ys))
        return pd.Series((apart(x, y, curvature) ** 2).sum(1))

    return cost(left, right)


def divergence(left: Column, right: Column, factors: int, curvature: float, epsilon: float, unoriented: bool = False) -> Column:
    """Debiased transport distance of two uniform measures: arrays of objects, each an array of factors times coordinates."""
    product = Product(curvature, (1.0,) * factors, unoriented=unoriented)

    @F.pandas_udf("double")
    def diverge(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys, strict=True):
            if x is None or y is None or not len(x) or not len(y):
                out.append(None)
                continue
            a, b = (Measure(p.reshape(len(p), factors, -1), np.full(len(p), 1 / len(p))) for p in (np.array([list(r) for r in v], float) for v in (x, y)))
            out.append(float(sinkhorn_divergence_of(product, a, b, epsilon)))
        return pd.Series(out, dtype="float64")

    return diverge(left, right)


def sinkhorn_divergence_of(product: Product, left: Measure, right: Measure, epsilon: float) -> float:
    """Entropic cost of left against right, less half of each against itself; not below 0."""

    def value(a: Measure, b: Measure) -> float:
        cost = product.cost(a, b)
        return entropic_objective(sinkhorn_plan(cost, a.mass, b.mass, epsilon, ITERATIONS), cost, a.mass, b.mass, epsilon)

    return max(0.0, value(left, right) - (value(left, left) + value(right, right)) / 2)
