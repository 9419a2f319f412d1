"""Optimal transport between small measures: NumPy kernels, and their use over tables in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def sinkhorn_plan(cost: np.ndarray, a: np.ndarray, b: np.ndarray, epsilon: float = 0.1, iterations: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Entropic plan in the log domain, then rounded so that its marginals are exact."""
    log_a, log_b, k = np.log(np.maximum(a, 1e-300)), np.log(np.maximum(b, 1e-300)), -cost / epsilon
    f, g = np.zeros(len(a)), np.zeros(len(b))
    for _ in range(iterations):
        f = log_a - logsumexp(k + g[None], 1)
        g = log_b - logsumexp(k + f[:, None], 0)
        if np.abs(np.exp(k + f[:, None] + g[None]).sum(1) - a).max() < tolerance:
            break
    return rounded_plan(np.exp(k + f[:, None] + g[None]), a, b)


def rounded_plan(plan: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A near plan scaled down to its marginals, and what is missing added as one rank-one term."""
    plan = plan * np.minimum(1, a / np.maximum(plan.sum(1), 1e-300))[:, None]
    plan = plan * np.minimum(1, b / np.maximum(plan.sum(0), 1e-300))[None]
    left, right = a - plan.sum(1), b - plan.sum(0)
    rest = left.sum()
    return plan + (np.outer(left, right) / rest if rest > 1e-15 else 0)


def entropic_objective(plan: np.ndarray, cost: np.ndarray, a: np.ndarray, b: np.ndarray, epsilon: float) -> float:
    """Transport cost and epsilon times the divergence of the plan from the product of its marginals."""
    whole = np.outer(a, b)
    used = plan > 0
    return float((plan * cost).sum() + epsilon * (plan[used] * np.log(plan[used] / whole[used])).sum())


def sinkhorn_divergence(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, epsilon: float = 0.1, iterations: int = 200) -> float:
    """Debiased divergence of two weighted point sets under squared Euclidean cost, not below zero."""
    cost = lambda p, q: ((p[:, None] - q[None]) ** 2).sum(-1)

    def value(p, q, u, v):
        c = cost(p, q)
        return entropic_objective(sinkhorn_plan(c, u, v, epsilon, iterations), c, u, v, epsilon)

    return max(0.0, value(x, y, a, b) - (value(x, x, a, a) + value(y, y, b, b)) / 2)


#: How much the order of objects weighs in a first plan, as a share of epsilon.
TILT = 0.1


def views(distances: np.ndarray, mass: np.ndarray, count: int = 64) -> np.ndarray:
    """The distances that each object sees, by mass, as count quantiles."""
    shares = (np.arange(count) + 0.5) / count
    order = np.argsort(distances, axis=1, kind="stable")
    upto = np.cumsum(mass[order], axis=1) / max(mass.sum(), 1e-300)
    at = np.minimum([np.searchsorted(u, shares) for u in upto], len(mass) - 1)
    return np.take_along_axis(np.take_along_axis(distances, order, 1), np.asarray(at), 1)


@dataclass
class Fused:
    """A fused Gromov-Wasserstein plan: objective, its two terms, the objective of every round, and how far the plan's sums are off."""

    plan: np.ndarray
    objective: float
    structure: float
    feature: float
    residual: float
    history: list[float]


def validated(plan: np.ndarray, a: np.ndarray, b: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """The plan, if it is a coupling of a and b; else an error."""
    if plan.shape != (len(a), len(b)) or not np.isfinite(plan).all() or plan.min(initial=0) < -1e-15:
        raise ValueError("not a plan between these masses")
    if max(np.abs(plan.sum(1) - a).max(initial=0), np.abs(plan.sum(0) - b).max(initial=0)) > tolerance:
        raise ValueError("the plan's sums are not the masses")
    return plan


def structure_gap(left: np.ndarray, right: np.ndarray, plan: np.ndarray) -> float:
    """Mean squared difference of distances between objects that the plan carries to each other, without listing fours."""
    a, b = plan.sum(1), plan.sum(0)
    return float(a @ left**2 @ a + b @ right**2 @ b - 2 * (left @ plan @ right.T * plan).sum())


def fused_gromov_wasserstein(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, features: np.ndarray | None = None, alpha: float = 0.5, epsilon: float = 0.05, rounds: int = 200, start: np.ndarray | None = None, tolerance: float = 1e-10) -> Fused:
    """Fused Gromov-Wasserstein by mirror descent: plans whose objective, alpha of structure and the rest of features, falls from round to round.

    A round is an entropic plan for the objective's slope with the plan before it as its prior, which draws less and less back to
    the product of masses; a round that would raise the objective is tried again with a shorter step. It ends when it
    falls by less than tolerance. Masses that do not fit, or a start that does not have them, are an error.
    """
    a, b = np.asarray(a, float), np.asarray(b, float)
    if not 0 <= alpha <= 1 or epsilon <= 0 or rounds < 1:
        raise ValueError("alpha is in 0 to 1, epsilon above 0 and rounds 1 at least")
    if left.shape != (len(a), len(a)) or right.shape != (len(b), len(b)) or a.min(initial=0) < 0 or b.min(initial=0) < 0 or abs(a.sum() - b.sum()) > 1e-9:
        raise ValueError("distances and masses do not fit")
    feature = np.zeros((len(a), len(b))) if features is None else np.asarray(features, float)
    if feature.shape != (len(a), len(b)):
        raise ValueError("features do not fit the masses")
    if start is None:
        # objects that see other distances around them start apart, even without features, and twins by their order: else no slope tells them apart
        seen = ((views(left, a)[:, None] - views(right, b)[None]) ** 2).mean(2)
        order = np.abs(np.arange(len(a))[:, None] / max(len(a), 1) - np.arange(len(b))[None] / max(len(b), 1))
        start = sinkhorn_plan((1 - alpha) * feature + alpha * seen + TILT * epsilon * order, a, b, epsilon)
    plan = validated(start, a, b)
    terms = lambda p: (structure_gap(left, right, p), float((p * feature).sum()))
    value = lambda p: alpha * terms(p)[0] + (1 - alpha) * terms(p)[1]
    fixed = (left**2 @ a)[:, None] + (right**2 @ b)[None]
    history = [value(plan)]
    for _ in range(rounds):
        slope = 2 * alpha * (fixed - 2 * left @ plan @ right.T) + (1 - alpha) * feature
        step, better = epsilon, None
        for _ in range(20):
            tried = validated(sinkhorn_plan(slope / step - np.log(np.maximum(plan, 1e-300)), a, b, 1.0), a, b)
            if value(tried) <= history[-1]:
                better = tried
                break
            step *= 2
        if better is None:
            break
        plan = better
        history.append(value(plan))
        if history[-2] - history[-1] < tolerance:
            break
    structure, own = terms(plan)
    residual = max(np.abs(plan.sum(1) - a).max(initial=0), np.abs(plan.sum(0) - b).max(initial=0))
    return Fused(plan, history[-1], max(structure, 0.0), own, float(residual), history)


def gromov_wasserstein(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, epsilon: float = 0.05, rounds: int = 200, features: np.ndarray | None = None, alpha: float = 1.0) -> tuple[float, np.ndarray]:
    """Objective and coupling of fused_gromov_wasserstein(), of structure alone unless alpha says otherwise."""
    found = fused_gromov_wasserstein(left, right, a, b, features, alpha, epsilon, rounds)
    return max(found.objective, 0.0), found.plan


def exact_transport_1d(x: np.ndarray, y: np.ndarray) -> float:
    """Wasserstein-1 of two equally weighted samples on a line."""
    grid = np.sort(np.concatenate([x, y]))
    share = lambda s: np.searchsorted(np.sort(s), grid[:-1], "right") / len(s)
    return float((np.abs(share(x) - share(y)) * np.diff(grid)).sum())


def mobius_add(x: np.ndarray, y: np.ndarray, c: float) -> np.ndarray:
    xy, xx, yy = x @ y, x @ x, y @ y
    return ((1 + 2 * c * xy + c * yy) * x + (1 - c * xx) * y) / max(1 + 2 * c * xy + c * c * xx * yy, 1e-15)


def exp0(v: np.ndarray, c: float) -> np.ndarray:
    n = np.sqrt(c) * np.linalg.norm(v)
    return v if n < 1e-15 else np.tanh(n) * v / n


def log0(x: np.ndarray, c: float) -> np.ndarray:
    n = np.sqrt(c) * np.linalg.norm(x)
    return x if n < 1e-15 else np.arctanh(min(n, 1 - 1e-15)) * x / n


def divergence(left: Column, right: Column, epsilon: float = 0.1, iterations: int = 200) -> Column:
    """Sinkhorn divergence of two point sets, array<array<double>> with equal masses; null where either is empty."""

    @F.pandas_udf("double")
    def between(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys, strict=True):
            p, q = (np.array([np.asarray(r) for r in s], float) if s is not None and len(s) else None for s in (x, y))
            out.append(None if p is None or q is None else sinkhorn_divergence(p, q, np.full(len(p), 1 / len(p)), np.full(len(q), 1 / len(q)), epsilon, iterations))
        return pd.Series(out, dtype="float64")

    return between(left, right)


def top_alignments(left: Column, right: Column, k: int = 5, epsilon: float = 0.1) -> Column:
    """The k heaviest cells of the plan between two point sets: i, j, mass, cost, by (-mass, cost, i, j)."""

    @F.pandas_udf("array<struct<i: int, j: int, mass: double, cost: double>>")
    def cells(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys, strict=True):
            if x is None or y is None or not len(x) or not len(y):
                out.append(None if x is None or y is None else [])
                continue
            p, q = (np.array([np.asarray(r) for r in s], float) for s in (x, y))
            cost = ((p[:, None] - q[None]) ** 2).sum(-1)
            plan = sinkhorn_plan(cost, np.full(len(p), 1 / len(p)), np.full(len(q), 1 / len(q)), epsilon)
            rows = sorted((-plan[i, j], cost[i, j], i, j) for i in range(len(p)) for j in range(len(q)))[:k]
            out.append([{"i": i, "j": j, "mass": float(-m), "cost": float(c)} for m, c, i, j in rows])
        return pd.Series(out, dtype=object)

    return cells(left, right)
