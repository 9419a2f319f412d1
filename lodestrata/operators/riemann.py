"""Maps and means of the ball of curvature -c, row by row in batches, and their means over tables.

c is 0 for flat space. A point on or beyond the rim is an error of the caller; results are drawn in to just inside it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.geometry import apart, into_ball
from lodestrata.operators.graphs import cut, discard

SMALL = 1e-15


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(-1, keepdims=True)


def added(x: np.ndarray, y: np.ndarray, c: float) -> np.ndarray:
    """Möbius sum of rows."""
    xy, xx, yy = dot(x, y), dot(x, x), dot(y, y)
    return ((1 + 2 * c * xy + c * yy) * x + (1 - c * xx) * y) / np.maximum(1 + 2 * c * xy + c * c * xx * yy, SMALL)


def scaled(r: np.ndarray | float, x: np.ndarray, c: float) -> np.ndarray:
    """Möbius product of numbers with rows: that many times as far from the centre."""
    if not c:
        return r * x
    n = np.maximum(np.sqrt(c) * np.linalg.norm(x, axis=-1, keepdims=True), SMALL)
    return np.tanh(r * np.arctanh(np.minimum(n, 1 - 1e-15))) * x / n


def exp_map(x: np.ndarray, v: np.ndarray, c: float) -> np.ndarray:
    """The point that the geodesic from x with tangent v reaches."""
    if not c:
        return x + v
    n = np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), SMALL)
    half = np.sqrt(c) * n / np.maximum(1 - c * dot(x, x), SMALL)  # half the conformal factor times the length
    return into_ball(added(x, np.tanh(half) * v / (np.sqrt(c) * n), c), c)


def log_map(x: np.ndarray, y: np.ndarray, c: float) -> np.ndarray:
    """The tangent at x of the geodesic to y."""
    if not c:
        return y - x
    d = added(-x, y, c)
    n = np.maximum(np.linalg.norm(d, axis=-1, keepdims=True), SMALL)
    return np.maximum(1 - c * dot(x, x), SMALL) / np.sqrt(c) * np.arctanh(np.minimum(np.sqrt(c) * n, 1 - 1e-15)) * d / n


def midpoint(x: np.ndarray, y: np.ndarray, c: float) -> np.ndarray:
    return exp_map(x, log_map(x, y, c) / 2, c)


def transported(x: np.ndarray, y: np.ndarray, v: np.ndarray, c: float) -> np.ndarray:
    """Tangent v at x carried along the geodesic to y."""
    if not c:
        return v
    a, b, w = -x, y, v  # the gyration of y and -x, scaled by the conformal factors
    turned = added(-added(b, a, c), added(b, added(a, scale_down(w), c), c), c)
    return turned / SCALE * np.maximum(1 - c * dot(y, y), SMALL) / np.maximum(1 - c * dot(x, x), SMALL)


#: Tangents are turned as points this much nearer to the centre, where the gyration acts linearly.
SCALE = 1e-3


def scale_down(v: np.ndarray) -> np.ndarray:
    return v * SCALE


def lifted(x: np.ndarray, c: float) -> np.ndarray:
    """Points of the ball on the hyperboloid: the first coordinate is time."""
    xx, root = c * dot(x, x), np.sqrt(c)
    return np.concatenate([(1 + xx) / (1 - xx) / root, 2 * x / (1 - xx)], -1)


def lowered(p: np.ndarray, c: float) -> np.ndarray:
    """Points of the hyperboloid in the ball."""
    return p[..., 1:] / (1 + np.sqrt(c) * p[..., :1])


def lorentz_distance(p: np.ndarray, q: np.ndarray, c: float) -> np.ndarray:
    inner = -p[..., 0] * q[..., 0] + (p[..., 1:] * q[..., 1:]).sum(-1)
    return np.arccosh(np.maximum(-c * inner, 1.0)) / np.sqrt(c)


def frechet_means(rows: DataFrame, group: str, point: str, curvature: float, rounds: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """group, n, mean (array), spread (mean squared distance) and gradient (length of the mean tangent): the point of least spread of each group.

    A round joins every point with its group's mean, sums tangents within each task and then over tasks, and goes along
    their mean, as far as the mean curvature of the squared distances allows; until no group's gradient is longer than tolerance. Rows
    with a null group or point take no part. Only a row a group goes from round to round, through a written table.
    """
    data = rows.where(F.col(group).isNotNull() & F.col(point).isNotNull()).select(F.col(group).alias("g"), F.transform(point, lambda x: x.cast("double")).alias("p"))
    data = cut(data)
    kind = dict(data.dtypes)["g"]

    def tangents(frames):
        sums: dict = {}
        for f in frames:
            x, m = np.stack(f["p"].to_numpy()), np.stack(f["mean"].to_numpy())
            far = apart(x, m, curvature)
            bend = np.sqrt(curvature) * far
            bend = np.where(bend > 1e-6, bend / np.tanh(np.maximum(bend, 1e-6)), 1.0)
            whole = np.concatenate([log_map(m, x, curvature), far[:, None] ** 2, bend[:, None], np.ones((len(f), 1))], 1)
            for g, index in f.groupby("g").indices.items():
                own = whole[index].sum(0)
                sums[g] = sums[g] + own if g in sums else own
        if sums:
            yield pd.DataFrame({"g": list(sums), "s": [s.tolist() for s in sums.values()]})

    def stepped(mean: pd.Series, s: pd.Series) -> pd.DataFrame:
        m, s = np.stack(mean.to_numpy()), np.stack(s.to_numpy())
        n = s[:, -1:]
        tangent = s[:, :-3] / n
        # the length of a tangent is by the conformal factor of its point
        length = np.linalg.norm(tangent, axis=1) * (2 / np.maximum(1 - curvature * (m * m).sum(1), SMALL) if curvature else 1.0)
        moved = exp_map(m, tangent / np.maximum(s[:, -2:-1] / n, 1.0), curvature)
        return pd.DataFrame({"mean": moved.tolist(), "at": m.tolist(), "n": n[:, 0].astype("i8"), "spread": s[:, -3] / n[:, 0], "gradient": length})

    step = F.pandas_udf(stepped, "mean array<double>, at array<double>, n long, spread double, gradient double")
    means = data.groupBy("g").agg(F.max(F.size("p")).alias("k")).select("g", F.array_repeat(F.lit(0.0), F.col("k")).alias("mean"))
    for _ in range(rounds):
        part = data.join(means.select("g", "mean"), "g").mapInPandas(tangents, f"g {kind}, s array<double>")
        total = part.select("g", F.posexplode("s")).groupBy("g", "pos").agg(F.sum("col").alias("v")).groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("s"))
        found = cut(total.join(means.select("g", "mean"), "g").select("g", step("mean", "s").alias("r")).select("g", "r.*"))
        discard(means)
        means = found
        if not found.where(F.col("gradient") > tolerance).limit(1).count():
            break
    else:
        raise ValueError(f"the means have not settled in {rounds} rounds")
    return means.select(F.col("g").alias(group), "n", F.col("at").alias("mean"), "spread", "gradient")
