"""Ranks, tests, corrections and resampling as window and aggregate plans."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.ordered import running, running_best


def by_value(df: DataFrame, value: str) -> DataFrame:
    """value, n: the counts that rank statistics need; repeated values are one row before they meet."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))


def average_ranks(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """df with 1-based ranks of value (within by), ties at their mean; ranks are taken over distinct values."""
    keys = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    if keys:
        before = F.sum("__n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
        counts = counts.withColumn("__before", before)
    else:
        counts = running(counts, [value], {"__before": F.col("__n")}).withColumn("__before", F.col("__before").cast("long"))
    ranks = counts.select(*keys, value, (F.col("__before") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ranks, [*keys, value], "left")


def spearman(df: DataFrame, left: str, right: str) -> Column:
    """rho of two columns: the correlation of their average ranks, 0 where either does not vary."""
    whole = df.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    rows = average_ranks(average_ranks(whole, left, "r_left"), right, "r_right")
    varies = (F.stddev_pop("r_left") > 1e-12) & (F.stddev_pop("r_right") > 1e-12)
    return rows.agg(F.count("*").alias("n"), F.when(varies, F.corr("r_left", "r_right")).otherwise(F.lit(0.0)).alias("rho"))


def binary_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """auc over label 1 against 0, ties one half, from rank sums; null without both labels."""
    rows = average_ranks(df.where(F.col(score).isNotNull() & F.col(label).isin(0, 1)), score, "__rank")
    pos = F.sum(F.col(label).cast("long"))
    neg = F.count("*") - pos
    return rows.agg(F.count("*").alias("n"), pos.alias("positives"), F.when((pos > 0) & (neg > 0), (F.sum(F.when(F.col(label) == 1, F.col("__rank"))) - pos * (pos + 1) / 2) / (pos * neg)).alias("auc"))


def holm(df: DataFrame, p: str, key: str, by: list[str]) -> DataFrame:
    """df with p_holm: step-down p-values, the running maximum of (m - rank + 1) p, at most 1, within by."""
    order = Window.partitionBy(*by).orderBy(p, key)
    m = F.count("*").over(Window.partitionBy(*by))
    df = df.withColumn("__step", (m - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("p_holm", F.least(F.lit(1.0), F.max("__step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__step")


def benjamini_hochberg(df: DataFrame, p: str, key: str, by: list[str]) -> DataFrame:
    """df with q_bh: the running minimum, from the largest, of p m / rank, at most 1, within by."""
    up, down = Window.partitionBy(*by).orderBy(p, key), Window.partitionBy(*by).orderBy(F.desc(p), F.desc(key))
    m = F.count("*").over(Window.partitionBy(*by))
    df = df.withColumn("__step", F.col(p) * m / F.row_number().over(up))
    return df.withColumn("q_bh", F.least(F.lit(1.0), F.min("__step").over(down.rowsBetween(Window.unboundedPreceding, 0)))).drop("__step")


def sign_test(positive: Column, negative: Column, two_sided: bool = True) -> Column:
    """Exact binomial p-value of so many positive and negative signs."""

    @F.pandas_udf("double")
    def p(pos: pd.Series, neg: pd.Series) -> pd.Series:
        return pd.Series([sign_p(int(a), int(b), two_sided) for a, b in zip(pos, neg, strict=True)])

    return p(positive, negative)


def sign_p(positive: int, negative: int, two_sided: bool = True) -> float:
    n = positive + negative
    if n == 0:
        return 1.0
    upto = lambda k: sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))
    return min(1.0, 2 * upto(min(positive, negative))) if two_sided else min(1.0, upto(negative))


def eta_squared(df: DataFrame, value: str, group: str) -> DataFrame:
    """Share of value's sum of squares that lies between groups; 0 where value does not vary. One pass of partial sums."""
    sums = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    whole = q - s * s / n
    return sums.agg(F.count("*").alias("n_groups"), n.alias("n"), F.when(whole > 1e-9, (F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n) / whole).otherwise(F.lit(0.0)).alias("eta_squared"))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, population deviation, minimum, quartiles (linear) and maximum by group."""
    v = F.col(value).cast("double")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), q.alias("q"), F.max(v).alias("most"))
    return out.select(*by, "n", "mean", "std", "least", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "most")


def zscore(df: DataFrame, values: list[str], fit: DataFrame | None = None) -> DataFrame:
    """df with z_<value>, by mean and population deviation of fit (df itself by default); a deviation of 0 counts as 1."""
    sums = (fit or df).agg(*[f(v).alias(f"__{k}_{v}") for v in values for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.join(F.broadcast(sums))  # one row
    z = {f"z_{v}": (F.col(v) - F.col(f"__m_{v}")) / F.when(F.col(f"__s_{v}") > 1e-12, F.col(f"__s_{v}")).otherwise(F.lit(1.0)) for v in values}
    return out.withColumns(z).drop(*[f"__{k}_{v}" for v in values for k in "ms"])


def residuals(df: DataFrame, response: str, covariates: list[str], ridge: float = 1e-6) -> DataFrame:
    """df with residual of a ridge regression with an intercept, from one pass of cross products; the ridge takes the intercept too."""
    names = ["1", *covariates]
    x = {n: F.lit(1.0) if n == "1" else F.col(n).cast("double") for n in names}
    y = F.col(response).cast("double")
    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [response, *covariates]))
    cross = [F.sum(x[a] * x[b]).alias(f"x{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)]
    row = whole.agg(*cross, *[F.sum(x[a] * y).alias(f"y{i}") for i, a in enumerate(names)]).first()
    k = len(names)
    xx = np.array([[row[f"x{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)]) + ridge * np.eye(k)
    beta = np.linalg.solve(xx, np.array([row[f"y{i}"] or 0.0 for i in range(k)]))
    fitted = sum((x[n] * float(b) for n, b in zip(names, beta, strict=True)), F.lit(0.0))
    return df.withColumn("residual", y - fitted)


def bootstrap_ci(pairs: DataFrame, baseline: str, candidate: str, key: str, iterations: int = 1000, confidence: float = 0.95) -> DataFrame:
    """Mean difference of paired scores and its bootstrap bounds, by Poisson weights from a hash of (key, replicate).

    Each pair is expanded into its replicates' weights and summed by replicate before the shuffle, so
    that the data are read once and only iterations rows meet.
    """
    d = (F.col(candidate) - F.col(baseline)).alias("d")
    rows = pairs.where(F.col(candidate).isNotNull() & F.col(baseline).isNotNull()).select(F.col(key).alias("k"), d)
    reps = rows.select("k", "d", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("rep"))
    u = (F.pmod(F.xxhash64("k", "rep"), F.lit(2**31)) + 0.5) / F.lit(float(2**31))
    cuts, p, total = [], math.exp(-1), 0.0
    for n in range(8):  # of a Poisson variable of mean 1
        total += p
        cuts.append(total)
        p /= n + 1
    weight = sum((F.when(u > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
    means = reps.groupBy("rep").agg((F.sum(weight * F.col("d")) / F.sum(weight)).alias("mean"))
    low = (1 - confidence) / 2
    return means.agg(F.percentile("mean", F.array(F.lit(low), F.lit(1 - low))).alias("b")).join(F.broadcast(rows.agg(F.avg("d").alias("mean"), F.count("*").alias("n")))).select("n", "mean", F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))


def sign_flip_p(pairs: DataFrame, baseline: str, candidate: str, key: str, iterations: int = 1000) -> DataFrame:
    """One-sided p-value of a mean difference above zero, by hashed sign flips; 1 where the mean is not above zero."""
    rows = pairs.select(F.col(key).alias("k"), (F.col(candidate) - F.col(baseline)).alias("d")).where("d IS NOT NULL")
    flips = rows.select("d", "k", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("rep"))
    sign = F.when(F.pmod(F.xxhash64("k", "rep"), F.lit(2)) == 0, 1).otherwise(-1)
    means = flips.groupBy("rep").agg(F.avg(sign * F.col("d")).alias("m"))
    seen = rows.agg(F.avg("d").alias("mean"))
    extreme = means.join(F.broadcast(seen)).agg(F.first("mean").alias("mean"), F.sum((F.col("m") >= F.col("mean") - 1e-15).cast("int")).alias("e"))
    return extreme.select("mean", F.when(F.col("mean") > 0, (F.col("e") + 1) / (iterations + 1)).otherwise(F.lit(1.0)).alias("p_value"))


def quantile_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """df with bin from 0: cut points are the values at place floor(i n / bins) of the sorted values; a value at a cut goes below."""
    n = df.where(F.col(value).isNotNull()).count()
    places = sorted({i * n // bins for i in range(1, bins)}) if n else []
    counts = running(by_value(df, value), [value], {"before": F.col("n")}).withColumn("upto", F.col("before") + F.col("n"))
    cuts = list(counts.agg(*[F.min(F.when(F.col("upto") > p, F.col(value))) for p in places]).first()) if places else []
    return df.withColumn("bin", sum(((F.col(value) > F.lit(c)).cast("int") for c in cuts), F.lit(0)))


def pareto_front(df: DataFrame, maximise: str, minimise: str) -> DataFrame:
    """Rows that no other row beats on one objective without losing on the other.

    A running best over the sorted objective replaces the self-join: a row is beaten if a row with a
    smaller minimise has at least its maximise, or one with the same minimise has more. Values are
    aggregated by minimise first, so that the running window has a row for each distinct value.
    """
    best = df.where(f"`{maximise}` IS NOT NULL AND `{minimise}` IS NOT NULL").groupBy(minimise).agg(F.max(maximise).alias("__best"))
    front = running_best(best, [minimise], "__best", "__before").where(F.col("__before").isNull() | (F.col("__best") > F.col("__before"))).drop("__before")
    return df.join(front, (df[minimise] == front[minimise]) & (df[maximise] == front["__best"])).drop(front[minimise]).drop("__best")


def entropy(counts: Column) -> Column:
    """Base-2 entropy of an array of counts."""
    whole = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    parts = F.transform(counts, lambda c: F.when(c > 0, -(c / whole) * F.log2(c / whole)).otherwise(F.lit(0.0)))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
