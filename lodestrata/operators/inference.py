"""Resampling whose draws are digests, so that every engine draws alike: bootstraps, permutations, simulations.

A draw is the first eight hex digits of the SHA-256 of seed, replicate and place, modulo what is drawn from.
Units (clusters, pairs) are aggregated to one row each before they are drawn; a replicate is one group.
"""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.ordered import running

#: Bound of an exact enumeration of all resamples.
EXACT = 50_000


def derived_seed(beacon_hex: str, domain: str) -> int:
    """A seed from 64 bytes in hex and a domain: the first eight bytes of their digest, modulo 2^63 - 1."""
    beacon = bytes.fromhex(beacon_hex)
    if len(beacon) != 64:
        raise ValueError("the beacon must have 64 bytes")
    return int.from_bytes(hashlib.sha256(beacon + domain.encode()).digest()[:8], "big") % (2**63 - 1)


def draw(n: Column, *fields) -> Column:
    """A number from 0 to n - 1 by the digest of the fields."""
    digest = F.sha2(F.concat_ws("|", *[f if isinstance(f, Column) else F.lit(str(f)) for f in fields]), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n


def at_place(values: DataFrame, value: str, shares: list[float]) -> list[Column]:
    """The values at place int(share * n), at most the last, of a replicate table, in order."""
    sorted_ = F.sort_array(F.collect_list(value))
    return [F.element_at(sorted_, F.least(F.floor(F.lit(s) * F.size(sorted_)).cast("int") + 1, F.size(sorted_))) for s in shares]


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, replicates: int, seed: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """clusters, mean, low and high: as many clusters as there are drawn with replacement, the mean over all their rows; bounds by place."""
    units = rows.where(F.col(value).isNotNull()).groupBy(F.col(cluster).alias("c")).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    return resampled(units, replicates, seed, low, high).withColumnRenamed("n", "clusters")


def paired_bootstrap(pairs: DataFrame, baseline: str, candidate: str, key: str, replicates: int, seed: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """n, mean, low and high of the mean difference: pairs drawn with replacement, bounds by place."""
    units = pairs.select(F.col(key).alias("c"), F.lit(1).alias("n"), (F.col(candidate) - F.col(baseline)).alias("s")).where("s IS NOT NULL")
    return resampled(units, replicates, seed, low, high)


def resampled(units: DataFrame, replicates: int, seed: str, low: float, high: float) -> DataFrame:
    """n (units), mean, low and high for units(c, n, s), numbered in the order of c: one row a draw, joined on the number."""
    numbered = running(units.select("c", "n", "s"), ["c"], {"i": F.lit(1)}).select(F.col("i").cast("long").alias("i"), "n", "s")  # a row a unit
    whole = numbered.agg(F.count("*").alias("units"), (F.sum("s") / F.sum("n")).alias("mean"))
    reps = units.sparkSession.range(replicates).withColumnRenamed("id", "rep")
    draws = reps.join(F.broadcast(whole.select("units"))).where("units > 0").select("rep", "units", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)).alias("j"))  # one row
    draws = draws.select("rep", draw(F.col("units"), seed, F.col("rep"), F.col("j")).alias("i"))
    means = draws.groupBy("rep", "i").agg(F.count("*").alias("w")).join(numbered, "i").groupBy("rep").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    bounds = means.agg(*[c.alias(n) for c, n in zip(at_place(means, "m", [low, high]), ("low", "high"), strict=True)])
    return whole.join(F.broadcast(bounds)).select(F.col("units").alias("n"), "mean", "low", "high")


def sign_flips(pairs: DataFrame, baseline: str, candidate: str, key: str, replicates: int, seed: str) -> DataFrame:
    """n, mean and p_value, one-sided, of a mean difference above 0: the share of sign flips that reach it; 1 where it is not above 0."""
    rows = pairs.select(F.col(key).alias("k"), (F.col(candidate) - F.col(baseline)).alias("d")).where("d IS NOT NULL")
    seen = rows.agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    flips = rows.select("k", "d", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    means = flips.groupBy("rep").agg(F.avg(F.when(draw(F.lit(2), seed, F.col("rep"), F.col("k")) == 0, F.col("d")).otherwise(-F.col("d"))).alias("m"))
    reached = means.join(F.broadcast(seen)).where(F.col("m") >= F.col("mean") - 1e-12).agg(F.count("*").alias("e"))  # one row
    return seen.join(F.broadcast(reached)).select("n", "mean", F.when(F.col("mean") > 0, (F.col("e") + 1) / (replicates + 1)).otherwise(1.0).alias("p_value"))


def contrast(deltas: DataFrame, key: str, delta: str, replicates: int, seed: str, practical: float) -> DataFrame:
    """paired_bootstrap() of deltas with statistical (low above 0), practical (mean at least practical) and success (both)."""
    found = paired_bootstrap(deltas.withColumn("__zero", F.lit(0.0)), "__zero", delta, key, replicates, seed)
    sure, large = F.col("low") > 0, F.col("mean") >= practical
    return found.withColumns({"statistical": sure, "practical": large, "success": sure & large})


def fixed_sequence(contrasts: list[tuple[str, DataFrame]]) -> DataFrame:
    """name, reached, component_success and success of contrasts tested in order: each is reached only after the success of all before."""
    rows = [(name, i, *df.select("success").first()) for i, (name, df) in enumerate(contrasts)]
    out, open_ = [], True
    for name, i, ok in rows:
        out.append((i, name, open_, bool(ok), open_ and bool(ok)))
        open_ = open_ and bool(ok)
    spark = contrasts[0][1].sparkSession
    return spark.createDataFrame(out, "step int, name string, reached boolean, component_success boolean, success boolean")


def exact_bootstrap(values: list[float], low: float = 0.025, high: float = 0.975) -> tuple[float, float]:
    """Interpolated bounds over the means of all n to the n resamples; n to the n at most EXACT."""
    if not values or len(values) ** len(values) > EXACT:
        raise ValueError("as many resamples cannot be enumerated")
    means = np.array(list(product(values, repeat=len(values)))).mean(1)
    return tuple(np.quantile(means, [low, high]).tolist())


def exact_bounds(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """By group of few rows: n, mean, low and high of exact_bootstrap()."""

    def bounds(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = exact_bootstrap(frame[value].astype(float).tolist())
        return pd.DataFrame({**{b: frame[b][:1] for b in by}, "n": [len(frame)], "mean": [frame[value].mean()], "low": [low], "high": [high]})

    kinds = dict(rows.dtypes)
    return rows.where(F.col(value).isNotNull()).select(*by, value).groupBy(*by).applyInPandas(bounds, ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", n long, mean double, low double, high double")


def permutation_eta(rows: DataFrame, value: str, group: str, key: str, permutations: int, seed: str) -> DataFrame:
    """eta_squared and p_value: groups are dealt anew to the values in the order of digests, a replicate a permutation.

    Values and groups are few (tasks, programs of a study): each replicate holds every row once.
    """
    base = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"), F.col(group).alias("g"))
    base = base.withColumn("i", F.row_number().over(Window.orderBy("k")))  # a row a unit
    reps = base.select("k", "v", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("rep"))
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col("rep").cast("string"), F.col("k").cast("string")), 256)
    dealt = reps.withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy(F.when(F.col("rep") == 0, F.lit("")).otherwise(order), "k")))  # replicate 0 is as it is
    sums = dealt.join(base.select("i", "g"), "i").groupBy("rep", "g").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    whole = q - s * s / n
    eta = sums.groupBy("rep").agg(F.when(whole > 1e-9, (F.sum(F.col("s") * F.col("s") / F.col("n")) - s * s / n) / whole).otherwise(0.0).alias("eta"))
    seen = eta.where("rep = 0").select(F.col("eta").alias("eta_squared"))
    reached = eta.where("rep > 0").join(F.broadcast(seen)).agg(F.sum((F.col("eta") >= F.col("eta_squared") - 1e-12).cast("long")).alias("e"))  # one row
    return seen.join(F.broadcast(reached)).select("eta_squared", ((F.coalesce("e", F.lit(0)) + 1) / (permutations + 1)).alias("p_value"))


def ranks_of(x: np.ndarray) -> np.ndarray:
    """1-based ranks, ties at their mean."""
    _, place, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[place]


def spearman_of(x: np.ndarray, y: np.ndarray) -> float:
    """Correlation of ranks; 0 where either does not vary."""
    a, b = ranks_of(np.asarray(x, float)), ranks_of(np.asarray(y, float))
    a, b = a - a.mean() if len(a) else a, b - b.mean() if len(b) else b
    scale = float(np.sqrt((a * a).sum() * (b * b).sum()))
    return float((a * b).sum() / scale) if scale > 1e-12 else 0.0


def leave_one_out(rows: DataFrame, x: str, y: str, key: str, blocks: int = 16) -> DataFrame:
    """key (that is left out), and rho of all other rows: a row a key, each replicate ranked by itself.

    For the few rows of a study, as replicates times rows is their square; keys are dealt into blocks that each meet all rows.
    """
    from lodestrata.operators.controls import weighted_ranks

    whole = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    out = whole.select(F.col("k").alias("out"), F.pmod(F.xxhash64("k"), F.lit(blocks)).alias("block"))
    rest = whole.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(out, "block").where("k != out").select("out", "x", "y", F.lit(1).alias("w"))
    ranked = rest.join(weighted_ranks(rest, "out", "x", "w", "rx"), ["out", "x"]).join(weighted_ranks(rest, "out", "y", "w", "ry"), ["out", "y"])
    varies = (F.stddev_pop("rx") > 1e-12) & (F.stddev_pop("ry") > 1e-12)
    return ranked.groupBy("out").agg(F.when(varies, F.corr("rx", "ry")).otherwise(0.0).alias("rho")).withColumnRenamed("out", key)


def spearman_study(rows: DataFrame, by: list[str], x: str, y: str, key: str, iterations: int = 1000, seed: int = 13, alpha: float = 0.05) -> DataFrame:
    """By group of a study's few rows: n, rho, two-sided permutation p_value, bootstrap low and high (by place), and the least and most rho with one key left out, and which.

    Under 3 rows p_value is 1 and the bounds are 0; under 4 nothing is left out.
    """
    kinds = dict(rows.dtypes)
    schema = "".join(f"`{b}` {kinds[b]}, " for b in by) + f"n long, rho double, p_value double, low double, high double, rho_min double, rho_max double, key_min {kinds[key]}, key_max {kinds[key]}"

    def study(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key)
        a, b, keys, rng = frame[x].to_numpy(float), frame[y].to_numpy(float), frame[key].tolist(), np.random.default_rng(seed)
        n, rho = len(a), spearman_of(a, b)
        p, low, high, least, most, at_least, at_most = 1.0, 0.0, 0.0, rho, rho, None, None
        if n >= 3:
            p = (1 + sum(abs(spearman_of(a, rng.permutation(b))) >= abs(rho) - 1e-12 for _ in range(iterations))) / (iterations + 1)
            some = np.sort([spearman_of(a[i], b[i]) for i in rng.integers(0, n, (iterations, n))])
            low, high = some[int(alpha / 2 * iterations)], some[min(iterations - 1, int((1 - alpha / 2) * iterations))]
        if n >= 4:
            without = np.array([spearman_of(np.delete(a, i), np.delete(b, i)) for i in range(n)])
            least, most, at_least, at_most = without.min(), without.max(), keys[int(without.argmin())], keys[int(without.argmax())]
        own = {"n": n, "rho": rho, "p_value": p, "low": low, "high": high, "rho_min": least, "rho_max": most, "key_min": at_least, "key_max": at_most}
        return pd.DataFrame({**{c: frame[c].iloc[:1].tolist() for c in by}, **{k: [v] for k, v in own.items()}})

    whole = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*dict.fromkeys([*by, x, y, key]))
    return whole.groupBy(*by).applyInPandas(study, schema)


def shift_power(residuals: np.ndarray, clusters: int, simulations: int, seed: int, effects: list[float], scales: list[float]) -> pd.DataFrame:
    """Power of a mean of so many clusters to see a shift: residuals, centred, are drawn with replacement; a mean above the 97.5 % point of no shift counts.

    scale, effect, power, joint (the least that two contrasts share), critical, and the effects seen in 80 and 90 %.
    """
    x = np.asarray(residuals, float) - np.mean(residuals)
    if len(x) < 2 or clusters < 2 or simulations < 100:
        raise ValueError("two residuals, two clusters and 100 simulations at least")
    rng = np.random.default_rng(seed)
    means = np.concatenate([x[rng.integers(0, len(x), (min(4096, simulations - i), clusters))].mean(1) for i in range(0, simulations, 4096)])
    rows = []
    for scale in scales:
        critical, low, lower = np.quantile(means * scale, [0.975, 0.20, 0.10])
        for effect in effects:
            power = float((means * scale + effect > critical).mean())
            rows.append({"scale": scale, "effect": effect, "power": power, "joint": max(0.0, 2 * power - 1), "critical": critical, "seen_80": critical - low, "seen_90": critical - lower})
    return pd.DataFrame(rows)


def attrition(rows: DataFrame, cluster: str, user: str, quotas: tuple[int, int, int], simulations: int, seed: str, least: int) -> DataFrame:
    """simulation, programs, retained, full (training clusters with least programs left) and fewest: what training clusters keep once every user of a test cluster is removed.

    Each simulation orders the clusters by digests and deals them to training, validation and test. Users and
    clusters meet once as counts; a simulation is one group of clusters and one of users.
    """
    counts = rows.groupBy(F.col(cluster).alias("c"), F.col(user).alias("u")).agg(F.count("*").alias("n"))
    order = F.sha2(F.concat_ws("|", F.lit(seed), F.col("sim").cast("string"), F.col("c").cast("string")), 256)
    sims = counts.select("c").distinct().select("c", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))).alias("sim"))
    place = F.row_number().over(Window.partitionBy("sim").orderBy(order, "c"))
    role = F.when(place <= quotas[0], "train").when(place <= quotas[0] + quotas[1], "validation").otherwise("test")
    dealt = sims.withColumn("role", role).join(counts, "c")
    gone = F.max((F.col("role") == "test").cast("int")).over(Window.partitionBy("sim", "u"))
    train = dealt.withColumn("gone", gone).where("role = 'train'").groupBy("sim", "c").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gone") == 0, F.col("n")).otherwise(0)).alias("kept"))
    return train.groupBy(F.col("sim").alias("simulation")).agg(F.sum("n").alias("programs"), F.sum("kept").alias("retained"), F.sum((F.col("kept") >= least).cast("long")).alias("full"), F.min("kept").alias("fewest"))


def digest_sample(df: DataFrame, by: list[str], key: str, count: int, seed: str) -> DataFrame:
    """count rows of each group, or of all, those with the least digests of seed and key: what a reservoir would give in any order."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    if not by:
        return df.orderBy(digest, key).limit(count)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(digest, key))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= count).drop("__rank")


def sampled_contexts(contexts: Column, count: int, seed: Column) -> Column:
    """count elements of an array, those with the least digests of seed and place, in their own order; all where there are fewer."""
    placed = F.transform(contexts, lambda c, i: F.struct(F.sha2(F.concat_ws("|", seed.cast("string"), i.cast("string")), 256).alias("d"), i.alias("i"), c.alias("c")))
    some = F.slice(F.array_sort(placed), 1, count)
    return F.transform(F.array_sort(F.transform(some, lambda x: F.struct(x["i"].alias("i"), x["c"].alias("c")))), lambda x: x["c"])
