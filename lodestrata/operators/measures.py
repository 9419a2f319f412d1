"""Measures of predictions and rankings, means over several levels, contrasts and the gates that read them."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def selected(rows: DataFrame, row: str, score: str, label: str, true: str, how: str, k: int = 3, threshold: float = 0.0) -> DataFrame:
    """rows with predicted, for scores of labels: one line a (row, label).

    how: oracle (as many labels of a row as are true, one at least), top (k) or threshold (score at least). Ties
    go to the smaller label.
    """
    if how == "threshold":
        return rows.withColumn("predicted", F.col(score) >= threshold)
    if how not in ("oracle", "top") or k < 1:
        raise ValueError(f"unknown selection {how}, or k below 1")
    place = F.row_number().over(Window.partitionBy(row).orderBy(F.desc(score), label))
    some = F.greatest(F.lit(1), F.sum(F.col(true).cast("int")).over(Window.partitionBy(row))) if how == "oracle" else F.lit(k)
    return rows.withColumn("predicted", place <= some)


def micro_measures(rows: DataFrame, row: str, true: str) -> DataFrame:
    """precision, recall, f1 and predictions a row, over all lines of selected(); 0 where nothing is there to divide by."""
    hit, said, is_ = (F.sum(c.cast("long")) for c in (F.col("predicted") & F.col(true), F.col("predicted"), F.col(true)))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    sums = rows.groupBy(row).agg(hit.alias("hit"), said.alias("said"), is_.alias("is_")).agg(F.sum("hit").alias("hit"), F.sum("said").alias("said"), F.sum("is_").alias("is_"), F.count("*").alias("n"))
    precision, recall = share(F.col("hit"), F.col("said")), share(F.col("hit"), F.col("is_"))
    return sums.select(precision.alias("precision"), recall.alias("recall"), share(2 * precision * recall, precision + recall).alias("f1"), (F.col("said") / F.col("n")).alias("predicted_mean"))


def accuracy(rows: DataFrame, predicted: str, label: str) -> DataFrame:
    return rows.agg(F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy"))


def positive_ranks(pairs: DataFrame, query: str, item: str, distance: str, positive: str) -> DataFrame:
    """Of each query with one positive item: its rank (ties by positive first, then item), its distance, that of the nearest other, and the margin.

    The rank is counted against the positive's own distance, so that no window holds a query's items.
    """
    own = pairs.where(F.col(positive)).select(query, F.col(distance).alias("positive_distance"))
    others = pairs.where(~F.col(positive)).join(own, query)
    found = others.groupBy(query, "positive_distance").agg((F.sum((F.col(distance) < F.col("positive_distance")).cast("long")) + 1).alias("rank"), F.min(F.struct(distance, item)).alias("near"))
    out = own.join(found.drop("positive_distance"), query, "left").select(query, F.coalesce("rank", F.lit(1)).alias("rank"), "positive_distance", F.col(f"near.{distance}").alias("negative_distance"), F.col(f"near.{item}").alias("negative_item"))
    return out.withColumn("margin", F.col("negative_distance") - F.col("positive_distance"))


def positive_measures(ranks: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Recall and single-positive nDCG at each k, mean reciprocal rank, mean rank, and mean and least margin of positive_ranks()."""
    r = F.col("rank")
    at = [(F.avg((r <= k).cast("double")).alias(f"recall_{k}"), F.avg(F.when(r <= k, 1 / F.log2(r + 1)).otherwise(0.0)).alias(f"ndcg_{k}")) for k in ks]
    return ranks.agg(F.count("*").alias("n"), *[c for two in at for c in two], F.avg(1 / r).alias("mrr"), F.avg(r).alias("mean_rank"), F.avg("margin").alias("margin_mean"), F.min("margin").alias("margin_min"))


def random_expectation(n: Column, ks: tuple[int, ...] = (1, 5)) -> list[Column]:
    """What a random order of n items gives one relevant item: mrr, mean_rank and recall at each k."""
    harmonic = F.aggregate(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: 1 / i), F.lit(0.0), lambda a, x: a + x)
    return [(harmonic / n).alias("mrr"), ((n + 1) / 2).alias("mean_rank"), *[(F.least(F.lit(k), n) / n).alias(f"recall_{k}") for k in ks]]


def level_means(rows: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Mean of value by all levels, then of those means over the last level, and so on: one row, n (of the first level) and mean."""
    for n in range(len(levels), 0, -1):
        rows = rows.groupBy(*levels[:n]).agg(F.avg(value).alias(value))
    return rows.agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def averaged_over(rows: DataFrame, over: str, key: str, value: str, expected: list | None = None) -> DataFrame:
    """key and value: means over the values of one column (seeds, say).

    Raises if some key lacks one of them or has one twice, if they are not the expected ones, or if a value is not a number.
    """
    seen = rows.select(over).distinct()
    if expected is not None and {r[0] for r in seen.limit(len(set(expected)) + 1).collect()} != set(expected):
        raise ValueError(f"{over} has other values than expected")
    n = seen.count()
    bad = rows.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(over).alias("d"), F.max((F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))).cast("int")).alias("odd"))
    if row := bad.where((F.col("n") != n) | (F.col("d") != n) | (F.col("odd") == 1)).head():
        raise ValueError(f"{key} {row[0]!r} does not have one number for each {over}")
    return rows.groupBy(key).agg(F.avg(value).alias(value))


def paired_differences(treatment: DataFrame, control: DataFrame, key: str, value: str) -> DataFrame:
    """key and delta (treatment less control); raises if the two have other keys than each other."""
    both = treatment.select(key, F.col(value).alias("t"), F.lit(1).alias("in_t")).join(control.select(key, F.col(value).alias("c"), F.lit(1).alias("in_c")), key, "full")
    if row := both.where("in_t IS NULL OR in_c IS NULL").head():
        raise ValueError(f"{key} {row[0]!r} is not in both")
    return both.select(key, (F.col("t") - F.col("c")).alias("delta"))


def factor_deltas(rows: DataFrame, keys: list[str], factor: str, left, right, value: str) -> DataFrame:
    """keys and delta of value between two levels of a factor, where both are there: one pivoting aggregate, no self-join."""
    at = lambda level: F.avg(F.when(F.col(factor) == F.lit(level), F.col(value)))
    return rows.groupBy(*keys).agg((at(left) - at(right)).alias("delta")).where("delta IS NOT NULL")


def delta_summary(rows: DataFrame, by: list[str], delta: str, p: str | None = None, alpha: float = 0.05) -> DataFrame:
    """By group: n, mean, sample deviation (0 for one), least, most and, with a p column, how many are significant."""
    d = F.col(delta)
    more = [F.sum((F.col(p) <= alpha).cast("long")).alias("significant")] if p else []
    return rows.where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("std"), F.min(d).alias("least"), F.max(d).alias("most"), *more)


def aliased_means(rows: DataFrame, by: str, columns: dict[str, str | None]) -> DataFrame:
    """By group: n, and mean and population deviation of each column, read from its older name where it is null; a column that is nowhere is left out."""
    own = {}
    for name, older in columns.items():
        there = [F.col(c).cast("double") for c in (name, older) if c and c in rows.columns]
        if there:
            own[name] = F.coalesce(*there)
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[c for name, v in own.items() for c in (F.avg(v).alias(f"{name}_mean"), F.stddev_pop(v).alias(f"{name}_std"))])


def best_by(rows: DataFrame, by: list[str], order: list[tuple[str, bool]]) -> DataFrame:
    """The row of each group that comes first by order: (column, whether larger is better); one aggregate, cut in each task."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) if larger else F.asc(c) for c, larger in order]))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def sets_of(rows: DataFrame, key: str, values: str) -> DataFrame:
    """key and the sorted distinct elements of its rows' arrays."""
    return rows.select(key, F.explode(values).alias("v")).distinct().groupBy(key).agg(F.sort_array(F.collect_list("v")).alias(values))


def inverted(rows: DataFrame, key: str, values: str) -> DataFrame:
    """value and the sorted distinct keys whose arrays hold it."""
    return rows.select(F.explode(values).alias("value"), key).distinct().groupBy("value").agg(F.sort_array(F.collect_list(key)).alias("keys"))


def positive_median_scale(rows: DataFrame, pair: str, cost: str, fallback: float = 1.0) -> DataFrame:
    """Median over pairs of the median positive cost of each; fallback where no cost is positive."""
    own = rows.where(F.col(cost) > 0).groupBy(pair).agg(F.percentile(cost, 0.5).alias("m"))
    return own.agg(F.coalesce(F.percentile("m", 0.5), F.lit(fallback)).alias("scale"))


def signed_summary(rows: DataFrame, value: str, threshold: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """n, mean, std, 5, 50 and 95 % points, and the shares of values below -threshold, between and above threshold; zeros without rows."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    some = rows.where(v.isNotNull()).groupBy(*(by or []))
    out = some.agg(F.count("*").alias("n"), zero(F.avg(v)).alias("mean"), zero(F.stddev_pop(v)).alias("std"), q.alias("q"), share(v < -threshold).alias("negative"), share(F.abs(v) <= threshold).alias("near_zero"), share(v > threshold).alias("positive"))
    return out.select(*(by or []), "n", "mean", "std", *[zero(F.col("q")[i]).alias(name) for i, name in enumerate(("q05", "q50", "q95"))], "negative", "near_zero", "positive")


def neighbour_overlap(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Mean share of each query's k nearest items by left distances that are so by right ones, too: (query, item, distance), ties by item; 0 for none."""
    near = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("distance", "item"))).where(F.col("n") <= k).select("query", "item")
    both = near(left).join(near(right).withColumn("hit", F.lit(1)), ["query", "item"], "left")
    return both.groupBy("query").agg((F.count("hit") / F.count("*")).alias("share")).agg(F.count("*").alias("n"), F.avg("share").alias("overlap"))


def tie_sizes(pairs: DataFrame, k: int) -> DataFrame:
    """Of each query with k items: the distance of its k-th nearest and how many items are as far."""
    levels = pairs.groupBy("query", "distance").agg(F.count("*").alias("ties"))
    upto = F.sum("ties").over(Window.partitionBy("query").orderBy("distance").rowsBetween(Window.unboundedPreceding, 0))
    return levels.withColumn("upto", upto).where((F.col("upto") >= k) & (F.col("upto") - F.col("ties") < k)).select("query", "distance", "ties")


def common_levels(rows: DataFrame, value: str, count: int = 12) -> DataFrame:
    """The count most frequent values and how often they are; ties to the smaller value."""
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(count)


def rank_loss(pairs: DataFrame, by: list[str], true: str, model: str, key: str, margin: float = 0.05) -> DataFrame:
    """By group: mean of what neighbours in the order of a true distance above 0 lack of margin in the model's; 0 without neighbours at two distances."""
    order = Window.partitionBy(*by).orderBy(true, key)
    steps = pairs.where(F.col(true) > 0).select(*by, (F.col(true) - F.lag(true).over(order)).alias("t"), (F.col(model) - F.lag(model).over(order)).alias("m"))
    return steps.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("t") > 0, F.greatest(F.lit(0.0), margin - F.col("m")))), F.lit(0.0)).alias("loss"))


def least_level(rows: DataFrame, by: list[str], level: str, value: str, threshold: float, at_least: bool = True) -> DataFrame:
    """By group: the smallest level whose mean value reaches the threshold (from above with at_least false); null if none."""
    means = rows.groupBy(*by, level).agg(F.avg(value).alias("m"))
    good = F.col("m") >= threshold if at_least else F.col("m") <= threshold
    return means.groupBy(*by).agg(F.min(F.when(good, F.col(level))).alias(level))


def gate(rows: DataFrame, name: str, where: Column, project: str, mean: str, low: str, high: str, min_projects: int = 2, practical: float = 0.01, two_sided: bool = False) -> DataFrame:
    """gate, rows, supported_cells, supported_projects and decision of the rows that a gate is about.

    A row supports it if its interval lies above 0 and its mean reaches practical (two-sided: or below, likewise);
    the gate passes with min_projects projects that support it.
    """
    up = (F.col(low) > 0) & (F.col(mean) >= practical)
    sure = up | ((F.col(high) < 0) & (F.col(mean) <= -practical)) if two_sided else up
    own = rows.where(where).agg(F.count("*").alias("rows"), F.sum(sure.cast("long")).alias("supported_cells"), F.countDistinct(F.when(sure, F.col(project))).alias("supported_projects"))
    decision = F.when(F.col("rows") == 0, "no_rows").when(F.col("supported_projects") >= min_projects, "supported").when(F.col("supported_projects") > 0, "partial").otherwise("not_supported")
    return own.select(F.lit(name).alias("gate"), "rows", F.coalesce("supported_cells", F.lit(0)).alias("supported_cells"), "supported_projects", decision.alias("decision"))


def interval_decision(mean: Column, low: Column, high: Column, above: str, below: str, neither: str, practical: float = 0.01) -> Column:
    """above or below where the interval lies on that side of 0 and the mean is at least practical from it, else neither."""
    far = F.abs(mean) >= practical
    return F.when((low > 0) & far, above).when((high < 0) & far, below).otherwise(neither)


def grid(spark, **levels: list) -> DataFrame:
    """All combinations of the levels of factors, in order."""
    names = list(levels)
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(c) for c in product(*levels.values())], ", ".join(f"`{n}` {kinds[type(levels[n][0])]}" for n in names))


def level_grid(rows: DataFrame, names: list[str], most: int = 1000) -> DataFrame:
    """All combinations of the levels that the named factors have in rows; more than most combinations are an error."""
    levels = [[r[0] for r in rows.where(F.col(n).isNotNull()).select(n).distinct().limit(most + 1).collect()] for n in names]  # most a factor
    count = 1
    for own in levels:
        count *= len(own)
    if count > most:
        raise ValueError("the factors have too many levels for a grid")
    kinds = dict(rows.dtypes)
    return rows.sparkSession.createDataFrame(list(product(*levels)), ", ".join(f"`{n}` {kinds[n]}" for n in names))


def weight_grid(spark, views: list[str], main: list[float], shares: list[list[float]]) -> DataFrame:
    """Distinct weights of views: the first has each weight of main, the rest of 1 is dealt to the others by each of shares; in a map and a key."""
    rows = {}
    for w, share in product(main, shares):
        weights = {views[0]: w, **{v: (1.0 - w) * s for v, s in zip(views[1:], share, strict=True)}}
        rows.setdefault(tuple(round(x, 12) for x in weights.values()), weights)
    return spark.createDataFrame([(",".join(f"{x:g}" for x in key), weights) for key, weights in rows.items()], "key string, weights map<string,double>")


def folds(df: DataFrame, by: str, key: str, count: int, seed: str) -> DataFrame:
    """df with fold from 0: rows of each group dealt in turn, in the order of a keyed digest."""
    order = F.sha2(F.concat_ws("\0", F.lit(seed), F.col(key).cast("string")), 256)
    return df.withColumn("fold", (F.row_number().over(Window.partitionBy(by).orderBy(order, key)) - 1) % count)


def leave_one_out(deltas: DataFrame, group: str, delta: str) -> DataFrame:
    """group, and the mean over the other groups' means of delta: from one total, no join of groups with each other."""
    means = deltas.groupBy(group).agg(F.avg(delta).alias("m"))
    total = means.agg(F.sum("m").alias("s"), F.count("*").alias("n"))
    return means.join(F.broadcast(total)).select(group, F.when(F.col("n") > 1, (F.col("s") - F.col("m")) / (F.col("n") - 1)).alias("mean_without"))  # one row


def kind_of(columns_present: dict[str, Column], rules: list[tuple[list[str], Column | None, str]], otherwise: str = "unknown") -> Column:
    """The name of the first rule whose columns are all present and whose condition, if any, holds."""
    out = None
    for needed, condition, name in rules:
        test = reduce(lambda a, b: a & b, [columns_present[c] for c in needed])
        test = test if condition is None else test & condition
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise)


def experiment_kind(name: Column, document: Column) -> Column:
    """What a JSON result (VARIANT) is, by the fields it has and its file's name."""
    fields = ("feature_set_results", "test_results", "method_summary", "results", "methods", "overall_geometry", "profile")
    has = {f: F.try_variant_get(document, f"$.{f}", "variant").isNotNull() for f in fields}
    status = F.coalesce(F.try_variant_get(document, "$.protocol.status", "string"), F.lit(""))
    residual = name.contains("residual") | status.contains("residual")
    return kind_of(has, [(["feature_set_results"], residual, "confirmatory_residual_sweep"), (["feature_set_results"], None, "confirmatory_feature_sweep"), (["test_results"], None, "confirmatory_split"), (["method_summary"], None, "multiseed_ablation"), (["results"], None, "weight_sweep"), (["methods"], name.contains("markov_baselines"), "markov_baseline_audit"), (["methods"], None, "method_comparison"), (["overall_geometry"], None, "ast_geometry_pilot"), (["profile"], None, "file_tree_smoke_test")])


def by_repository(records: DataFrame, repo: list[str], path: Column, language: list[str]) -> DataFrame:
    """repo, its sorted distinct paths and languages; the first non-empty of the named columns counts. Rows without repo or path are left out."""
    first = lambda names: F.trim(F.coalesce(*[F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in names if c in records.columns], F.lit("")))
    rows = records.select(first(repo).alias("repo"), path.alias("path"), first(language).alias("language")).where("repo != '' AND path != ''").distinct()
    return rows.groupBy("repo").agg(F.sort_array(F.collect_set("path")).alias("paths"), F.sort_array(F.collect_set(F.when(F.col("language") != "", F.col("language")))).alias("languages"))


def members_joined(rows: DataFrame, groups: DataFrame, key: str, members: str) -> DataFrame:
    """rows with the columns of the group whose array of members holds their key."""
    exploded = groups.withColumn(key, F.explode(members)).drop(members)
    return rows.join(exploded, key)


def pairs_within(df: DataFrame, by: str, key: str) -> DataFrame:
    """by, left and right: all pairs of distinct keys of a group, left the smaller; the result grows with the square of a group, as it states."""
    rows = df.select(by, key).distinct()
    return rows.select(by, F.col(key).alias("left")).join(rows.select(by, F.col(key).alias("right")), by).where("left < right")


def first_pairs(df: DataFrame, key: str, count: int) -> DataFrame:
    """The first count pairs (left before right in the order of key); the one row with itself where there is no other.

    Only the count + 1 first keys can be in these pairs.
    """
    some = df.select(key).distinct().orderBy(key).limit(count + 1)
    x, y = some.select(F.col(key).alias("left")), some.select(F.col(key).alias("right"))
    pairs = x.join(F.broadcast(y), F.col("left") < F.col("right")).orderBy("left", "right").limit(count)  # count + 1 rows
    single = some.groupBy().agg(F.count("*").alias("n"), F.min(key).alias("left")).where("n = 1").select("left", F.col("left").alias("right"))
    return pairs.union(single)


def without_clusters(rows: DataFrame, cluster: str, *bad: DataFrame) -> DataFrame:
    """rows whose cluster is in none of bad(cluster): whole clusters go."""
    return reduce(lambda df, b: df.join(b.select(cluster).distinct(), cluster, "left_anti"), bad, rows)


def aligned(results: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Results of the same pairs side by side, value_0 and so on: the pairs that all have."""
    named = [df.select(*keys, F.col(value).alias(f"{value}_{i}")) for i, df in enumerate(results)]
    return reduce(lambda a, b: a.join(b, keys), named)


def weighted_utility(rows: DataFrame, objectives: dict[str, tuple[bool, float]]) -> DataFrame:
    """rows with utility: weighted mean of objectives (name: larger is better, weight), each scaled to 0 to 1 over all rows; 1 where all are equal."""
    span = rows.agg(*[f(c).alias(f"__{k}_{c}") for c in objectives for k, f in (("lo", F.min), ("hi", F.max))])
    wide = rows.join(F.broadcast(span))  # one row
    scaled = []
    for c, (larger, weight) in objectives.items():
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        part = (F.col(c) - lo) / (hi - lo) if larger else (hi - F.col(c)) / (hi - lo)
        scaled.append(F.lit(float(weight)) * F.when(hi > lo, part).otherwise(F.lit(1.0)))
    total = sum(scaled[1:], scaled[0]) / F.lit(float(sum(w for _, w in objectives.values())))
    return wide.withColumn("utility", total).select(*rows.columns, "utility")
