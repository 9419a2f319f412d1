"""Controls: keyed permutations of a whole table, across groups and within them, and which view deserves which weight."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.graphs import cut
from lodestrata.operators.ordered import running


def placed(items: DataFrame, id: str, group: str, key: str) -> tuple[DataFrame, int]:
    """items in groups, and in each by a keyed digest: at (place of all), first and size (of the group); and how many items there are.

    Places are sums over ranges, so that neither the table nor a group has to fit into a task.
    """
    keyed = items.select(F.col(id).alias("id"), F.col(group).alias("group"), F.sha2(F.concat_ws("|", F.lit(key), F.col(id).cast("string")), 256).alias("digest"))
    rows = cut(running(keyed, ["group", "digest", "id"], {"at": F.lit(1)}).withColumn("at", F.col("at").cast("long")))
    groups = rows.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    return rows.join(groups, "group"), rows.count()


def derangement(items: DataFrame, id: str, group: str, key: str) -> DataFrame:
    """id and image: a permutation of items that takes each to one of another group, always the same by key.

    In order of groups, every item goes as many places on as the largest group has, round the end: nothing of one group is that far
    apart in both directions. A group of more than half the items makes that impossible and is an error. Ids are distinct, groups not null.
    """
    rows, n = placed(items, id, group, key)
    far = rows.agg(F.max("size")).first()[0] or 0
    if 2 * far > n:
        raise ValueError("a group holds more than half of the items")
    images = rows.select(F.col("at").alias("to"), F.col("id").alias("image"), F.col("group").alias("image_group"))
    return rows.withColumn("to", (F.col("at") + far) % n).join(images, "to").select("id", "group", "image", "image_group")


def shuffled_within(items: DataFrame, id: str, group: str, key: str) -> DataFrame:
    """id and image: the next item of its group by keyed digest, round the end, so that only an item alone in its group is its own image (null)."""
    rows, _ = placed(items, id, group, key)
    after = F.col("first") + (F.col("at") - F.col("first") + 1) % F.col("size")
    images = rows.select(F.col("at").alias("to"), F.col("id").alias("image"))
    found = rows.withColumn("to", after).join(images, "to")
    return found.select("id", "group", F.when(F.col("size") > 1, F.col("image")).alias("image"))


#: What an anchor control puts for an object's anchor.
ANCHORS = ("true", "zero", "root", "same_depth")


def anchors(objects: DataFrame, nodes: DataFrame, tree: str, mode: str, key: str = "anchors") -> DataFrame:
    """objects(tree, path_index, lca) with anchor: the node whose point stands for the ancestor's; null: the centre.

    same_depth takes another node of the ancestor's depth, by a digest of key and path among all of them in order of their numbers;
    where the depth has no other, the centre.
    """
    if mode not in ANCHORS:
        raise ValueError(f"unknown anchor {mode}")
    if mode != "same_depth":
        return objects.withColumn("anchor", {"true": F.col("lca"), "zero": F.lit(None).cast("int"), "root": F.lit(0)}[mode])
    depths = nodes.select(tree, F.col("node").alias("lca"), F.col("depth").alias("lca_deep"))
    order = running(nodes.select(tree, "depth", "node"), [tree, "depth", "node"], {"at": F.lit(1)})
    order = cut(order.withColumn("at", F.col("at").cast("long")))
    level = order.groupBy(tree, F.col("depth").alias("lca_deep")).agg(F.min("at").alias("first"), F.count("*").alias("size"))
    own = order.select(tree, F.col("node").alias("lca"), F.col("at").alias("own"))
    rows = objects.join(depths, [tree, "lca"]).join(level, [tree, "lca_deep"]).join(own, [tree, "lca"])
    digest = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.col(tree).cast("string"), F.col("path_index").cast("string")), 256), 1, 12), 16, 10).cast("long")
    others = F.greatest(F.col("size") - 1, F.lit(1))
    step = 1 + digest % others  # places on from the own one, never all the way round
    to = F.when(F.col("size") > 1, F.col("first") + (F.col("own") - F.col("first") + step) % F.col("size"))
    found = rows.withColumn("to", to).join(order.select(F.col("at").alias("to"), F.col("node").alias("anchor")), "to", "left")
    return found.select(*objects.columns, "anchor")


# Views


def fold_pairs(items: DataFrame, id: str, label: str, folds: int = 4) -> DataFrame:
    """fold, query, query_label, item and item_label: in fold f the f-th item of each label, by id, is the gallery and all others are queries.

    Labels of one item take no part; there are as many folds as the smallest label has items, at most folds.
    """
    rows = running(items.where(F.col(label).isNotNull()).select(F.col(id).alias("id"), F.col(label).alias("label")), ["label", "id"], {"at": F.lit(1)})
    sizes = rows.groupBy("label").agg(F.min("at").alias("first"), F.count("*").alias("size")).where("size > 1")
    rows = cut(rows.join(sizes, "label").select("id", "label", (F.col("at") - F.col("first")).cast("int").alias("place")))
    least = sizes.agg(F.min("size")).first()[0] or 0
    gallery = rows.where(F.col("place") < min(folds, least)).select(F.col("place").alias("fold"), F.col("id").alias("item"), F.col("label").alias("item_label"))
    asked = rows.select(F.explode(F.sequence(F.lit(0), F.lit(max(0, min(folds, least) - 1)))).alias("fold"), F.col("id").alias("query"), F.col("label").alias("query_label"), "place").where(F.col("place") != F.col("fold")).drop("place")
    return asked.join(gallery, "fold")


def first_positives(scored: DataFrame, views: list[str], grid: list[tuple[float, ...]], digits: int = 9) -> DataFrame:
    """choice, fold, query and rank of the first item of the query's own label, for every choice of weights of the grid, from one table of scores a view.

    scored: fold, query, query_label, item, item_label and the views. A task holds the pairs of some queries, and has their weighted
    scores as one product of pairs by views and views by choices; equal scores (by digits) go by the item.
    """
    weights = np.array(grid, float).T
    kind = dict(scored.dtypes)["query"]
    tasks = max(1, scored.count() // 200_000)

    def ranks(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fold", "query", "item"])
        value = np.round(frame[views].to_numpy(float) @ weights, digits)
        same = (frame["query_label"] == frame["item_label"]).to_numpy()
        edges = np.flatnonzero((frame["fold"].to_numpy()[1:] != frame["fold"].to_numpy()[:-1]) | (frame["query"].to_numpy()[1:] != frame["query"].to_numpy()[:-1])) + 1
        starts = np.concatenate(([0], edges))
        out = []
        for start, end in zip(starts, [*edges, len(frame)], strict=True):
            v, s = value[start:end], same[start:end]
            if s.any():
                order = np.argsort(-v, axis=0, kind="stable")  # items are in order of their ids
                first = s[order].argmax(0) + 1
                out.append(pd.DataFrame({"choice": np.arange(len(grid)), "fold": frame["fold"].iloc[start], "query": frame["query"].iloc[start], "rank": first}))
        return pd.concat(out) if out else pd.DataFrame({"choice": [], "fold": [], "query": [], "rank": []})

    dealt = scored.withColumn("task", F.pmod(F.xxhash64("fold", "query"), F.lit(tasks)))
    return dealt.groupBy("task").applyInPandas(ranks, f"choice int, fold int, query {kind}, rank int")


def weight_choice(ranks: DataFrame, grid: list[tuple[float, ...]], guard: int | None = None, margin: float | None = None) -> DataFrame:
    """choice, mrr and chosen of every choice of the grid: the best mean reciprocal rank, ties by the guarded view's weight, then the earlier choice.

    With a margin, weights that use the guarded view must beat the best of those that don't by more than it, or the latter are chosen.
    """
    spark = ranks.sparkSession
    own = spark.createDataFrame([(i, float(w[guard]) if guard is not None else 0.0) for i, w in enumerate(grid)], "choice int, guard double")
    means = own.join(ranks.groupBy("choice").agg(F.avg(1 / F.col("rank")).alias("mrr")), "choice", "left").withColumn("mrr", F.round(F.coalesce("mrr", F.lit(0.0)), 12))
    top = F.max(F.struct("mrr", "guard", (-F.col("choice")).alias("c")))
    plain = F.max(F.when(F.col("guard") == 0, F.struct("mrr", (-F.col("choice")).alias("c"))))
    best = means.agg(top.alias("top"), plain.alias("plain"))
    kept = F.col("top.c")
    if margin is not None and guard is not None:
        kept = F.when((F.col("top.guard") > 0) & F.col("plain").isNotNull() & (F.col("top.mrr") <= F.col("plain.mrr") + margin), F.col("plain.c")).otherwise(kept)
    return means.join(F.broadcast(best.select((-kept).alias("best"))), F.lit(True)).select("choice", "mrr", (F.col("choice") == F.col("best")).alias("chosen"))


# Rank correlation under resampling


#: Rows that a task of a resampling holds, about.
TASK_ROWS = 1_000_000


def weighted_ranks(rows: DataFrame, by: str, value: str, weight: str, out: str, tasks: int | None = None) -> DataFrame:
    """by, value and out: mean rank of a value where every row stands for weight rows; rows are dealt into tasks before they are summed, if stated."""
    if tasks:
        rows = rows.select(by, value, weight).repartition(tasks, by, value)
    sums = rows.groupBy(by, value).agg(F.sum(weight).alias("__w"))
    before = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(by, value, (F.coalesce(F.sum("__w").over(before), F.lit(0)) + (F.col("__w") + 1) / 2).alias(out))


def spearman_bootstrap(rows: DataFrame, cluster: str, left: str, right: str, replicates: int, seed: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """clusters, low and high of the rank correlation over as many clusters as there are, drawn with replacement; below three clusters both are 0.

    A cluster that is drawn w times weighs w in the ranks of its replicate, so that no row is copied; bounds by place.
    """
    from lodestrata.operators.inference import at_place, draw

    data = rows.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(cluster).alias("c"), F.col(left).cast("double").alias("x"), F.col(right).cast("double").alias("y"))
    units = running(data.select("c").distinct(), ["c"], {"i": F.lit(1)}).withColumn("i", F.col("i").cast("long"))
    n = units.count()
    reps = rows.sparkSession.range(replicates).withColumnRenamed("id", "rep")
    draws = reps.select("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long"))).alias("j")).select("rep", draw(F.lit(n), seed, F.col("rep"), F.col("j")).alias("i"))
    # rows grow by replicates in the join: they are dealt before it, and not summed after it, as hardly any are alike
    tasks = 1 + data.count() * replicates // TASK_ROWS
    drawn = draws.groupBy("rep", "i").agg(F.count("*").alias("w")).join(units, "i").join(data.repartition(tasks, "c", "x", "y"), "c").select("rep", "x", "y", "w")
    drawn = cut(drawn)
    joined = reduce(lambda d, v: d.join(weighted_ranks(drawn, "rep", v, "w", f"r{v}", tasks), ["rep", v]), ("x", "y"), drawn)
    total = lambda c: F.sum(F.col("w") * c)
    mean = joined.groupBy("rep").agg(F.sum("w").alias("n"), total(F.col("rx")).alias("sx"), total(F.col("ry")).alias("sy"), total(F.col("rx") * F.col("rx")).alias("xx"), total(F.col("ry") * F.col("ry")).alias("yy"), total(F.col("rx") * F.col("ry")).alias("xy"))
    spread = lambda s, q: F.col(q) - F.col(s) * F.col(s) / F.col("n")
    both = F.sqrt(spread("sx", "xx") * spread("sy", "yy"))
    m = mean.select(F.when(both > 0, (F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")) / both).otherwise(0.0).alias("m"))
    bounds = m.agg(*[c.alias(name) for c, name in zip(at_place(m, "m", [low, high]), ("low", "high"), strict=True)])
    few: Column = F.lit(n < 3)
    return bounds.select(F.lit(n).cast("long").alias("clusters"), *[F.when(few, 0.0).otherwise(F.col(c)).alias(c) for c in ("low", "high")])
