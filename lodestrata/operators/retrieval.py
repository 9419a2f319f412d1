"""Ranking a gallery for each query, and both families of retrieval measures.

Input is one row a (query, gallery item): query, item, distance, relevant. The query set is stated
by the caller; ranks are taken within a query, so that a shuffle on the query carries everything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs that one block of queries makes with the gallery, about.
PAIRS_A_BLOCK = 4_000_000


def distances(queries: DataFrame, gallery: DataFrame, distance: Callable[[Column, Column], Column], blocks: int | None = None) -> DataFrame:
    """query, item, distance and relevant for queries(id, label, v) against gallery(id, label, v), without a query itself.

    The stated queries are dealt into blocks and meet every gallery row once a block, an equi-join
    on the block number that needs no broadcast of either side. There are as many blocks as keep a block's pairs to
    PAIRS_A_BLOCK, as counted, or as stated.
    """
    if blocks is None:
        asked = queries.count()
        blocks = max(8, min(asked, asked * gallery.count() // PAIRS_A_BLOCK))
    q = queries.select(F.col("id").alias("query"), F.col("label").alias("q_label"), F.col("v").alias("q_v"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    g = gallery.select(F.col("id").alias("item"), F.col("label").alias("g_label"), F.col("v").alias("g_v"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    pairs = q.join(g, "block").where("query != item")
    return pairs.select("query", "q_label", "item", distance(F.col("q_v"), F.col("g_v")).alias("distance"), (F.col("q_label") == F.col("g_label")).alias("relevant"))


def ranked(pairs: DataFrame, digits: int = 9) -> DataFrame:
    """pairs with rank from 1 by distance (rounded, so that the last bit cannot reorder), ties by item."""
    by = Window.partitionBy("query").orderBy(F.round("distance", digits), "item")
    return pairs.withColumn("rank", F.row_number().over(by))


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    return ranked(pairs).where(F.col("rank") <= k)


def scores(pairs: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Of each query with a relevant item: average precision, reciprocal rank, and recall and hit rate at each k.

    recall_k is the share of relevant items in the first k; hit_k whether there is one. Average
    precision takes all relevant ranks.
    """
    rows = ranked(pairs)
    upto = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rel = F.col("relevant").cast("int")
    rows = rows.withColumn("seen", F.sum(rel).over(upto)).withColumn("precision", F.col("seen") / F.col("rank"))
    when = lambda cond, value: F.when(cond, value)
    found = rows.groupBy("query", "q_label").agg(
        F.sum(rel).alias("positives"),
        F.avg(when(F.col("relevant"), F.col("precision"))).alias("average_precision"),
        (1 / F.min(when(F.col("relevant"), F.col("rank")))).alias("reciprocal_rank"),
        *[F.sum(when(F.col("rank") <= k, rel)).alias(f"top_{k}") for k in ks],
    )
    found = found.where("positives > 0")
    return found.select("query", "q_label", "positives", "average_precision", "reciprocal_rank", *[(F.col(f"top_{k}") / F.col("positives")).alias(f"recall_{k}") for k in ks], *[(F.col(f"top_{k}") > 0).cast("int").alias(f"hit_{k}") for k in ks])


def average_precision_at_r(pairs: DataFrame, r: int) -> DataFrame:
    """Of each query with a relevant item: precision summed over relevant ranks up to r, over min(r, positives)."""
    rows = ranked(pairs)
    upto = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rel = F.col("relevant").cast("int")
    rows = rows.withColumn("precision", F.sum(rel).over(upto) / F.col("rank"))
    total = rows.groupBy("query", "q_label").agg(F.sum(rel).alias("positives"), F.sum(F.when(F.col("relevant") & (F.col("rank") <= r), F.col("precision"))).alias("s"))
    return total.where("positives > 0").select("query", "q_label", (F.coalesce("s", F.lit(0.0)) / F.least(F.lit(r), F.col("positives"))).alias("map_at_r"))


def macro(per_query: DataFrame, measures: list[str]) -> DataFrame:
    """Means over queries by label, then over labels: one row."""
    by_label = per_query.groupBy("q_label").agg(*[F.avg(m).alias(m) for m in measures])
    return by_label.agg(F.count("*").alias("n_labels"), *[F.avg(m).alias(m) for m in measures])


def nearest_negative(pairs: DataFrame) -> DataFrame:
    """query, the distances of the nearest relevant and irrelevant items, and the margin between them."""
    near = pairs.groupBy("query").agg(F.min(F.when(F.col("relevant"), F.col("distance"))).alias("positive"), F.min(F.when(~F.col("relevant"), F.col("distance"))).alias("negative"))
    return near.withColumn("margin", F.col("negative") - F.col("positive"))


def combined(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted sum of several distances of the same pairs, each divided by its median positive distance (1 if none)."""
    out = None
    for i, (pairs, weight) in enumerate(parts):
        scale = pairs.agg(F.coalesce(F.percentile(F.when(F.col("distance") > 0, F.col("distance")), 0.5), F.lit(1.0)).alias("scale"))
        own = pairs.join(F.broadcast(scale)).select("query", "q_label", "item", "relevant", (F.lit(weight) * F.col("distance") / F.col("scale")).alias(f"d{i}"))  # one row
        out = own if out is None else out.join(own.drop("q_label", "relevant"), ["query", "item"])
    total = sum((F.col(f"d{i}") for i in range(1, len(parts))), F.col("d0"))
    return out.select("query", "q_label", "item", total.alias("distance"), "relevant")
