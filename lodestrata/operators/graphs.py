"""Graphs as edge tables: components, curvature, balls, and trees by their ancestor arrays."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import path_prefixes


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir and read again, which ends its lineage.

    Only where all runs on one machine (tests) may the setting be missing; a temporary folder serves then.
    """
    import tempfile

    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir: set it to a folder that the driver and all executors share")
        folder = tempfile.gettempdir()
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of cut() that no later plan reads."""
    for df in frames:
        if path := getattr(df, "cut_path", None):
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) of nodes(node) over edges(left, right).

    Alternating large-star and small-star steps; every round is written, nothing is collected, and a
    node with very many edges is aggregated before it is shuffled.
    """
    pairs = cut(edges.where("left != right").select(F.greatest("left", "right").alias("a"), F.least("left", "right").alias("b")).distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = state(pairs)
    while before[0]:
        both = pairs.union(pairs.select(F.col("b"), F.col("a")).toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        old, pairs = pairs, cut(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        after = state(pairs)
        discard(old, large)
        if after == before:
            break
        before = after
    labels = pairs.select(F.col("a").alias("node"), F.col("b").alias("found"))
    return nodes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("found", "node").alias("component"))


def path_tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """Distinct nodes of the tree of all prefixes: node, parent (null for the root) and depth."""
    prefixes = path_prefixes(F.col(path))
    pairs = F.transform(F.sequence(F.lit(1), F.size(prefixes)), lambda i: F.struct(F.element_at(prefixes, i).alias("node"), F.when(i > 1, F.element_at(prefixes, F.greatest(i - 1, F.lit(1)))).alias("parent"), (i - 1).alias("depth")))
    return paths.select(F.explode(pairs).alias("n")).select("n.*").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node and degree of an undirected graph of distinct edges(left, right)."""
    ends = edges.select(F.col("left").alias("node")).union(edges.select("right"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def forman_curvature(edges: DataFrame) -> DataFrame:
    """left, right and 4 - degree(left) - degree(right)."""
    d = degrees(edges)
    with_left = edges.join(d.withColumnsRenamed({"node": "left", "degree": "dl"}), "left")
    return with_left.join(d.withColumnsRenamed({"node": "right", "degree": "dr"}), "right").select("left", "right", (4 - F.col("dl") - F.col("dr")).alias("curvature"))


def ball_sizes(edges: DataFrame, radii: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """node, radius and size (nodes within that many steps, itself included): one distinct join a step."""
    both = edges.select("left", "right").union(edges.select(F.col("right"), F.col("left"))).toDF("from", "to").distinct()
    reach = both.select(F.col("from").alias("node")).distinct().withColumn("at", F.col("node"))
    out = None
    for r in range(1, max(radii) + 1):
        step = reach.join(both, F.col("at") == F.col("from")).select("node", F.col("to").alias("at"))
        reach = cut(reach.union(step).distinct())
        if r in radii:
            sizes = reach.groupBy("node").agg(F.count("*").alias("size")).withColumn("radius", F.lit(r))
            out = sizes if out is None else out.union(sizes)
    return out.select("node", "radius", "size")


def forest_ball_sizes(edges: DataFrame, radii: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """ball_sizes() of a graph without cycles, by sums over edges: no pair of nodes is made, however many neighbours a node has.

    An edge carries how many nodes lie within so many steps of its first end on the side away from the other; the next count is
    1 and what comes to that end from all its neighbours but the other.
    """
    both = edges.select("left", "right").union(edges.select(F.col("right"), F.col("left"))).toDF("from", "to").distinct()
    carried = cut(both.withColumn("c", F.lit(1).cast("long")))
    out = None
    for r in range(1, max(radii) + 1):
        sums = carried.groupBy(F.col("to").alias("node")).agg(F.sum("c").alias("t"))
        if r in radii:
            sizes = sums.select("node", F.lit(r).alias("radius"), (F.col("t") + 1).alias("size"))
            out = sizes if out is None else out.union(sizes)
        if r < max(radii):
            back = carried.select(F.col("to").alias("from"), F.col("from").alias("to"), F.col("c").alias("back"))
            carried = cut(back.join(sums.withColumnRenamed("node", "from"), "from").select("from", "to", (F.col("t") - F.col("back") + 1).alias("c")))
    return out


def shortest_paths(edges: DataFrame, limit: int) -> DataFrame:
    """left, right and distance of all pairs within limit steps; breadth first, a join a step."""
    both = edges.select("left", "right").union(edges.select(F.col("right"), F.col("left"))).toDF("from", "to").distinct()
    found = both.select(F.col("from").alias("left")).distinct().select("left", F.col("left").alias("right"), F.lit(0).alias("distance"))
    front = found
    for step in range(1, limit + 1):
        new = front.join(both, F.col("right") == F.col("from")).select("left", F.col("to").alias("right")).distinct()
        front = cut(new.join(found.select("left", "right"), ["left", "right"], "left_anti").withColumn("distance", F.lit(step)))
        if front.isEmpty():
            break
        found = cut(found.union(front))
    return found


def lca(left: Column, right: Column) -> Column:
    """Last common element of two root-to-node arrays."""
    from lodestrata.functions.distance import common_prefix_length

    n = common_prefix_length(left, right)
    return F.when(n > 0, F.element_at(left, F.greatest(n, F.lit(1))))


def tree_distance(left: Column, right: Column) -> Column:
    """Steps between two nodes given their root-to-node arrays."""
    from lodestrata.functions.distance import prefix_trie_distance

    return prefix_trie_distance(left, right)


def strict_ancestors(nodes: DataFrame, node: str = "node", ancestors: str = "ancestors") -> DataFrame:
    """ancestor, descendant and their depth gap, from root-to-node arrays that end in the node."""
    chain = F.slice(ancestors, 1, F.greatest(F.size(ancestors) - 1, F.lit(0)))
    pairs = nodes.select(F.col(node).alias("descendant"), F.size(ancestors).alias("n"), F.posexplode(chain).alias("at", "ancestor"))
    return pairs.select("ancestor", "descendant", (F.col("n") - 1 - F.col("at")).alias("gap"))
