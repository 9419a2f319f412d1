"""Approximate nearest neighbours: NN-descent builds a neighbour graph, greedy search walks it.

1. Rows with equal vectors become one node, the smallest id, so that a very common vector is a node
   like any other; of its rows only the smallest ids can be among the nearest of anything.
2. The graph starts from TREES sorts by the signs of random projections: runs of BLOCK nodes in a
   sort, and the first of the next run, are compared with each other. Runs are bounded, whatever the data. The
   first sort also is a spine that links every node to the next, so that no node is out of reach: a query
   meets at least as many nodes as the beam holds, or all.
3. NN-descent: in each round the neighbours of a node, with some of those whose neighbour it is, are
   compared with each other, and every node keeps its DEGREE nearest; until few links change.
4. A query starts from its own node. A hop is one Spark join: the neighbours of what its BEAM nearest
   hold and was not expanded yet, less what the query has seen before. Only they are measured, on the
   original vectors in double precision, and appended to what was seen; the beam alone is written anew.
   The search ends when all of the beam is expanded.

All nodes are indexed. DEGREE, REVERSE and BEAM are the index's size and the search's width; recall
against brute force is measured in the tests, and the README says what it is on larger tables.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import bound_batches, forget, written

#: Shape of the graph, and of the sorts it starts from.
DEGREE, REVERSE, TREES, BITS, BLOCK = 24, 16, 4, 24, 128
#: Nodes of a run that the run before it holds too, and runs of one sorted part.
SEAM, PART_BLOCKS = 24, 64
#: NN-descent ends when a round changes less than this share of links, as it will: every change is to a nearer one.
SETTLED = 0.02
#: Nodes of one local comparison task, and width of the search.
BUCKET, BEAM = 512, 200
#: Up to so many bytes, as counted, the queries' vectors are broadcast; more are shuffled.
BROADCAST_BYTES = 16 << 20


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id (long) and v (array<double>) of the rows that take part: those with an id and a vector that is not zero and has no null or non-finite component."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def packed(v: Column) -> Column:
    """Arrays of doubles as bytes of 32-bit floats, for the graph alone."""

    @F.pandas_udf("binary")
    def pack(vs: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x, "<f4").tobytes() for x in vs])

    return pack(v)


def stacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f4").reshape(len(column), -1)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def nearest_of_block(ids: np.ndarray, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row its count nearest among the block's other ids: from, to, squared distance."""
    d = squares(x, x)
    d[ids[:, None] == ids[None]] = np.inf
    count = min(count, len(ids) - 1)
    if count < 1:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)
    near = np.argpartition(d, count - 1, 1)[:, :count]
    d = np.take_along_axis(d, near, 1)
    fine = np.isfinite(d)
    return np.repeat(ids, count).reshape(-1, count)[fine], ids[near][fine], d[fine]


def best_links(links: DataFrame, count: int = DEGREE) -> DataFrame:
    """The count nearest distinct neighbours of each node, by one shuffle on the node."""
    once = links.repartition("a").groupBy("a", "b").agg(F.min("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return once.withColumn("rank", rank).where(F.col("rank") <= count).select("a", "b", "d")


def first_links(nodes: DataFrame, count: int) -> DataFrame:
    """a, b, d and spine: links from runs of BLOCK nodes, and SEAM of the next run, in TREES sorts.

    Runs go by a node's place in its sort, whatever partitions it was sorted in, so that few nodes meet as well as many. The spine
    links each node of the first sort to the next: by it every node can be reached from any other.
    """

    def codes(frames):
        for f in frames:
            x = stacked(f["x"])
            for t in range(TREES):
                planes = np.random.default_rng(100 + t).standard_normal((x.shape[1], BITS)).astype("f4")
                bits = x @ planes > 0
                code = bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                yield pd.DataFrame({"tree": t, "code": code, "node": f["node"], "x": f["x"]})

    def numbered(frames):
        part, at = TaskContext.get().partitionId(), 0
        for f in frames:
            yield pd.DataFrame({"part": part, "at": np.arange(at, at + len(f)), "tree": f["tree"], "node": f["node"], "x": f["x"]})
            at += len(f)

    def compared(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("at")
        ids, x, first = f["node"].to_numpy("i8"), stacked(f["x"]), f["tree"].to_numpy() == 0
        a, b, d = nearest_of_block(ids, x, DEGREE)
        i = np.flatnonzero(first[:-1] & first[1:])
        steps = ((x[i] - x[i + 1]) ** 2).sum(1)
        return pd.DataFrame({"a": np.concatenate([a, ids[i]]), "b": np.concatenate([b, ids[i + 1]]), "d": np.concatenate([d, steps]).astype("f8"), "spine": np.arange(len(a) + len(i)) >= len(a)})

    parts = max(1, -(-TREES * count // (PART_BLOCKS * BLOCK)))
    coded = nodes.mapInPandas(codes, "tree int, code long, node long, x binary").repartitionByRange(parts, "tree", "code", "node").sortWithinPartitions("tree", "code", "node")
    sorts = written(coded.mapInPandas(numbered, "part int, at long, tree int, node long, x binary"), "sorts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sorts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))  # a row a part
    placed = sorts.join(F.broadcast(starts), "part").withColumn("at", F.col("at") + F.col("start"))
    run = F.floor(F.col("at") / BLOCK)
    runs = F.when((F.col("at") % BLOCK < SEAM) & (run > 0), F.array(run, run - 1)).otherwise(F.array(run))
    found = placed.select("at", "tree", "node", "x", F.explode(runs).alias("run")).groupBy("run").applyInPandas(compared, "a long, b long, d double, spine boolean")
    out = written(found, "first-links")
    forget(sorts)
    return out


def descent(nodes: DataFrame, graph: DataFrame, count: int) -> DataFrame:
    """One round: candidates among the neighbours of every node that beat what a node has."""
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")
    around = best_links(graph.union(back), DEGREE + REVERSE).select("a", "b")
    around = around.union(nodes.select(F.col("node").alias("a"), F.col("node").alias("b")))
    worst = graph.groupBy("a").agg(F.max("d").alias("worst"), F.count("*").alias("n"))
    known = nodes.join(worst.withColumnRenamed("a", "node"), "node", "left")
    known = known.select(F.col("node").alias("b"), "x", F.when(F.col("n") >= DEGREE, F.col("worst")).otherwise(F.lit(float("inf"))).alias("worst"))
    joined = around.join(known, "b").withColumn("bucket", F.pmod(F.xxhash64("a"), F.lit(max(1, -(-count // BUCKET)))))

    def compare(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("a", kind="stable")
        a, ids, worst, x = f["a"].to_numpy("i8"), f["b"].to_numpy("i8"), f["worst"].to_numpy("f8"), stacked(f["x"])
        cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))
        found = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            d = squares(x[i:j], x[i:j])
            own = ids[i:j]
            k, m = np.nonzero((d < worst[i:j, None]) & (own[:, None] != own[None]))
            found.append((own[k], own[m], d[k, m]))
        if not found:
            return pd.DataFrame({"a": [], "b": [], "d": []})
        a, b, d = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((b, a))  # what several of the bucket's nodes say of one pair counts once
        a, b, d = a[order], b[order], d[order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        return pd.DataFrame({"a": a[first], "b": b[first], "d": d[first].astype("f8")})

    return joined.groupBy("bucket").applyInPandas(compare, "a long, b long, d double")


def neighbour_graph(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b, d (squared distance): the DEGREE nearest found of every node; and a, b of the spine, both ways."""
    count = nodes.count()
    first = first_links(nodes, count)
    graph = written(best_links(first.select("a", "b", "d")), "graph")
    spine = first.where("spine").select("a", "b")
    while True:
        better = written(best_links(graph.union(descent(nodes, graph, count))), "graph")
        changed = better.join(graph, ["a", "b"], "left_anti").count()
        forget(graph)
        graph = better
        if changed <= SETTLED * graph.count():
            break
    return graph, spine.union(spine.select("b", "a"))


def search(vectors: DataFrame, queries: DataFrame, count: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance): the count nearest rows of every query, without itself.

    queries: rows of vectors, by id. Rank follows distance, then the smaller id; fewer rows give
    fewer results. Rows that take no part as query or candidate: see usable(). Vectors of different lengths
    have no distance: each length is searched by itself. Equal rows that also share their id are one;
    an id with several vectors is as near as the nearest of them, as a query and as a candidate. Very long
    vectors are only longer rows. Empty tables give an empty result; extra columns do not matter.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = written(usable(vectors, vec_id, embedding).distinct(), "vectors")
    ids = queries.select(F.col(vec_id).cast("long").alias("vec_id")).distinct()
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())  # as a rule one
    found = [of_length(rows.where(F.size("v") == n), ids, count) for n in lengths]
    out = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "query_id long, vec_id long, d double")
    once = out.groupBy("query_id", "vec_id").agg(F.min("d").alias("d"))
    once = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).where(F.col("rank") <= count)
    return once.select("query_id", "rank", "vec_id", F.col("d").alias("score"))


def of_length(rows: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """query_id, vec_id and d: of each query of ids(vec_id) the count nearest other rows, and rows as near as the last; rows: vec_id and v of one length."""
    # of equal vectors the smallest ids: one is the query itself, count others can be results
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= count + 1)
    members = written(members, "members")
    reps = members.where("n = 1").select(F.monotonically_increasing_id().alias("node"), "v")  # numbers that no two vectors share
    nodes = written(reps.select("node", "v", packed(F.col("v")).alias("x")), "nodes")
    reps = nodes.select("node", "v")
    of_node = written(members.join(reps, "v").select("node", "vec_id"), "of-node")
    graph, spine = neighbour_graph(nodes.select("node", "x"))
    links = best_links(graph.union(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")), DEGREE + REVERSE)
    links = written(links.select("a", "b").union(spine).groupBy("a").agg(F.collect_set("b").alias("around")), "links")
    forget(graph)

    asked = rows.join(ids, "vec_id", "left_semi")
    asked = written(asked.join(reps, "v").select(F.col("vec_id").alias("query_id"), "node"), "queries")
    starts = written(asked.select(F.col("node").alias("q")).distinct().join(nodes.select(F.col("node").alias("q"), F.col("v").alias("q_v")), "q"), "starts")
    few = (starts.agg(F.sum(F.size("q_v") * 8 + 64)).first()[0] or 0) <= BROADCAST_BYTES
    starts = F.broadcast(starts) if few else starts
    beam = written(starts.select("q", F.col("q").alias("node"), F.lit(0.0).alias("d"), F.lit(False).alias("expanded")), "beam")
    seen = [written(beam.select("q", "node"), "seen")]
    near = Window.partitionBy("q").orderBy("d", "node")
    while True:
        front = beam.where("NOT expanded").select("q", F.col("node").alias("a"))
        new = front.join(links, "a").select("q", F.explode("around").alias("node")).distinct()
        new = new.join(reduce(DataFrame.union, seen), ["q", "node"], "left_anti")
        new = new.join(reps, "node").join(starts, "q").select("q", "node", distance(F.col("v"), F.col("q_v")).alias("d"))
        new = written(new, "seen")
        best = beam.withColumn("expanded", F.lit(True)).union(new.withColumn("expanded", F.lit(False)))
        best = written(best.withColumn("n", F.row_number().over(near)).where(F.col("n") <= BEAM).drop("n"), "beam")
        forget(beam)
        beam = best
        seen.append(new.select("q", "node"))
        if beam.where("NOT expanded").isEmpty():
            break
    # nodes at equal distances count by their ids, so that all that tie with the last are taken
    by_rank = Window.partitionBy("q").orderBy("d")
    best = beam.withColumn("n", F.rank().over(by_rank)).where(F.col("n") <= count + 1).select("q", "node", "d")
    best = best.join(of_node, "node").select(F.col("q").alias("node"), "vec_id", "d")
    return asked.join(best, "node").where("vec_id != query_id").select("query_id", "vec_id", "d")
