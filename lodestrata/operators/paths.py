"""Paths between leaves of trees: drawn without listing all pairs, related to each other, and audited.

A tree is a node table: tree, node (its number in preorder, from 0), parent, last (the last number below it) and
depth. A node with leaves n_1, n_2, ... below its children is the lowest common ancestor of the sum of n_i * n_j pairs;
so a child and the leaves after it below the same parent stand for a block of pairs that is known by its corners. Blocks of
one depth are numbered through, and an affine order visits the numbers of each depth: offset times a number without a
common factor, plus a shift. Depths take turns until enough pairs are drawn.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.distance import common_prefix_length
from lodestrata.operators.ordered import running

SALT = "leaf pairs"


def coprime(start: int, size: int) -> int:
    """The first number from start on that has no common factor with size."""
    while math.gcd(start, size) != 1:
        start += 1
    return start


def affine_order(mark: str, depth: int, size: int, salt: str = SALT) -> tuple[int, int]:
    """Factor and shift of the order of a depth's pairs, from a digest of the tree's mark and the depth."""
    found = hashlib.sha256(f"{salt}|{mark}|{depth}".encode()).hexdigest()
    return coprime(int(found[:13], 16) % size, size), int(found[13:26], 16) % size


def tree_mark(nodes: list[dict]) -> str:
    """A number that tells trees of different form apart, and takes no account of names: the sum of digests of its nodes' number, depth, label and children."""
    children = [0] * len(nodes)
    for n in nodes:
        if n["parent"] is not None:
            children[n["parent"]] += 1
    return str(sum(int(hashlib.sha256(f"{n['node']}|{n['depth']}|{n['label']}|{children[n['node']]}".encode()).hexdigest()[:12], 16) for n in nodes))


def pair_blocks(nodes: list[dict]) -> tuple[list[int], dict[int, list[tuple[int, int, int, int, int]]]]:
    """Leaves of one tree in order; and by depth of the ancestor its blocks: pairs before it, first place on the left, first on the right, places on the right, ancestor."""
    before, leaves = [], []
    for n in nodes:
        before.append(len(leaves))
        if n["last"] == n["node"]:
            leaves.append(n["node"])
    upto = [before[n["last"]] + 1 for n in nodes]
    blocks: dict[int, list] = defaultdict(list)
    sizes: dict[int, int] = defaultdict(int)
    for n in nodes[1:]:
        i, p = n["node"], n["parent"]
        size = (upto[i] - before[i]) * (upto[p] - upto[i])
        if size:
            depth = n["depth"] - 1
            blocks[depth].append((sizes[depth], before[i], upto[i], upto[p] - upto[i], p))
            sizes[depth] += size
    return leaves, {d: [*b, (sizes[d],)] for d, b in blocks.items()}


def affine_pairs(nodes: list[dict], most: int | None, salt: str = SALT) -> list[tuple[int, int, int, int]]:
    """Up to most pairs of leaves of one tree in preorder (None: all): start, end, their lowest common ancestor and its depth. Pairs are never listed."""
    leaves, blocks = pair_blocks(nodes)
    mark = tree_mark(nodes)
    turns = {}
    for depth, own in blocks.items():
        size = own[-1][0]
        turns[depth] = (size, [b[0] for b in own[:-1]], own, affine_order(mark, depth, size, salt))
    out: list[tuple[int, int, int, int]] = []
    most = sum(t[0] for t in turns.values()) if most is None else most
    offset = 0
    while turns and len(out) < most:
        for depth in sorted(turns):
            size, starts, own, (factor, shift) = turns[depth]
            if offset == size:
                del turns[depth]
                continue
            rank = (factor * offset + shift) % size
            start, low, right, width, ancestor = own[bisect_right(starts, rank) - 1]
            step, rest = divmod(rank - start, width)
            out.append((leaves[low + step], leaves[right + rest], ancestor, depth))
            if len(out) == most:
                break
        offset += 1
    return out


def sampled_paths(nodes: DataFrame, tree: str, most: int, salt: str = SALT, label: str | None = None) -> DataFrame:
    """tree, path_index (from 0), start, end, lca, lca_depth and length of up to most paths of every tree: as affine_pairs() draws them.

    All by joins and sums over ranges of the node table, so that one tree may be larger than a task. A tree of one leaf has no path.
    """
    rows = nodes.select(tree, "node", "parent", "last", "depth", (F.col(label) if label else F.lit("")).alias("label"))
    leaf = (F.col("last") == F.col("node")).cast("int")
    placed = running(rows, [tree, "node"], {"before": leaf})
    leaves = placed.where("node = last").select(F.col("before").alias("at"), "node", "depth")
    upto = placed.where("node = last").select(tree, F.col("node").alias("last"), (F.col("before") + 1).alias("upto"))
    spans = placed.join(upto, [tree, "last"])
    parents = spans.select(tree, F.col("node").alias("parent"), F.col("upto").alias("end"))
    width, exact = (F.col("end") - F.col("upto")).cast("decimal(18,0)"), "decimal(38,0)"
    size = ((F.col("upto") - F.col("before")).cast("decimal(18,0)") * width).cast(exact)
    blocks = spans.where("parent IS NOT NULL").join(parents, [tree, "parent"]).select(tree, (F.col("depth") - 1).alias("lca_depth"), "node", F.col("parent").alias("lca"), F.col("before").alias("low"), F.col("upto").alias("right"), width.alias("width"), size.alias("size")).where("size > 0")
    blocks = running(blocks, [tree, "lca_depth", "node"], {"from": F.col("size")})
    strata = blocks.groupBy(tree, "lca_depth").agg(F.min("from").alias("first"), F.sum("size").cast(exact).alias("total"))
    children = rows.where("parent IS NOT NULL").groupBy(tree, F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    own = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("node").cast("string"), F.col("depth").cast("string"), "label", F.coalesce("children", F.lit(0)).cast("string")), 256), 1, 12), 16, 10).cast(exact)
    marks = rows.join(children, [tree, "node"], "left").groupBy(tree).agg(F.sum(own).cast(exact).cast("string").alias("mark"))
    found = F.sha2(F.concat_ws("|", F.lit(salt), "mark", F.col("lca_depth").cast("string")), 256)
    number = lambda i: (F.conv(F.substring(found, i, 13), 16, 10).cast(exact) % F.col("total")).cast(exact)

    @F.pandas_udf("string")
    def first_coprime(start: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([str(coprime(int(a), int(b))) for a, b in zip(start, size, strict=True)])

    strata = strata.join(marks, tree).withColumns({"factor": number(1), "shift": number(14)})
    strata = strata.withColumn("factor", first_coprime(F.col("factor").cast("string"), F.col("total").cast("string")).cast("decimal(20,0)"))
    offsets = F.sequence(F.lit(0).cast("long"), F.least(F.col("total"), F.lit(most)).cast("long") - 1)
    turns = strata.where(F.lit(most) > 0).select("*", F.explode(offsets).alias("offset"))
    turns = turns.withColumn("path_index", F.row_number().over(Window.partitionBy(tree).orderBy("offset", "lca_depth")) - 1).where(F.col("path_index") < most)
    rank = (F.col("factor") * F.col("offset").cast("decimal(10,0)") + F.col("shift")) % F.col("total") + F.col("first")
    drawn = turns.groupBy(tree, "lca_depth").agg(F.collect_list(F.struct(rank.cast(exact).alias("rank"), "path_index")).alias("drawn"))  # most a stratum
    inside = F.filter("drawn", lambda d: (d["rank"] >= F.col("from")) & (d["rank"] < F.col("from") + F.col("size")))
    hits = blocks.join(drawn, [tree, "lca_depth"]).select(tree, "lca", "lca_depth", "low", "right", "width", "from", F.explode(inside).alias("d"))
    rest = F.col("d.rank") - F.col("from")
    hits = hits.withColumn("rest", rest.cast(exact)).withColumn("column", (F.col("rest") % F.col("width")).cast(exact)).withColumn("row", ((F.col("rest") - F.col("column")) / F.col("width")).cast(exact))
    hits = hits.select(tree, F.col("d.path_index").alias("path_index"), "lca", "lca_depth", (F.col("low") + F.col("row")).cast(exact).alias("left_at"), (F.col("right") + F.col("column")).cast(exact).alias("right_at"))
    ends = hits.join(leaves.toDF("left_at", "start", "start_depth"), "left_at").join(leaves.toDF("right_at", "end", "end_depth"), "right_at")
    return ends.select(tree, "path_index", "start", "end", "lca", "lca_depth", (F.col("start_depth") + F.col("end_depth") - 2 * F.col("lca_depth")).cast("int").alias("length"))


def path_relations(paths: DataFrame, tree: str) -> DataFrame:
    """What the paths of a tree are to each other, a row a pair in order of path_index: six distances and both paths' ancestor depths and lengths.

    paths: tree, path_index, start and end (steps from the root down, the root left out) and lca_depth. A path is two branches
    below its ancestor; two branches share the edges of their common way from the root that lie below both ancestors, so that
    no edge is listed. Pairs are all those of a tree: bound paths a tree, as sampled_paths() does.
    """
    side = lambda s: paths.select(tree, *[F.col(c).alias(f"{s}_{c}") for c in ("path_index", "start", "end", "lca_depth")])
    pairs = side("left").join(side("right"), tree).where("left_path_index < right_path_index")
    ends = [(a, b, common_prefix_length(F.col(f"left_{a}"), F.col(f"right_{b}")).alias(f"{a}_{b}")) for a in ("start", "end") for b in ("start", "end")]
    met = pairs.select("*", *[c for _, _, c in ends])
    apart = lambda a, b: F.size(f"left_{a}") + F.size(f"right_{b}") - 2 * F.col(f"{a}_{b}")
    low = F.greatest("left_lca_depth", "right_lca_depth")
    shared = sum((F.greatest(F.col(f"{a}_{b}") - low, F.lit(0)) for a, b, _ in ends), F.lit(0))
    length = lambda s: F.size(f"{s}_start") + F.size(f"{s}_end") - 2 * F.col(f"{s}_lca_depth")
    both = length("left") + length("right")
    ancestors = F.col("left_lca_depth") + F.col("right_lca_depth") - 2 * F.least("left_lca_depth", "right_lca_depth", "start_start")
    square = lambda c: (c * c).cast("double")
    direct, crossed = apart("start", "start") + apart("end", "end"), apart("start", "end") + apart("end", "start")
    ends_squared = F.least(square(apart("start", "start")) + square(apart("end", "end")), square(apart("start", "end")) + square(apart("end", "start")))
    return met.select(
        tree, F.col("left_path_index").alias("left"), F.col("right_path_index").alias("right"), direct.alias("oriented"), F.least(direct, crossed).alias("unoriented"),
        (both - 2 * shared).alias("edge_difference"), F.when(both > shared, 1 - shared / (both - shared)).otherwise(0.0).alias("edge_jaccard"),
        F.abs(F.col("left_lca_depth") - F.col("right_lca_depth")).alias("lca_depth_difference"), F.sqrt(square(ancestors) + ends_squared).alias("anchored"),
        F.abs(length("left") - length("right")).alias("length_difference"), "left_lca_depth", "right_lca_depth", length("left").alias("left_length"), length("right").alias("right_length"),
    )


def order_relations(nodes: DataFrame, tree: str, incomparable: bool = False, direct_only: bool = False) -> DataFrame:
    """tree, left, right, label (1: left is above right; 0: neither is above the other), gap of depths, distance and direct (a parent and its child).

    By intervals of numbers: right is below left where it lies in left's, and the two are incomparable where they lie apart; those
    are all such pairs of a tree, left before right; the latter need the nodes' ancestors (from the root to themselves). direct_only
    keeps parents and children of label 1.
    """
    columns = ("node", "last", "depth", "parent", *(["ancestors"] if incomparable else []))
    side = lambda s: nodes.select(tree, *[F.col(c).alias(f"{s}_{c}") for c in columns])
    pairs = side("left").join(side("right"), tree)
    direct = F.col("right_parent").eqNullSafe(F.col("left_node"))
    gap = F.col("right_depth") - F.col("left_depth")
    above = pairs.where("right_node > left_node AND right_node <= left_last").where(direct if direct_only else F.lit(True))
    out = above.select(tree, F.col("left_node").alias("left"), F.col("right_node").alias("right"), F.lit(1).alias("label"), gap.alias("gap"), gap.alias("distance"), direct.alias("direct"))
    if not incomparable:
        return out
    apart = pairs.where("right_node > left_last").withColumn("meet", common_prefix_length(F.col("left_ancestors"), F.col("right_ancestors")) - 1)
    return out.union(apart.select(tree, F.col("left_node").alias("left"), F.col("right_node").alias("right"), F.lit(0), gap, (F.col("left_depth") + F.col("right_depth") - 2 * F.col("meet")), F.lit(False)))


def context_features(paths: DataFrame, record: str, id: str, parts: str) -> DataFrame:
    """record, id and four features of every path of a record, from 0 to 1: its length, its mean and largest distance in the record's trie to the others, and how much of their beginnings it shares with them on average.

    Lengths are by the record's longest path, distances by twice that. The trie is the table of prefixes: a path shares as much with all others as
    its prefixes have others below them, and is farthest from the deepest path of another branch at one of its prefixes; so that
    paths never meet in pairs. A path alone in its record has 0 but for its length. Equal paths count each.
    """
    rows = paths.select(record, id, F.col(parts).alias("parts"), F.size(parts).alias("n"))
    steps = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("at"))
    steps = steps.withColumns({"prefix": F.slice("parts", 1, F.col("at")), "branch": F.when(F.col("at") < F.col("n"), F.element_at("parts", F.least(F.col("at") + 1, F.greatest(F.col("n"), F.lit(1)))))}).drop("parts")
    branches = steps.groupBy(record, "prefix", "branch").agg(F.count("*").alias("held"), F.max("n").alias("deep"))
    rank = F.row_number().over(Window.partitionBy(record, "prefix").orderBy(F.desc("deep"), F.col("branch").asc_nulls_first()))
    two = branches.withColumn("rank", rank).where("rank <= 2").groupBy(record, "prefix").agg(F.sort_array(F.collect_list(F.struct("rank", "deep", "branch"))).alias("two"))
    held = branches.groupBy(record, "prefix").agg(F.sum("held").alias("held"))
    first, second = F.col("two")[0], F.get("two", F.lit(1))
    other = F.when(F.col("branch").isNull() | ~first["branch"].eqNullSafe(F.col("branch")), first["deep"]).otherwise(second["deep"])
    far = F.col("n") + other - 2 * F.col("at")
    found = steps.join(held, [record, "prefix"]).join(two, [record, "prefix"]).groupBy(record, id, "n").agg(F.sum(F.when(F.col("at") > 0, F.col("held") - 1).otherwise(0)).alias("shared"), F.max(far).alias("far"))
    whole = rows.groupBy(record).agg(F.count("*").alias("paths"), F.sum("n").alias("lengths"), F.greatest(F.max("n"), F.lit(1)).alias("longest"))
    got = found.join(whole, record)
    others, scale = F.greatest(F.col("paths") - 1, F.lit(1)), F.col("longest")
    apart = (F.col("paths") - 2) * F.col("n") + F.col("lengths") - 2 * F.col("shared")
    some = lambda c: F.when(F.col("paths") > 1, c).otherwise(0.0)
    return got.select(record, id, (F.col("n") / scale).alias("length"), some(apart / others / (2 * scale)).alias("mean_distance"), some(F.greatest("far", F.lit(0)) / (2 * scale)).alias("max_distance"), some(F.col("shared") / others / scale).alias("mean_shared"))


#: The fields of an audit of identifiability: rates after counts.
COUNTS = ("nodes", "node_signatures", "lcas", "lca_signatures", "paths", "path_signatures")


def identifiability(signed: DataFrame, paths: DataFrame, tree: str) -> DataFrame:
    """Per tree with a path: how many nodes, ancestors and paths there are, how many signatures tell apart, and the three rates of collision.

    signed: tree, node, signature. paths: tree, start, end, lca. A path's signature is that of its ancestor with those of its ends, the
    lesser first; equal paths count once.
    """
    at = lambda name: signed.select(tree, F.col("node").alias(name), F.col("signature").alias(f"{name}_sign"))
    whole = paths.join(at("start"), [tree, "start"]).join(at("end"), [tree, "end"]).join(at("lca"), [tree, "lca"])
    object_ = F.struct("lca", F.least("start", "end"), F.greatest("start", "end"))
    sign = F.struct("lca_sign", F.least("start_sign", "end_sign"), F.greatest("start_sign", "end_sign"))
    of_paths = whole.groupBy(tree).agg(F.countDistinct("lca").alias("lcas"), F.countDistinct("lca_sign").alias("lca_signatures"), F.countDistinct(object_).alias("paths"), F.countDistinct(sign).alias("path_signatures"))
    of_nodes = signed.groupBy(tree).agg(F.count("*").alias("nodes"), F.countDistinct("signature").alias("node_signatures"))
    found = of_nodes.join(of_paths, tree).select(tree, *COUNTS)
    return found.select("*", *[((F.col(a) - F.col(b)) / F.col(a)).alias(f"{name}_rate") for name, a, b in zip(("node", "lca", "path"), COUNTS[::2], COUNTS[1::2], strict=True)])


def identifiability_summary(found: DataFrame) -> DataFrame:
    """Over all trees of identifiability(), a row a rate: micro (all together), macro (mean of trees) and quartiles."""
    out = None
    for name, a, b in zip(("node", "lca", "path"), COUNTS[::2], COUNTS[1::2], strict=True):
        rate = f"{name}_rate"
        one = found.agg(F.lit(name).alias("rate"), F.count("*").alias("trees"), (F.sum(F.col(a) - F.col(b)) / F.sum(a)).alias("micro"), F.avg(rate).alias("macro"), *[F.percentile(rate, F.lit(q / 100)).alias(f"q{q:03d}") for q in (0, 25, 50, 75, 100)])
        out = one if out is None else out.union(one)
    return out


def prefix_signatures(nodes: list[dict], tokens: list[str]) -> list[str]:
    """A digest of the tokens from the root to each node, by one step from its parent's: no way is read twice."""
    out: list[str] = []
    for n, token in zip(nodes, tokens, strict=True):
        above = "" if n["parent"] is None else out[n["parent"]]
        out.append(hashlib.sha256(f"{above}\0{token}".encode()).hexdigest())
    return out


def program_audit(df: DataFrame, key: str, source: str, most: int = 64, salt: str = SALT) -> DataFrame:
    """Per program: ok and failure, nodes, leaves, pairs of leaves, paths drawn, a digest of their ends and how many lie at each depth of the ancestor.

    A program that does not parse, or has fewer than two leaves, is a row with the failure named. The pairs are
    counted from the leaves below children, not listed; the digest is a sum over paths, whatever their order.
    """
    from lodestrata.operators.trees import parse_failure, python_nodes

    fields = "ok boolean, failure string, nodes int, leaves int, pairs long, paths int, ends string, depths map<int,int>, node_rate double, lca_rate double, path_rate double"

    @F.pandas_udf(fields)
    def audit(sources: pd.Series) -> pd.DataFrame:
        rows = []
        for s in sources:
            nodes = python_nodes(s)
            if nodes is None:
                rows.append((False, parse_failure(s), None, None, None, None, None, None, None, None, None))
                continue
            leaves, blocks = pair_blocks(nodes)
            pairs = len(leaves) * (len(leaves) - 1) // 2
            if not pairs:
                rows.append((False, "fewer than two leaves", len(nodes), len(leaves), 0, 0, None, None, None, None, None))
                continue
            found = affine_pairs(nodes, most, salt)
            ends = sum(int(hashlib.sha256(f"{i}|{j}".encode()).hexdigest()[:15], 16) for i, j, _, _ in found)
            depths: dict[int, int] = defaultdict(int)
            for *_, d in found:
                depths[d] += 1
            signs = prefix_signatures(nodes, [n["label"] for n in nodes])
            met = {a for _, _, a, _ in found}
            rates = [1 - len(set(signs)) / len(nodes), 1 - len({signs[a] for a in met}) / len(met), 1 - len({(signs[a], *sorted((signs[i], signs[j]))) for i, j, a, _ in found}) / len(found)]
            sound = len(found) == min(most, pairs) == len({f[:2] for f in found})
            rows.append((sound, None if sound else "paths drawn twice", len(nodes), len(leaves), pairs, len(found), str(ends), dict(depths), *rates))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")]).astype(object)

    return df.select(key, audit(F.col(source)).alias("a")).select(key, "a.*")
