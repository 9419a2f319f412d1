"""Syntax trees as node tables, and what is computed from one tree at a time in Arrow batches."""

from __future__ import annotations

import ast
import hashlib
import io
import keyword
import math
import tokenize
import warnings
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.paths import affine_pairs

#: A node: its number in preorder, its parent's (null for the root), place among its siblings, depth,
#: label, last number in its subtree, and the numbers from the root to it; the field of the parent that holds it (root: of
#: none), its place in that field, the text of a terminal, the name it bears and its line and column.
NODES = "array<struct<node: int, parent: int, child_index: int, depth: int, label: string, last: int, ancestors: array<int>, edge: string, place: int, token: string, name: string, span: string>>"
#: Path selection orders.
POLICIES = ("preorder_first", "hash_sorted", "lca_depth_stratified", "lca_depth_affine")


def flat(value: object) -> list[object]:
    """The parts of a field, however its lists nest, that are nodes or scalars (None too)."""
    out, stack = [], [value]
    while stack:
        part = stack.pop()
        if isinstance(part, list | tuple):
            stack += reversed(part)
        elif part is None or isinstance(part, ast.AST | str | int | float | bool):
            out.append(part)
    return out


def python_nodes(source: str | None) -> list[dict] | None:
    """Nodes of a Python program in preorder; scalar fields (None too) are TerminalToken leaves; null where it does not parse."""
    if source is None:
        return None
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out: list[dict] = []
    stack: list[tuple[object, int | None, int, tuple[int, ...], str, int]] = [(tree, None, 0, (), "root", 0)]
    while stack:
        item, parent, index, above, edge, place = stack.pop()
        number, is_node = len(out), isinstance(item, ast.AST)
        row = {"node": number, "parent": parent, "child_index": index, "depth": len(above), "label": type(item).__name__ if is_node else "TerminalToken", "last": number, "ancestors": [*above, number], "edge": edge, "place": place, "token": None, "name": None, "span": None}
        out.append(row)
        if not is_node:
            row["token"] = str(item)
            continue
        own = getattr(item, "name", None)
        row["name"] = own if isinstance(own, str) and own else None
        if hasattr(item, "lineno") and hasattr(item, "col_offset"):
            row["span"] = f"{item.lineno}:{item.col_offset}"
        children = [(child, field, i) for field, value in ast.iter_fields(item) for i, child in enumerate(flat(value))]
        stack += [(child, number, i, (*above, number), field, at) for i, (child, field, at) in reversed(list(enumerate(children)))]
    for row in reversed(out):
        if row["parent"] is not None:
            out[row["parent"]]["last"] = max(out[row["parent"]]["last"], row["last"])
    return out


def parse_failure(source: str | None) -> str | None:
    """The name of the error that keeps a program from being parsed; null for one that parses."""
    if source is None:
        return "no source"
    try:
        ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        return type(error).__name__
    return None


def parse_python(source: Column) -> Column:
    """Nodes of each program, or null."""

    @F.pandas_udf(NODES)
    def parse(sources: pd.Series) -> pd.Series:
        return pd.Series([python_nodes(s) for s in sources], dtype=object)

    return parse(source)


def node_table(df: DataFrame, tree_id: str, source: str) -> DataFrame:
    """A row a node: tree_id and the fields of NODES."""
    return df.select(tree_id, F.explode(parse_python(F.col(source))).alias("n")).select(tree_id, "n.*")


def label_histogram(nodes: DataFrame, tree_id: str) -> DataFrame:
    return nodes.groupBy(tree_id, "label").agg(F.count("*").alias("n"))


def label_transitions(nodes: DataFrame, tree_id: str) -> DataFrame:
    """parent and child labels with their count and share, by one self-join on the tree's own numbers."""
    parents = nodes.select(tree_id, F.col("node").alias("parent"), F.col("label").alias("parent_label"))
    counts = nodes.where("parent IS NOT NULL").join(parents, [tree_id, "parent"]).groupBy(tree_id, "parent_label", F.col("label").alias("child_label")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(tree_id, "parent_label")))


def shape(nodes: DataFrame, tree_id: str) -> DataFrame:
    """Nodes, leaves, depth, mean depth and mean children of inner nodes of every tree."""
    leaf = F.col("last") == F.col("node")
    return nodes.groupBy(tree_id).agg(F.count("*").alias("nodes"), F.sum(leaf.cast("long")).alias("leaves"), F.max("depth").alias("depth"), F.avg("depth").alias("mean_depth"), ((F.count("*") - 1) / F.greatest(F.lit(1), F.sum((~leaf).cast("long")))).alias("branching"))


def leaf_pairs(leaves: list[tuple[int, list[int]]], most: int, policy: str) -> list[tuple[int, int, int, int]]:
    """Up to most pairs of leaves: start, end, their lowest common ancestor and its depth, in the policy's order.

    All pairs of a tree are held, but for preorder_first; for large trees see paths.affine_pairs().
    """

    def met(a: list[int], b: list[int]) -> tuple[int, int]:
        depth = 0
        for x, y in zip(a, b, strict=False):
            if x != y:
                break
            depth += 1
        return a[depth - 1], depth - 1

    rows = ((i, j, *met(a, b)) for (i, a), (j, b) in combinations(leaves, 2))
    if policy == "preorder_first":
        return [row for row, _ in zip(rows, range(most), strict=False)]
    if policy == "hash_sorted":
        return sorted(rows, key=lambda r: hashlib.sha256(f"{r[0]}\0{r[1]}".encode()).digest())[:most]
    if policy == "lca_depth_stratified":
        strata: dict[int, list] = {}
        for row in rows:
            strata.setdefault(row[3], []).append(row)
        turns = sorted((n, depth, row) for depth, own in strata.items() for n, row in enumerate(own))
        return [row for _, _, row in turns[:most]]
    raise ValueError(f"unknown policy {policy}")


def terminal_paths(df: DataFrame, tree_id: str, source: str, most: int = 64, policy: str = "lca_depth_affine") -> DataFrame:
    """tree_id, path_index, start, end, lca, lca_depth and length of leaf-to-leaf paths; most bounds a tree's paths, as a feature."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")

    @F.pandas_udf("array<struct<path_index: int, start: int, end: int, lca: int, lca_depth: int, length: int>>")
    def paths(sources: pd.Series) -> pd.Series:
        out = []
        for s in sources:
            nodes = python_nodes(s) or []
            leaves = [(n["node"], n["ancestors"]) for n in nodes if n["last"] == n["node"]]
            found = affine_pairs(nodes, most) if policy == "lca_depth_affine" else leaf_pairs(leaves, most, policy)
            out.append([{"path_index": k, "start": i, "end": j, "lca": a, "lca_depth": d, "length": nodes[i]["depth"] + nodes[j]["depth"] - 2 * d} for k, (i, j, a, d) in enumerate(found)])
        return pd.Series(out, dtype=object)

    return df.select(tree_id, F.explode(paths(F.col(source))).alias("p")).select(tree_id, "p.*")


def anchored_distance(lca_gap: Column, direct: Column, crossed: Column) -> Column:
    """Root of the squared gap of two paths' common ancestors and of the lesser of direct and crossed end distances."""
    return F.sqrt(lca_gap * lca_gap + F.pow(F.least(direct, crossed), 2))


def hyperbolicity(distance: np.ndarray) -> float:
    """Largest four-point delta of a small distance matrix."""
    worst = 0.0
    for a, b, c, d in combinations(range(len(distance)), 4):
        sums = sorted((distance[a, b] + distance[c, d], distance[a, c] + distance[b, d], distance[a, d] + distance[b, c]))
        worst = max(worst, (sums[2] - sums[1]) / 2)
    return worst


def normalized_stress(distance: np.ndarray, embedded: np.ndarray) -> tuple[float, float, float]:
    """Best scale, normalised stress and median relative error of embedded distances against true ones."""
    up = np.triu_indices(len(distance), 1)
    d, e = distance[up], embedded[up]
    scale = float(d @ e / max(e @ e, 1e-12))
    return scale, math.sqrt(float(((d - scale * e) ** 2).sum() / max(float((d**2).sum()), 1e-12))), float(np.median(np.abs(d - scale * e) / np.maximum(d, 1e-12)))


#: The fields that hold names and the series each counts in, in the order of naming; * stands for
#: the node's parts, which are named where it stands, or else at the end.
NAMED = {
    "Name": [("id", "ID")],
    "arg": [("arg", "ID"), ("*", "")],
    "Attribute": [("*", ""), ("attr", "ATTR")],
    "keyword": [("arg", "ATTR"), ("*", "")],
    "FunctionDef": [("name", "ID"), ("*", "")],
    "AsyncFunctionDef": [("name", "ID"), ("*", "")],
    "ClassDef": [("name", "ID"), ("*", "")],
    "alias": [("name", "IMPORT"), ("asname", "ID")],
}
#: What stands for a constant of each type.
CONSTANTS = {"NoneType": "<NONE>", "bool": "<BOOL>", "bytes": "<BYTES>", "str": "<STRING>", "int": "<INTEGER>", "float": "<FLOAT>", "complex": "<COMPLEX>", "ellipsis": "<ELLIPSIS>"}


def canonical(tree: ast.AST) -> ast.AST:
    """The tree with names numbered by first appearance in their series and constants replaced by their type, in place.

    One walk over a stack of steps: a node to enter, or a (node, field, series) to name.
    """
    series: dict[tuple[str, str], str] = {}
    size: dict[str, int] = {}
    steps: list = [tree]
    while steps:
        step = steps.pop()
        if isinstance(step, tuple):
            node, field, kind = step
            if (name := getattr(node, field)) is None or (kind == "ID" and keyword.iskeyword(name)):
                continue
            if (kind, name) not in series:
                series[kind, name] = f"{kind}_{size.get(kind, 0)}"
                size[kind] = size.get(kind, 0) + 1
            setattr(node, field, series[kind, name])
        elif isinstance(step, ast.Constant):
            step.value, step.kind = CONSTANTS[type(step.value).__name__], None
        else:
            order = []
            if isinstance(step, ast.arg):
                step.type_comment = None
            for field, kind in NAMED.get(type(step).__name__, [("*", "")]):
                order += [(step, field, kind)] if kind else ast.iter_child_nodes(step)
            steps += reversed(order)
    return tree


def structure_signature(source: str | None) -> str | None:
    """Hex SHA-256 of a program's canonical tree: equal for programs that differ in names, constants and layout; null where it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SyntaxWarning)
            tree = canonical(ast.parse(source, type_comments=True))
        return hashlib.sha256(ast.dump(tree).encode()).hexdigest()
    except (SyntaxError, ValueError, RecursionError, MemoryError, TypeError):
        return None


def lexical_tokens(source: str | None) -> list[str] | None:
    """type:text of a program's tokens, without comments, layout and ends; null where it cannot be parted."""
    try:
        found = list(tokenize.generate_tokens(io.StringIO(source).readline))
    except (tokenize.TokenError, SyntaxError, TypeError):
        return None
    return [f"{tokenize.tok_name[t.type]}:{t.string}" for t in found if tokenize.tok_name[t.type] not in LAYOUT]


#: Token types that are layout.
LAYOUT = {"ENCODING", "ENDMARKER", "INDENT", "DEDENT", "NEWLINE", "NL", "COMMENT"}


def program_signatures(source: Column) -> Column:
    """tokens (array) and structure (digest) of programs, each null where it cannot be had."""

    @F.pandas_udf("tokens array<string>, structure string")
    def signed(sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"tokens": pd.Series([lexical_tokens(s) for s in sources], dtype=object), "structure": pd.Series([structure_signature(s) for s in sources], dtype=object)})

    return signed(source)


def renamed(source: str, prefix: str = "v") -> str:
    """The program with what it binds itself renamed in order of binding: arguments, assigned names, functions and classes.

    Names that it does not bind (built-in ones, imports, attributes, keywords of calls) stay, so that it still runs. A program
    that calls a keyword by an argument's name, or looks its names up by text, may not.
    """
    tree = ast.parse(source)
    bound: dict[str, str] = {}
    kept = {a.asname or a.name.split(".")[0] for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom) for a in n.names}
    kept |= {k.arg for n in ast.walk(tree) if isinstance(n, ast.Call) for k in n.keywords}
    kept |= {x for n in ast.walk(tree) if isinstance(n, ast.ClassDef) for b in n.body for x in ([b.name] if hasattr(b, "name") else [t.id for t in ast.walk(b) if isinstance(t, ast.Name)])}
    fields = [(n, field) for n in ast.walk(tree) for field in ("id", "arg", "name") if isinstance(n, ast.Name | ast.arg | ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.ExceptHandler | ast.MatchAs | ast.MatchStar) and isinstance(getattr(n, field, None), str)]
    for node, field in fields:
        name = getattr(node, field)
        if name not in kept and not (isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load)):
            bound.setdefault(name, f"{prefix}{len(bound)}")
    for node, field in fields:
        setattr(node, field, bound.get(getattr(node, field), getattr(node, field)))
    for node in ast.walk(tree):
        if isinstance(node, ast.Global | ast.Nonlocal):
            node.names = [bound.get(n, n) for n in node.names]
    return ast.unparse(tree)


def leaves(nodes: DataFrame, tree: str) -> DataFrame:
    """Nodes of nodes(tree, node, last) that have none below them."""
    return nodes.where("node = last")


def subtrees(nodes: DataFrame, tree: str, roots: DataFrame) -> DataFrame:
    """The nodes below and at each root of roots(tree, node), as trees of their own: tree, root, node (numbered from 0), parent (null for the root), depth and label.

    A subtree is an interval of numbers, so that a join on the tree with a range on the number finds it.
    """
    tops = roots.select(tree, F.col("node").alias("root")).join(nodes.select(tree, F.col("node").alias("root"), F.col("last").alias("upto"), F.col("depth").alias("root_depth")), [tree, "root"])
    inside = tops.join(nodes, tree).where("node BETWEEN root AND upto")
    return inside.select(tree, "root", (F.col("node") - F.col("root")).alias("node"), F.when(F.col("node") > F.col("root"), F.col("parent") - F.col("root")).alias("parent"), (F.col("depth") - F.col("root_depth")).alias("depth"), "label")


#: Labels of Python nodes that can be called.
CALLABLES = ("FunctionDef", "AsyncFunctionDef", "Lambda")


def callable_roots(nodes: DataFrame, tree: str, labels: tuple[str, ...] = CALLABLES) -> DataFrame:
    """tree and node of the nodes with one of the labels."""
    return nodes.where(F.col("label").isin(*labels)).select(tree, "node")


#: Rows of a group that one key holds.
GROUP_ROWS = 1024


def pairs_of_groups(rows: DataFrame, group: str, left: tuple[str, ...], right: tuple[str, ...]) -> DataFrame:
    """Every pair of rows of one group, with names for the columns of both sides; the first of those orders the two and tells rows apart.

    A group's left rows are dealt into blocks of about GROUP_ROWS, and its right rows go once to each, so that a large group is the work of many tasks.
    """
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("blocks"))
    tasks = 4 * (sizes.agg(F.sum("blocks")).first()[0] or 1)
    x = rows.toDF(group, *left).join(sizes, group).withColumn("block", F.pmod(F.xxhash64(left[0]), "blocks").cast("int"))
    y = rows.toDF(group, *right).join(sizes, group).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x, y = (d.drop("blocks").repartition(min(tasks, 4096), group, "block") for d in (x, y))
    return y.join(x.hint("shuffle_hash"), [group, "block"]).where(F.col(left[0]) < F.col(right[0])).drop("block")


def meeting_depth(left: Column, right: Column, distance: Column) -> Column:
    """Half of what two depths exceed the distance by: the depth of the lowest common ancestor in a tree."""
    return (left + right - distance) / 2


def end_distances(start: Column, end: Column, crossed_start: Column, crossed_end: Column) -> tuple[Column, Column]:
    """Distance of two paths by their ends in order, and by the better of both orders: from those of start-start, end-end, start-end and end-start."""
    direct = start + end
    return direct, F.least(direct, crossed_start + crossed_end)


def signatures(nodes: DataFrame, tree: str) -> DataFrame:
    """nodes with signature: label and place among its siblings of every node from the root down, joined by bars."""
    steps = nodes.select(tree, F.col("node").alias("step"), F.concat_ws(":", "label", F.col("child_index").cast("string")).alias("part"))
    chain = nodes.select(tree, "node", F.posexplode("ancestors").alias("at", "step")).join(steps, [tree, "step"])
    whole = chain.groupBy(tree, "node").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))  # as long as the node is deep
    joined = F.array_join(F.transform("parts", lambda p: p["part"]), "|")
    return nodes.join(whole.select(tree, "node", joined.alias("signature")), [tree, "node"])


def collisions(rows: DataFrame, by: list[str], signature: Column) -> DataFrame:
    """By group: n, distinct, colliding (n less distinct) and the rate of it, 0 for none."""
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(signature).alias("distinct"))
    return found.withColumn("colliding", F.col("n") - F.col("distinct")).withColumn("rate", F.when(F.col("n") > 0, F.col("colliding") / F.col("n")).otherwise(0.0))


def collision_summary(found: DataFrame) -> DataFrame:
    """Rate over all of collisions() together, mean of the groups' rates, and their quartiles, one row."""
    q = F.percentile("rate", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    out = found.agg(F.count("*").alias("groups"), F.coalesce(F.sum("colliding") / F.sum("n"), F.lit(0.0)).alias("micro"), F.avg("rate").alias("macro"), q.alias("q"))
    return out.select("groups", "micro", "macro", *[F.col("q")[i].alias(f"q{p:03d}") for i, p in enumerate((0, 25, 50, 75, 100))])


def synthetic_tree(kind: str, size: int, arms: int = 2) -> list[int | None]:
    """Parents of the nodes of a tree in order: line, star, balanced (arms children a node) or comb (a line whose nodes each bear a leaf)."""
    if kind == "line":
        return [None, *range(size - 1)][:size]
    if kind == "star":
        return [None, *[0] * (size - 1)][:size]
    if kind == "balanced":
        return [None, *[(i - 1) // arms for i in range(1, size)]][:size]
    if kind == "comb":
        return [None, *[i - 1 if i % 2 else max(i - 2, 0) for i in range(1, size)]][:size]
    raise ValueError(f"unknown kind {kind}")


def tree_distances(parents: list[int | None]) -> np.ndarray:
    """Steps between all nodes of a tree whose nodes come after their parents."""
    d = np.zeros((len(parents), len(parents)))
    for i, p in enumerate(parents):
        if p is not None:
            d[i, :i] = d[:i, i] = d[p, :i] + 1
    return d


def grid_distances(side: int) -> np.ndarray:
    """Steps between all points of a square grid, row by row."""
    at = np.array([(i, j) for i in range(side) for j in range(side)])
    return np.abs(at[:, None] - at[None]).sum(-1).astype(float)


def counter_gap(left: Column, right: Column) -> Column:
    """One less the share that two counters (maps of counts) have in common: 0 where both are empty."""
    keys = F.array_union(F.map_keys(left), F.map_keys(right))
    at = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0)).cast("double")
    common = F.aggregate(keys, F.lit(0.0), lambda a, k: a + F.least(at(left, k), at(right, k)))
    most = F.aggregate(keys, F.lit(0.0), lambda a, k: a + F.greatest(at(left, k), at(right, k)))
    return F.when(most > 0, 1 - common / most).otherwise(0.0)


#: Weights of the gap of shapes, of labels and of child counts.
GAP_WEIGHTS = (0.5, 0.3, 0.2)


def structural_gap(left_shape: Column, right_shape: Column, labels: Column, degrees: Column) -> Column:
    """Gap of two trees, 1 at most: the mean relative gap of their shapes (arrays of numbers), and counter_gap() of labels and of child counts, weighted."""
    gaps = F.zip_with(left_shape, right_shape, lambda x, y: F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0)))
    mean = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / F.size(gaps)
    return F.least(F.lit(1.0), GAP_WEIGHTS[0] * mean + GAP_WEIGHTS[1] * labels + GAP_WEIGHTS[2] * degrees)


def hard_negatives(pairs: DataFrame, least_gap: float = 0.05) -> DataFrame:
    """anchor, item and score of each anchor's hardest other of pairs(anchor, item, similarity, gap): the largest similarity times gap.

    Only gaps of least_gap or more count where an anchor has any, else the largest gap wins. Ties go to the larger
    similarity, then gap, then item. One aggregate.
    """
    score = F.col("similarity") * F.col("gap")
    near = F.struct(score.alias("first"), F.col("similarity").alias("second"), F.col("gap").alias("third"), F.col("item").alias("item"))
    far = F.struct(F.col("gap").alias("first"), F.col("similarity").alias("second"), F.lit(0.0).alias("third"), F.col("item").alias("item"))
    found = pairs.where("anchor != item").groupBy("anchor").agg(F.max(F.when(F.col("gap") >= least_gap, near)).alias("near"), F.max(far).alias("far"))
    return found.select("anchor", F.coalesce("near.item", "far.item").alias("item"), F.coalesce(F.col("near.first"), F.col("far.first") * F.col("far.second")).alias("score"))


def typed_branch(up: Column, down: Column) -> Column:
    """A path as text: labels from one end up to the common ancestor (^), and from there down to the other end (_)."""
    return F.concat(F.array_join(up, "^"), F.when(F.size(down) > 0, F.concat(F.lit("_"), F.array_join(down, "_"))).otherwise(F.lit("")))


def path_features(paths: DataFrame, tree: str, weights: dict[str, float]) -> DataFrame:
    """tree, feature and weight of path tables (tree, start, end, lca labels and length): weighted counts of each named view of a path.

    Views: lca, start, end, triple, length. Ends count alike in both orders in a triple.
    """
    first, second = F.least("start", "end"), F.greatest("start", "end")
    views = {"lca": F.col("lca"), "start": F.col("start"), "end": F.col("end"), "triple": F.concat_ws("~", first, "lca", second), "length": F.col("length").cast("string")}
    parts = F.array(*[F.struct(F.concat(F.lit(f"{v}="), views[v]).alias("feature"), F.lit(float(w)).alias("w")) for v, w in weights.items()])
    return paths.select(tree, F.explode(parts).alias("p")).groupBy(tree, "p.feature").agg(F.sum("p.w").alias("weight"))
