"""Near-duplicates by bottom-k sketches of one hash function.

1. Every text becomes the set of 64-bit hashes of its word shingles; its SKETCH smallest hashes are
   kept. Equal sets are one node from here on, so that a group of exact copies is one row.
2. The LISTED smallest hashes of each node form inverted lists. Two sets with a Jaccard similarity
   of J share the smallest element of their union with probability J, so that a pair at 0.8 misses
   all of them with probability 0.2 ** LISTED; sets no larger than LISTED are listed whole, and their
   pairs are never missed. A list longer than COMMON belongs to a passage that many texts share.
3. Short lists give the pairs of sets whose sizes allow the similarity, and the number of lists they
   share, their overlap, which for similar sets is most. A pair goes on if the union sketch of its
   two sketches puts it at SLACK below the similarity asked for or higher, six standard deviations;
   then its full sets are intersected.
4. Nodes made to MOSTLY of common values may be similar by these alone, and are so held against each
   other exactly: their full sets are counted, and each set keeps of its values that another set
   shares only those among its rarest, so many that any similar set shares one of them. A set
   with too many values of its own keeps none, for nothing can be similar to it. The place of
   a value among the rarest bounds how large a partner may be. Hubs of these lists, the sets with
   the least of their own, are compared with the others first; then lists whose members are in one
   component are done, and of the others every pair across components that the bounds allow is
   compared, once, at the first value that it shares.
5. Links become components, beyond a bounded number of them by large-star and small-star steps.

Nothing of these is gathered on the driver; every step is written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import bound_batches, forget, give_back, written

#: Hashes kept of each set, and how many of them are listed.
SKETCH, LISTED = 64, 32
#: The length from which a list counts as common.
COMMON = 64
#: Share of common values among the listed ones from which a set is compared through its full set: what
#: the rest of the list then says is of LISTED * (1 - MOSTLY) values at a similarity of 0.71 or more. For a
#: set listed whole it is what similarity alone demands.
MOSTLY = 0.3
#: Short lists that a pair must share, as a share of the smaller set's values in lists that are not common.
OVERLAP = 0.1
#: How many hubs of each list are compared in each of the first rounds; then comes what they leave.
HUBS = (1, 8)
#: Of a set's values before the one at hand, how many tell whether a pair has been met; beyond them it may be met again.
EARLIER = 64
#: How far below the similarity asked for an estimate may be for the pair to be verified.
SLACK = 0.32
#: Up to so many bytes, as counted, one side of a join is broadcast; more is shuffled.
BROADCAST_BYTES = 4 << 20
#: Links that one task settles; more are settled by steps over all tasks.
ONE_TASK = 1_000_000
#: Bytes of text hashed at once.
BYTES_AT_ONCE = 250_000

#: The bytes that part words; all others, of UTF-8 text, are of words.
PARTS = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_WORD = np.array([n not in PARTS for n in range(256)])
#: Random odd factors that make up a word's hash from its bytes (A-Z as a-z) and their places.
_random = np.random.default_rng(6)
BYTE_VALUES = np.where(IS_WORD, _random.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1), np.uint64(0))
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
PLACE_VALUES = _random.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
ODD = [np.uint64(n) for n in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407)]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, one after another, and the number of words of each text."""
    coded = [(t or "").encode() for t in texts]
    codes = np.frombuffer(b" ".join([*coded, b""]), np.uint8)
    inside = IS_WORD[codes]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    ends = np.cumsum([len(c) + 1 for c in coded])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    if not len(starts):
        return np.zeros(0, "u8"), counts
    codes = codes[starts[0] :]
    place = np.arange(len(codes)) - np.repeat(starts - starts[0], np.diff(np.concatenate([starts, [starts[0] + len(codes)]])))
    values = BYTE_VALUES[codes] * PLACE_VALUES[place & 255]
    if place.max() > 255:  # long words: another factor for every 256 bytes
        values *= np.cumprod(np.full((int(place.max()) >> 8) + 1, ODD[2]))[place >> 8]
    return mixed(np.add.reduceat(values, starts - starts[0])), counts


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = h ^ h >> np.uint64(32)
    h = h * ODD[1]
    return h ^ h >> np.uint64(29)


def shingle_sets(texts: list[str | None], width: int):
    """Of each text, the sorted distinct 64-bit hashes of its shingles; of all its words where they are fewer."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= BYTES_AT_ONCE):
            size += len(texts[end] or "")
            end += 1
        hashes, counts = word_hashes(texts[at:end])
        last = np.cumsum(counts)
        for first, n in zip((last - counts).tolist(), counts.tolist(), strict=True):
            h, own = hashes[first : first + n], min(width, n)
            total = np.zeros(n - own + 1, "u8")
            for k in range(own):  # a polynomial in an odd base keeps the order of the words
                total = total * ODD[0] + h[k : n - own + 1 + k]
            yield np.unique(mixed(total + np.uint64(own))) if n else np.zeros(0, "u8")
        at = end


def sketches(df: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """doc_id, text_hash, n (set size), set_id (a 128-bit digest of the set) and sketch (its smallest hashes)."""
    bound_batches(df.sparkSession)

    @F.pandas_udf("n long, set_id binary, sketch array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        rows = [(len(s), xxhash.xxh3_128_digest(s.tobytes()), s[:SKETCH].view("i8").copy()) for s in shingle_sets(texts.tolist(), width)]
        give_back()
        return pd.DataFrame(rows, columns=["n", "set_id", "sketch"])

    words = F.col(text).cast("string")
    return df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(words).alias("text_hash"), sketch(words).alias("s")).select("doc_id", "text_hash", "s.*")


def union_share(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common values among the smallest of the union of two sketches.

    Where a sketch is cut, what lies over its end is unknown and does not count.
    """
    whole = np.union1d(a, b)
    for s in (a, b):
        if len(s) == SKETCH:
            whole = whole[whole <= s[-1]]
    both = np.intersect1d(a, b, assume_unique=True)
    return float((both <= whole[-1]).sum() / len(whole)) if len(whole) else 0.0


def estimated(percent: int):
    """A function of two sketches: whether the union sketch leaves it open that they are similar enough."""

    @F.pandas_udf("boolean")
    def open_(left: pd.Series, right: pd.Series) -> pd.Series:
        least = percent / 100 - SLACK
        return pd.Series([union_share(np.asarray(a, "i8").view("u8"), np.asarray(b, "i8").view("u8")) >= least for a, b in zip(left, right, strict=True)])

    return open_


def full_sets(df: DataFrame, nodes: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """node and s, its full set as an array of longs, for nodes(node, rep, set_id): from the text of row rep whose set is set_id."""

    @F.pandas_udf("id binary, s array<long>")
    def full(texts: pd.Series) -> pd.DataFrame:
        rows = [(xxhash.xxh3_128_digest(s.tobytes()), s.view("i8")) for s in shingle_sets(texts.tolist(), width)]
        give_back()
        return pd.DataFrame(rows, columns=["id", "s"])

    texts = df.select(F.col(doc_id).alias("rep"), F.col(text).cast("string").alias("text"))
    chosen = texts.join(bounded(nodes, 64), "rep").select("node", "set_id", full("text").alias("f"))
    return chosen.where("f.id = set_id").select("node", "f.s")


def bounded(df: DataFrame, row_bytes: int = 0, size: str = "") -> DataFrame:
    """df, marked for a broadcast if it is within BROADCAST_BYTES: row_bytes a row and 8 for each element of the array column size."""
    share = F.lit(row_bytes) + (F.size(size) * 8 if size else 0)
    total = df.agg(F.sum(share.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node each reaches, by spreading minima and jumping to their own."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    comp = np.arange(len(nodes))
    while True:
        low = np.minimum(comp[left], comp[right])
        new = comp.copy()
        for side in (left, right, comp[left], comp[right]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == comp).all():
            return nodes, nodes[comp]
        comp = new


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest id reachable) for every node of edges(a, b).

    Up to ONE_TASK edges, 16 bytes each, are settled in a single task on an executor; more of them by
    large-star and small-star steps.
    """
    edges = written(edges, "edges")
    if edges.count() <= ONE_TASK:

        def settle(frames):
            found = [f for f in frames if len(f)]
            if found:
                whole = pd.concat(found)
                nodes, comp = smallest_reachable(whole["a"].to_numpy("i8"), whole["b"].to_numpy("i8"))
                yield pd.DataFrame({"node": nodes, "comp": comp})

        return edges.coalesce(1).mapInPandas(settle, "node long, comp long")
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    before = sign(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        after = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        got = sign(after)
        forget(now, large)
        now = after
        if got == before:
            break
        before = got
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()


def rare_lists(sets: DataFrame, percent: int) -> DataFrame:
    """Inverted lists of the rarest values of full sets: g, node, n, own, reach and earlier.

    sets: node and s, every set once. Any two of the sets that are percent similar share a value g of which both
    have a row, and n of either is at most the other's reach there: with a set's values in order of
    frequency, a pair that first meets at place p of a set shares at most n - p values. own: values that
    no other set has; earlier: values of the set before g, EARLIER at most.
    """
    values = sets.select("node", F.explode("s").alias("g"))
    held = values.groupBy("g").agg(F.count("*").alias("held")).where("held > 1")
    ranked = values.join(held, "g").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "g"))).alias("t"))
    ranked = ranked.join(sets.select("node", F.size("s").cast("long").alias("n")), "node")
    ranked = ranked.withColumns({"own": F.col("n") - F.size("t"), "t": F.transform("t", lambda x: x["g"])})
    upto = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("own")  # of shared values, the rarest
    lists = ranked.withColumn("upto", upto.cast("int")).where("upto > 0")
    lists = lists.select("node", "n", "own", "t", F.posexplode(F.slice("t", 1, F.col("upto"))).alias("k", "g"))
    reach = F.floor((F.col("n") - F.col("own") - F.col("k")) * (100 + percent) / percent) - F.col("n")
    lists = lists.select("g", "node", "n", "own", reach.alias("reach"), F.slice("t", 1, F.least("k", F.lit(EARLIER))).alias("earlier")).where(F.col("reach") * 100 >= F.col("n") * percent)
    lists = written(lists, "rare-lists")
    sizes = lists.groupBy("g").agg(F.count("*").alias("length"), F.min("n").alias("low")).where("length > 1")
    return lists.join(sizes, "g").where("reach >= low").drop("length", "low")


def decided(df: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """Per row of df: doc_id, text_hash, n_shingles, component_id and kept, as in duplicates()."""
    if percent < 60:
        raise ValueError("percent: 60 at least")
    made = written(sketches(df, doc_id, text, width), "sketches")
    nodes = made.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # the written numbers stay

    postings = nodes.select("node", F.explode(F.slice("sketch", 1, LISTED)).alias("v"))
    lengths = postings.groupBy("v").agg(F.count("*").alias("length")).where("length > 1")
    shared = written(postings.join(lengths, "v").select("v", "node", (F.col("length") > COMMON).alias("common")), "lists")
    by_node = shared.groupBy("node").agg(F.sum(F.col("common").cast("int")).alias("n_common"))
    by_node = by_node.join(nodes.select("node", "n", F.least("n", F.lit(LISTED)).alias("listed")), "node")
    # a set listed whole can reach percent through common values only if they make up as much of it
    mostly = F.col("n_common") * 100 >= F.col("listed") * F.when(F.col("n") <= LISTED, percent).otherwise(int(100 * MOSTLY))
    by_node = written(by_node.select("node", "n", (F.col("listed") - F.col("n_common")).alias("rare"), mostly.alias("mostly")), "rare")

    # Short lists: their pairs, no more than COMMON / 2 a posting, with the number of lists they share.
    short = shared.where("NOT common").select("v", "node").join(by_node, "node")
    fit = F.expr(f"x.v = y.v AND x.node < y.node AND NOT (x.mostly AND y.mostly) AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
    pairs = short.alias("x").join(short.alias("y"), fit).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("overlap"), F.min(F.least("x.rare", "y.rare")).alias("rare"))
    near = written(pairs.where(F.col("overlap") >= OVERLAP * F.col("rare")).select("a", "b", "overlap"), "overlaps")

    def with_both(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
        """pairs(a, b) with the arrays of both nodes, as column_a and column_b."""
        wanted = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "wanted")
        own = written(values.select("node", column).join(bounded(wanted, 16), "node", "left_semi"), "arrays")
        own = bounded(own, 64, column)
        for c in "ab":
            pairs = pairs.join(own.select(F.col("node").alias(c), F.col(column).alias(f"{column}_{c}")), c)
        return pairs

    may_link = estimated(percent)
    near = written(with_both(near, nodes, "sketch").where(may_link("sketch_a", "sketch_b")).select("a", "b", "overlap"), "candidates")
    compared = by_node.where("mostly").select("node").union(near.select("a")).union(near.select("b")).distinct()
    sets = full_sets(df, nodes.select("node", "rep", "set_id").join(compared, "node", "left_semi"), doc_id, text, width)
    sets = written(sets, "full-sets")
    if sets.groupBy("node").count().where("count > 1").head(1):  # rows that repeat: one set of each
        sets = written(sets.dropDuplicates(["node"]), "full-sets")
    of_common = sets.join(bounded(by_node.where("mostly").select("node"), 16), "node", "left_semi").repartition("node")
    lists = written(rare_lists(of_common, percent), "rare-lists")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of pairs(a, b), those whose full sets are similar enough."""
        both = with_both(written(pairs, "pairs"), sets, "s").withColumn("common", F.size(F.array_intersect("s_a", "s_b")))
        return both.where(F.col("common") * 100 >= percent * (F.size("s_a") + F.size("s_b") - F.col("common"))).select("a", "b")

    def joined(comps: DataFrame | None, links: DataFrame) -> DataFrame:
        """Components after new links; earlier components go in as stars."""
        old = [comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))] if comps is not None else []
        return written(components(reduce(DataFrame.union, old, links)), "components")

    def label(lists: DataFrame, comps: DataFrame | None, node: str = "node", comp: str = "comp") -> DataFrame:
        """lists with the component of column node, itself where it has no link."""
        if comps is None:
            return lists.withColumn(comp, F.col(node))
        return lists.join(comps.select(F.col("node").alias(node), F.col("comp").alias("found")), node, "left").withColumn(comp, F.coalesce("found", node)).drop("found")

    def unsettled(comps: DataFrame | None) -> DataFrame:
        """The rare lists whose members are in several components, with the members' components."""
        marked = label(lists, comps)
        open_ = marked.groupBy("g").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("g")
        return written(marked.join(open_, "g", "left_semi"), "unsettled")

    meet = "x.g = y.g AND x.comp != y.comp AND x.n <= y.reach AND y.n <= x.reach"

    def hub_pairs(left: DataFrame, count: int) -> DataFrame:
        """Pairs across components of each list's count hubs, those with the least of their own, with the other members.

        The cut is made within each task before the shuffle.
        """
        rank = F.row_number().over(Window.partitionBy("g").orderBy(F.col("own") / F.col("n"), "node"))
        hubs = left.withColumn("rank", rank).where(F.col("rank") <= count)
        pairs = left.alias("x").join(hubs.alias("y"), F.expr(meet))
        return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    # First each node's nearest partner and the first hubs, then the pairs that are still open.
    best = near.groupBy("b").agg(F.min_by("a", F.struct(-F.col("overlap"), F.col("a"))).alias("a")).select("a", "b")
    comps = joined(None, confirmed(best.union(hub_pairs(unsettled(None), HUBS[0])).distinct()))
    for count in HUBS[1:]:
        rest = label(label(near.select("a", "b"), comps, "a", "comp_a"), comps, "b", "comp_b").where("comp_a != comp_b").select("a", "b")
        comps = joined(comps, confirmed(rest.union(hub_pairs(unsettled(comps), count)).distinct()))
    left = unsettled(comps)
    once = F.expr(f"{meet} AND x.node < y.node AND NOT arrays_overlap(x.earlier, y.earlier)")
    comps = joined(comps, confirmed(left.alias("x").join(left.alias("y"), once).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()))

    # The smallest id of each component, and the node that has it, which stays.
    found = label(nodes.select("node", "set_id", "rep"), comps)
    least = found.groupBy("comp").agg(F.min(F.struct("rep", "node")).alias("least"), F.count("*").alias("members")).where("members > 1").select("comp", "least")
    placed = found.join(least, "comp", "left").select("set_id", F.coalesce("least.rep", "rep").alias("comp"), F.coalesce(F.col("least.node") == F.col("node"), F.lit(True)).alias("first"))
    out = made.join(placed, "set_id", "left")
    takes_part = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    component = F.when(takes_part, F.col("comp")).otherwise(F.col("doc_id"))
    kept = F.coalesce(~takes_part | ((F.col("doc_id") == F.col("comp")) & F.col("first")), F.lit(True))
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 80) -> DataFrame:
    """Per row of df: doc_id, n_shingles, component_id and kept.

    Two texts are linked where 100 * |A & B| >= percent * |A | B| over their sets of width-word
    shingles; component_id is the smallest id reachable over links, kept marks that row. percent
    is at least 60. A null or wordless text has an empty set and is linked with nothing. A null id
    takes no part: component_id is null and kept true. Repeated rows each give a row and are kept or not
    together. So do rows that repeat an id under different texts, each placed by its own text; of those
    in one component one text is kept. A very long text is hashed whole, and is one row of its set's
    values. An empty table gives an empty result. Extra columns do not matter.
    """
    return decided(df, doc_id, text, width, percent).drop("text_hash")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df that duplicates() keeps, with all their columns: one text of each group of near-duplicates.

    Rows go by id and text together, so that an id's other texts stay. Rows with a null id stay.
    """
    gone = decided(df, doc_id, text, width, percent).where("NOT kept").select(F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_hash"))
    gone = written(gone.distinct(), "gone")
    same = (F.col(doc_id) == F.col("__gone_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("__gone_hash"))
    return df.join(bounded(gone, 64), same, "left_anti")
