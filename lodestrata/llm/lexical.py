"""Ranked lexical search: documents reordered by recursive graph bisection, shards of an index visited by their bounds.

Recursive graph bisection halves the documents again and again, so that those that share terms come to lie
together: pairs are swapped between halves while that lowers the logarithmic gaps of the terms' lists. The tree of
halvings is fitted on a bounded sample; every document of the table then goes down it by the same cost, to a leaf. Leaves are
cut into shards of some hundred documents, and the index holds a list of places and values for each shard and term, with
the largest value. A query's shards are visited by the sum of those, its bound, until no bound reaches the score of the last
document found: no document is lost by that. Places are mapped back to doc_id, which settles ties.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import bound_batches, forget, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
#: The same on bytes of UTF-8: what parts terms becomes a blank, and only A-Z is lowered.
PARTED = bytes(b | 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Documents the tree is fitted on at most, and buckets of their terms each at most.
SAMPLE, SAMPLE_TERMS = 4096, 2048
#: Buckets of terms in the tree, its depth, and rounds of swaps a halving at most.
BUCKETS, DEPTH, ROUNDS = 1 << 14, 6, 12
#: Documents of a shard, about.
SHARD = 512
#: Shards that a query visits in the first round, and how many times as many after each.
FIRST, GROWTH = 8, 8
#: Queries that are held against one shard in one task.
BLOCK = 512


def split(text: bytes) -> list[bytes]:
    """Terms of a text, in order, with repeats."""
    return text.translate(PARTED).split()


def buckets(terms) -> list[int]:
    return [zlib.crc32(t) & (BUCKETS - 1) for t in terms]


def gaps(held: np.ndarray, n: int) -> np.ndarray:
    """Cost in bits of lists with so many of n documents."""
    return held * np.log2(max(n, 1) / (held + 1))


def halves(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """True for documents of the right half; flat: their buckets one after another."""
    n = len(sizes)
    right, owner = np.arange(n) % 2 == 1, np.repeat(np.arange(n), sizes)
    both = np.bincount(flat, minlength=BUCKETS).astype(float)
    for _ in range(ROUNDS):
        r = np.bincount(flat, right[owner], BUCKETS)
        l, nr = both - r, int(right.sum())  # noqa: E741
        stay = gaps(l, n - nr) + gaps(r, nr)
        leaves_left = stay - gaps(np.maximum(l - 1, 0), n - nr) - gaps(r + 1, nr)
        leaves_right = stay - gaps(l + 1, n - nr) - gaps(np.maximum(r - 1, 0), nr)
        gain = np.bincount(owner, np.where(right[owner], leaves_right[flat], leaves_left[flat]), n)
        a, b = (np.flatnonzero(side)[np.argsort(-gain[side], kind="stable")] for side in (~right, right))
        k = min(len(a), len(b))
        swapped = int((gain[a[:k]] + gain[b[:k]] > 0).sum())
        if not swapped:
            break
        right[a[:swapped]], right[b[:swapped]] = True, False
    return right


class Tree:
    """Halvings of a sample, by which any document finds its leaf: per inner node what a bucket costs more on the left than on the right."""

    def __init__(self, sample: list[list[int]]) -> None:
        self.costs = np.zeros(((1 << DEPTH) - 1, BUCKETS), np.float32)
        todo = [(0, [np.asarray(s, np.int64) for s in sample if len(s)])]
        while todo:
            node, docs = todo.pop()
            if node >= len(self.costs) or len(docs) < 2:
                continue
            flat, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
            right = halves(flat, sizes)
            owner, nr = np.repeat(right, sizes), int(right.sum())
            l, r = np.bincount(flat[~owner], minlength=BUCKETS).astype(float), np.bincount(flat[owner], minlength=BUCKETS).astype(float)  # noqa: E741
            more = lambda held, n: gaps(held + 1, n) - gaps(held, n)
            self.costs[node] = more(l, len(docs) - nr) - more(r, nr)
            todo += [(2 * node + 1 + side, [d for d, x in zip(docs, right, strict=True) if x == side]) for side in (0, 1)]

    def leaves(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The leaf of each document, from the left."""
        owner, node = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(sizes), np.int64)
        for _ in range(DEPTH):
            cost = np.bincount(owner, self.costs[node[owner], flat], len(sizes))
            node = 2 * node + 1 + (cost >= 0)
        return node - len(self.costs)


def fit(docs: DataFrame, count: int) -> Tree:
    """A tree from SAMPLE documents of the least hashes: of each at most SAMPLE_TERMS buckets, those of the least hashes."""
    own = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30))
    chosen = docs.withColumn("own", own).where(F.col("own") < int((1 << 30) * min(1.0, 1.2 * SAMPLE / max(count, 1))))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(np.array(buckets(set(split(t.as_py() or b""))), np.int64)) for t in b.column("text")]
            found = [np.sort(x[np.argsort(x * 2654435761 % (1 << 32), kind="stable")[:SAMPLE_TERMS]]) for x in found]
            yield pa.RecordBatch.from_pydict({"own": b.column("own"), "buckets": pa.array(found, pa.list_(pa.int32()))})

    rows = chosen.select("own", F.col("text").cast("binary").alias("text")).mapInArrow(sketched, "own long, buckets array<int>")
    return Tree([r.buckets for r in rows.orderBy("own", "buckets").limit(SAMPLE).collect()])


class Index:
    """table: per shard and term its largest value, places and values; per shard a row without a term, with ids by place. N documents hold L terms."""

    def __init__(self, table: DataFrame, shards: int, n: int, length: int) -> None:
        self.table, self.shards, self.n, self.length = table, shards, n, length


def build(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Index of all rows of df, of whole texts.

    A null or empty text has no term and is not in the index; rows that repeat are documents each. A null id is
    kept, and comes last among ties. Very long texts are read whole. Other columns are not read, and an empty table gives an empty index.
    """
    bound_batches(df.sparkSession)
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tree = fit(docs, docs.count())

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() * 104_729  # so that tasks do not begin alike
        for b in batches:
            n, sizes, terms, times = [], [], [], []
            for t in b.column("text"):
                words = split(t.as_py() or b"")
                found = Counter(words)
                n.append(len(words))
                sizes.append(len(found))
                terms.extend(found)
                times.extend(found.values())
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            leaf = tree.leaves(np.array(buckets(terms), np.int64), np.array(sizes, np.int64))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((terms, pa.binary()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.arange(place, place + len(n))), pa.array(leaf, pa.int32()), pa.array(n, pa.int64()), *lists], ["doc_id", "place", "leaf", "n", "terms", "times"])
            place += len(n)

    rows = docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(parsed, "doc_id long, place long, leaf int, n long, terms array<binary>, times array<int>")
    forward = written(rows.where("n > 0"), "lexical-forward")
    leaves = {r.leaf: (r.docs, r.terms) for r in forward.groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).collect()}  # 64 rows
    n, length = (sum(v[i] for v in leaves.values()) for i in (0, 1))
    parts = [-(-leaves.get(i, (0, 0))[0] // SHARD) for i in range(1 << DEPTH)]
    at = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("leaf") + 1)
    first = [sum(parts[:i]) for i in range(len(parts))]
    shard = (at(first) + F.col("place") % F.greatest(at(parts), F.lit(1))).alias("shard")

    def inverted(docs: pa.Table) -> pa.Table:
        """One shard's lists: documents take their places by id."""
        docs = docs.sort_by("doc_id").combine_chunks()
        m = np.array([50 + 50 * x * n // length for x in docs["n"].to_pylist()], np.int64)
        terms, times = (docs[c].combine_chunks() for c in ("terms", "times"))
        place = np.repeat(np.arange(docs.num_rows), terms.value_lengths().to_numpy())
        tf = times.flatten().to_numpy().astype(np.int64)
        values = 1_000_000_000 * tf // (1000 * tf + 20 * m[place])
        known = terms.flatten().dictionary_encode()
        codes = known.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(np.bincount(codes, minlength=len(known.dictionary)))
        starts, k = np.concatenate(([0], ends[:-1])), len(known.dictionary)
        offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order], pa.int32())) for x in (place, values)]
        ids = pa.concat_arrays([pa.nulls(k, pa.list_(pa.int64())), pa.array([docs["doc_id"].to_pylist()], pa.list_(pa.int64()))])
        none = pa.nulls(1, pa.list_(pa.int32()))
        columns = [pa.array(np.full(k + 1, docs["shard"][0].as_py()), pa.int64()), pa.concat_arrays([known.dictionary, pa.nulls(1, pa.binary())]), pa.array([*np.maximum.reduceat(values[order], starts).tolist(), None], pa.int64()), *[pa.concat_arrays([x, none]) for x in lists], ids]
        return pa.Table.from_arrays(columns, ["shard", "term", "most", "places", "values", "ids"])

    lists = forward.select(shard, "doc_id", "n", "terms", "times").groupBy("shard").applyInArrow(inverted, "shard long, term binary, most long, places array<int>, values array<int>, ids array<long>")
    got = Index(written(lists, "lexical-index"), sum(parts), n, length)
    forget(forward)
    return got


def scored(k: int):
    """The k best documents of one shard for each query that visits it, of those that reach what the query has already."""

    def run(lists: pa.Table, asked: pa.Table) -> pa.Table:
        lists = lists.combine_chunks()
        ids = next(x.as_py() for x in lists["ids"] if x.is_valid)
        places, values = (lists[c].combine_chunks() for c in ("places", "values"))
        offsets = places.offsets.to_numpy()
        places, values = places.values.to_numpy(), values.values.to_numpy().astype(np.int64)
        at = {t: i for i, t in enumerate(lists["term"].to_pylist()) if t is not None}
        out: tuple[list, list, list] = ([], [], [])
        for item, least, terms, weights in zip(*(asked[c].to_pylist() for c in ("item_id", "least", "terms", "weights")), strict=True):
            score = np.zeros(len(ids), np.int64)
            for term, w in zip(terms, weights, strict=True):
                if (i := at.get(term)) is not None:
                    here = slice(offsets[i], offsets[i + 1])
                    score[places[here]] += w * values[here]
            found = np.flatnonzero(score >= max(least or 1, 1))
            found = found[np.argsort(-score[found], kind="stable")[:k]]  # places are by id
            out[0].extend([item] * len(found))
            out[1].extend(ids[i] for i in found)
            out[2].extend(score[found].tolist())
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in out], ["item_id", "doc_id", "score"])

    return run


def search(index: Index, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Per item its k best documents: item_id, rank, doc_id, score; equal scores by doc_id.

    Rows of one item_id are one item of all their terms; items without an id, and those whose text is null, empty or without a
    known term, have no result. A very long item is searched by all its terms. Other columns are not read, and an empty table gives none.
    """
    terms = F.regexp_extract_all(F.translate(F.col(text).cast("string"), UPPER, LOWER), F.lit(TERM))
    rows = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.explode(F.array_distinct(terms)).alias("term"))
    asked = written(rows.select("item_id", F.col("term").cast("binary").alias("term")).distinct(), "lexical-asked")
    here = index.table.join(asked.select("term").distinct(), "term", "left_semi")
    lists = written(here.unionByName(index.table.where("term IS NULL")), "lexical-lists")
    held = lists.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.n + 2) / (2 * F.col("df") + 1)))
    weighted = written(asked.join(held, "term").select("item_id", "term", weight.alias("w")).where("w > 0"), "lexical-weights")
    each = F.sort_array(F.collect_list(F.struct("term", "w")))  # an item's own terms
    queries = weighted.groupBy("item_id").agg(each.alias("e")).select("item_id", F.col("e.term").alias("terms"), F.col("e.w").alias("weights"))
    bounds = lists.where("term IS NOT NULL").select("shard", "term", "most").join(weighted, "term").groupBy("item_id", "shard").agg(F.sum(F.col("w") * F.col("most")).alias("bound"))
    turn = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("bound"), "shard"))
    visits = written(bounds.withColumn("turn", turn), "lexical-visits")
    blocks = 1 + asked.agg(F.approx_count_distinct("item_id")).first()[0] // BLOCK
    best = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    top = written(items.sparkSession.createDataFrame([], "item_id long, doc_id long, score long, rank int"), "lexical-top")
    seen, until = 0, FIRST
    while seen < index.shards:
        least = top.where(F.col("rank") == k).select("item_id", F.col("score").alias("least"))
        live = visits.where(F.col("turn") > seen).join(least, "item_id", "left").where("least IS NULL OR bound >= least")
        todo = written(live.where(F.col("turn") <= until).withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "lexical-todo")
        if not todo.isEmpty():
            wanted = todo.join(queries, "item_id").select(F.col("shard").alias("of_shard"), F.col("block").alias("of_block"), "item_id", "least", "terms", "weights")
            open_ = todo.select("shard", "block").distinct().join(lists, "shard").select("shard", "block", "term", "places", "values", "ids")
            found = open_.groupBy("shard", "block").cogroup(wanted.groupBy("of_shard", "of_block")).applyInArrow(scored(k), "item_id long, doc_id long, score long")
            merged = top.drop("rank").unionByName(found).withColumn("rank", best).where(F.col("rank") <= k)
            top, old = written(merged, "lexical-top"), top
            forget(old)
        elif live.isEmpty():
            break
        forget(todo)
        seen, until = until, until * GROWTH
    forget(asked, lists, weighted, visits)
    return top.select("item_id", "rank", "doc_id", "score")
