"""Filter interaction audit: a packed bitmap index of filters, labels and parts, and popcounts of every set of filters.

Each task packs its rows, sorted by part, into NumPy bitsets: one of the rows that fail each filter and one of each
label; a part is its own run of whole bytes. For each of the 32 sets of filters, the rows that are left are those
in no failing bitset (AND-NOT), and popcounts by part give how many they are, and how many of them carry a label.
Counts of tasks are summed; what any order of filters keeps and removes is differences of these counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import bound_batches, forget, written

WORD, UPPER = r"[^\x20\x09-\x0D]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NAMES = "ABCDE"
ALL = (1 << len(NAMES)) - 1
#: Salts of null ids, which no label meets.
SALTS = 64
#: The share of all rows from which on a text is joined apart from the others.
HOT = 0.001


def fails(text: Column) -> list[Column]:
    """Whether a text fails A to D: few words, few distinct ones, many capitals, marks."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: part, fails (bit i: fails filter i), good and toxic.

    Equal texts are found by their SHA-256. A null id has no smaller id, is none, and has no label; labels of one id
    that contradict each other count as good, or toxic, if any row says so.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = sum((c.cast("int") * (1 << i) for i, c in enumerate(fails(text))), F.lit(0))
    rows = written(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sign"), bits.alias("bits")), "audit-rows")
    twice = rows.groupBy("sign").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").drop("last")
    # a text of more than a share of all rows is looked up in a table of at most 1 / HOT rows; all others are joined by their digest
    often = F.col("n") > HOT * rows.count()
    twice = written(twice.withColumn("often", often).drop("n"), "audit-twice")
    known = rows.join(F.broadcast(twice.where("often").drop("often")), "sign", "left")
    rare = known.where("first IS NULL").drop("first").join(twice.where("NOT often").drop("often"), "sign", "left")
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.col("row"), F.lit(SALTS))).otherwise(0)
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    found = known.where("first IS NOT NULL").unionByName(rare).withColumn("salt", salt.cast("long")).join(told, ["doc_id", "salt"], "left")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << NAMES.index("E"))
    got = found.select("part", (F.col("bits") + again).cast("byte").alias("fails"), *[F.coalesce(c, F.lit(0)).cast("byte").alias(c) for c in ("good", "toxic")])
    got.read_from = rows, twice
    return got


class Counts:
    """Counts of one task's rows: per part, (sets of filters) x (left, good left, toxic left)."""

    def __init__(self) -> None:
        self.of: dict[str, np.ndarray] = {}

    def add(self, parts: np.ndarray, names: list[str], failing: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> None:
        """Rows by the code of their part: bits are packed with every part from a byte of its own on."""
        order = np.argsort(parts, kind="stable")
        sizes = np.bincount(parts, minlength=len(names))
        widths = (sizes + 7) // 8
        starts = np.concatenate(([0], np.cumsum(widths)[:-1]))
        place = 8 * starts[parts[order]] + np.arange(len(parts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)

        def packed(flag: np.ndarray) -> np.ndarray:
            spread = np.zeros(8 * int(widths.sum()), bool)
            spread[place] = flag[order]
            return np.packbits(spread)

        there = packed(np.ones(len(parts), bool))
        failed = [packed((failing >> i) & 1 == 1) for i in range(len(NAMES))]
        marks = [packed(good == 1), packed(toxic == 1)]
        got = np.zeros((len(names), ALL + 1, 3), np.int64)
        left = {0: there}
        for chosen in range(ALL + 1):
            if chosen:  # the set without its last filter, and not those that fail it
                last = chosen.bit_length() - 1
                left[chosen] = left[chosen & ~(1 << last)] & ~failed[last]
            rows = left[chosen]
            for k, bits in enumerate((rows, rows & marks[0], rows & marks[1])):
                got[:, chosen, k] = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), starts)
        for name, counts in zip(names, got, strict=True):
            self.of[name] = self.of[name] + counts if name in self.of else counts


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each part of a task and each set of filters."""
    counts = Counts()
    for b in batches:
        if b.num_rows:
            parts = b.column("part").dictionary_encode()
            counts.add(parts.indices.to_numpy(), parts.dictionary.to_pylist(), *[b.column(c).to_numpy() for c in ("fails", "good", "toxic")])
    for name, of in counts.of.items():
        columns = {"part": [name] * len(of), "chosen": np.arange(len(of), dtype=np.int32)} | {c: of[:, k] for k, c in enumerate(("kept", "good", "toxic"))}
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def index(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and set of filters (chosen: bit i for filter i): rows that fail none of the set, and how many are good or toxic."""
    bound_batches(docs.sparkSession)
    rows = flagged(docs, labels)
    parts = rows.mapInArrow(counted, "part string, chosen int, kept long, good long, toxic long")
    got = written(parts.groupBy("part", "chosen").agg(*[F.sum(c).alias(c) for c in ("kept", "good", "toxic")]), "audit-index")
    forget(*rows.read_from)
    return got


def steps() -> list[tuple[str, int, int, int]]:
    """Every order with its steps: order, step (from 1), the set before it, its filter's number."""
    out = []
    for order in permutations(range(len(NAMES))):
        before = 0
        for step, i in enumerate(order, 1):
            out.append(("".join(NAMES[j] for j in order), step, before, i))
            before |= 1 << i
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part of docs (its lang; null: the empty string), order of the five filters, and step, what its filter does.

    kept (after the step), removed, redundant (failing it, but removed before), unique_fails (failing no other),
    good_lost and toxic_lost (of those removed), and shapley: its removals over all orders. Null and empty texts are
    alike, and fail A (and E, where a smaller id has one). Repeated rows count each; those of one id do not fail E by each other.
    Very long texts are counted whole. Other columns are not read. No row of labels gives zeros, and an empty table no row.
    """
    counts = index(docs, labels)
    per = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("chosen", F.struct("kept", "good", "toxic")))).alias("left"))  # 32 entries a part
    literal = F.array(*[F.struct(F.lit(order).alias("filter_order"), F.lit(step).alias("step"), F.lit(before).alias("before"), F.lit(1 << i).alias("own")) for order, step, before, i in steps()])
    got = per.select("part", "left", F.explode(literal).alias("s")).select("part", "left", "s.*")
    of = lambda chosen, what: F.element_at("left", chosen)[what]
    after = F.col("before").bitwiseOR(F.col("own"))
    lost = lambda what: of(F.col("before"), what) - of(after, what)
    n, others = len(NAMES), F.lit(ALL).bitwiseXOR(F.col("own"))
    orders = F.lit(0).cast("long")
    for chosen in range(ALL + 1):  # a set before the filter stands so in |set|! * (n - 1 - |set|)! orders
        if (size := chosen.bit_count()) < n:
            set_, times = F.lit(chosen), factorial(size) * factorial(n - 1 - size)
            orders += F.when(set_.bitwiseAND(F.col("own")) == 0, times * (of(set_, "kept") - of(set_.bitwiseOR(F.col("own")), "kept"))).otherwise(0)
    return got.select(
        "part", "filter_order", "step", of(after, "kept").alias("kept"), lost("kept").alias("removed"),
        (of(F.lit(0), "kept") - of(F.col("own"), "kept") - lost("kept")).alias("redundant"),
        (of(others, "kept") - of(F.lit(ALL), "kept")).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), orders.alias("shapley"),
    )
