"""Admission of new documents against all before them: near-duplicates by MinHash bands in keyed state.

A document asks each of its bands for earlier sets, is compared with them exactly, and then is entered. State is kept by band, in
the state store, and forgets a set once it is older than a stated time. Sets that are equal are entered once, so that
copies do not pile up in a band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestrata.operators.corpus import minhash_signatures

#: The state store that keyed state of several values needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOUND = "id long, earlier long, similarity double"


def banded(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """band, id and hashes (sorted, distinct) of sets(id, items), a row a band; empty sets have no band, and are admitted."""
    hashes = F.array_sort(F.array_distinct(F.transform("items", lambda s: F.xxhash64(s))))
    signed = minhash_signatures(sets.select("id", "items"), bands * rows, carry=hashes)
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("signature", b * rows + 1, rows)))
    return signed.select("id", "hashes", F.explode(F.array_distinct(keys)).alias("band"))


def similarity(left: np.ndarray, right: np.ndarray) -> float:
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return shared / (len(left) + len(right) - shared)


class Band(StatefulProcessor):
    """What one band has seen: by digest of the set, the smallest id that came with it and its hashes."""

    def __init__(self, threshold: float, forget_ms: int | None) -> None:
        self.threshold, self.forget_ms = threshold, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "digest long", "id long, hashes array<long>", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: (v[0], np.asarray(v[1], "i8")) for k, v in self.seen.iterator()}
        found = []
        for frame in rows:
            for r in frame.sort_values("id").itertuples():
                hashes = np.asarray(r.hashes, "i8")
                digest = int(pd.util.hash_array(hashes).sum().astype("u8").view("i8"))
                at_least, at_most = self.threshold * len(hashes), len(hashes) / self.threshold
                for other, theirs in known.values():
                    if other != r.id and at_least - 1e-9 <= len(theirs) <= at_most + 1e-9 and (s := similarity(hashes, theirs)) + 1e-15 >= self.threshold:
                        found.append((r.id, other, s))
                if digest not in known:
                    known[digest] = (r.id, hashes)
                    self.seen.updateValue((digest,), (r.id, hashes.tolist()))
        yield pd.DataFrame(found, columns=["id", "earlier", "similarity"])

    def close(self) -> None:
        pass


def matches(sets: DataFrame, threshold: float = 0.8, bands: int = 32, rows: int = 4, forget_ms: int | None = None) -> DataFrame:
    """id, earlier and similarity of a stream of sets(id, items): each document with those before it that share a band and are as similar.

    Documents of one batch come in order of their ids; a pair may be found by several bands, and once each. The session needs STORE as
    its state store. forget_ms: how long a set is kept, by the clock; with none, for good.
    """
    grouped = banded(sets, bands, rows).groupBy("band")
    return grouped.transformWithStateInPandas(Band(threshold, forget_ms), FOUND, "append", "ProcessingTime" if forget_ms else "None")


def admitted(sets: DataFrame, found: DataFrame) -> DataFrame:
    """The documents of sets(id, ...) that no match of matches(), as a table, speaks against."""
    return sets.join(found.select("id").distinct(), "id", "left_anti")


def admitted_in_order(sets: DataFrame, threshold: float = 0.8, bands: int = 32, rows: int = 4) -> DataFrame:
    """The same of a finished table whose order is that of its ids, without state: ids that are no later half of a pair."""
    from lodestrata.operators.corpus import fuzzy_pairs

    whole = sets.where("size(items) > 0").select("id", F.array_sort(F.array_distinct("items")).alias("items"))
    copies = whole.groupBy("items").agg(F.min("id").alias("first"))
    first = copies.select(F.col("first").alias("id"), "items")
    later = fuzzy_pairs(first, threshold, bands, rows).select(F.col("right").alias("id")).distinct()
    kept = first.join(later, "id", "left_anti").select("id").union(sets.where("size(items) = 0").select("id"))
    return sets.join(kept, "id", "left_semi")
