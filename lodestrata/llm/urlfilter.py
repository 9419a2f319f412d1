"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A rule lists a canonical URL, host and path prefix. A URL is looked up under every suffix of its
host (at a dot) with every path prefix as long as some rule's path. The filter passes the keys
that may be listed, which are then joined with the list itself, so false positives change nothing.
The filter's bits are bounded by MAX_BLOCKS; a fuller filter only passes more keys to the join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import bound_batches, written

#: A block is one 512-bit cache line of eight 64-bit words; each key sets a bit in every word.
WORDS, MAX_BLOCKS = 8, 1 << 17
#: Up to so many bytes of rules, as counted, are broadcast to the keys; more are joined by a shuffle.
BROADCAST_BYTES = 4 << 20
#: Keys a block is planned for.
KEYS_A_BLOCK = 32
#: Odd multipliers, one per word, that derive bit numbers from a key's hash.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty where it is null or has no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def blocks_and_masks(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number of each 64-bit hash and the bit it has in each word."""
    h = hashes.astype("i8").view("u8")
    bits = ((h[:, None] & np.uint64(0xFFFFFFFF)) * SALTS & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype("i8"), np.uint64(1) << bits


def bloom(keys: DataFrame, count: int) -> np.ndarray:
    """Filter of the 64-bit hashes in column h, built by partition; at most one row a block reaches the driver."""
    blocks = int(min(MAX_BLOCKS, max(1, -(-count // KEYS_A_BLOCK))))

    def build(frames):
        out = np.zeros((blocks, WORDS), np.uint64)
        for f in frames:
            at, mask = blocks_and_masks(f["h"].to_numpy("i8"), blocks)
            np.bitwise_or.at(out, at, mask)
        full = np.flatnonzero(out.any(1))
        yield pd.DataFrame({"block": full, **{f"w{i}": out[full, i].view("i8") for i in range(WORDS)}})

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(WORDS))
    merged = keys.select("h").mapInPandas(build, schema).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    out = np.zeros((blocks, WORDS), np.uint64)
    for r in merged.toLocalIterator():
        out[r[0]] = np.array(r[1:], "i8").view("u8")
    return out


def judge(df: DataFrame, rules: DataFrame, row_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Per row of df: row_id, host, path, rule (host and path of the winning rule) and verdict.

    rules: host, path, verdict. A rule fits its host and all subdomains where the URL's path starts
    with the rule's path; the longest rule wins, by host and path together, then the longest host,
    then verdict order (a rule listed twice with two verdicts). Without a fitting rule: null and default.

    Nulls: a null URL has an empty host and path and fits only a rule with both empty; a null in a
    rule counts as empty. A null row_id is kept. Repeated rows each get their row. Every row yields
    keys for its host's suffixes that are as deep as a rule's host, times the distinct rule path lengths; keys
    are joined to the rules by hash, rows with a hit are put together again by a generated row number, not by
    the url. Very long hosts and paths give no more keys than short ones; an empty table gives an empty result.
    """
    spark = df.sparkSession
    bound_batches(spark)
    host, path = parts(F.col(url))
    pages = df.select(F.col(row_id).alias("page"), host.alias("host"), path.alias("path"))
    e = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    listed = rules.select(e("host").alias("r_host"), e("path").alias("r_path"), F.col("verdict").alias("r_verdict")).groupBy("r_host", "r_path").agg(F.min("r_verdict").alias("r_verdict"))
    listed = written(listed.withColumn("h", F.xxhash64("r_host", "r_path")), "rules")
    lengths = sorted(r[0] for r in listed.select(F.length("r_path")).distinct().collect())
    depths = sorted(r[0] for r in listed.select(F.size(F.split("r_host", r"\."))).distinct().collect())
    count, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("r_host") + F.octet_length("r_path") + 64).cast("long"), F.lit(0))).first()
    bits = bloom(listed, count)
    sent = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def listed_maybe(hashes: pd.Series) -> pd.Series:
        words = sent.value
        at, mask = blocks_and_masks(hashes.to_numpy("i8"), len(words))
        return pd.Series(((words[at] & mask) == mask).all(1))

    labels = F.split("host", r"\.")
    # only suffixes of as many labels as some rule's host has, so that keys grow with a host's length, not its square
    suffixes = F.array(*[F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.greatest(F.size(labels) - n, F.lit(0)) + 1, n), ".")) for n in depths], F.lit(""))
    suffixes = F.array_distinct(F.filter(suffixes, lambda x: x.isNotNull()))
    prefixes = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: F.when(F.length("path") >= n, F.substring(F.col("path"), F.lit(1), n))), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("k_host"), p.alias("k_path")))))
    pages = written(pages.withColumn("nr", F.monotonically_increasing_id()), "pages")
    keys = pages.select("nr", F.explode(pairs).alias("key")).select("nr", "key.k_host", "key.k_path").withColumn("h", F.xxhash64("k_host", "k_path"))
    few = size <= BROADCAST_BYTES  # a rule that most pages fit is no hot key then
    hits = keys.where(listed_maybe("h")).join(F.broadcast(listed) if few else listed, (F.col("k_host") == F.col("r_host")) & (F.col("k_path") == F.col("r_path")))
    order = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("m"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = hits.groupBy("nr").agg(F.max(order).alias("best"))
    out = pages.join(best, "nr", "left")
    return out.select(F.col("page").alias(row_id), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
