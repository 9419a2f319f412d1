"""The chain from source files to eligible programs: exact digests of three kinds, near-duplicates, and clusters of problems that share programs."""

from __future__ import annotations

import io
import tokenize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import normalize_source
from lodestrata.operators.corpus import fuzzy_pairs, shared_digest_edges
from lodestrata.operators.graphs import connected_components, cut
from lodestrata.operators.trees import program_signatures

#: The exact kinds, from the bytes to the structure.
DIGESTS = ("d0", "d1", "d2")


def decoded(content: Column) -> Column:
    """text and encoding of Python sources by their mark or first lines, UTF-8 without; both null where that fails."""

    @F.pandas_udf("text string, encoding string")
    def decode(contents: pd.Series) -> pd.DataFrame:
        out = []
        for c in contents:
            try:
                encoding, _ = tokenize.detect_encoding(io.BytesIO(c or b"").readline)
                out.append((bytes(c or b"").decode(encoding), encoding))
            except (SyntaxError, UnicodeDecodeError, LookupError):
                out.append((None, None))
        return pd.DataFrame(out, columns=["text", "encoding"])

    return decode(content)


def inventory(files: DataFrame, width: int = 5) -> DataFrame:
    """Source files (problem_id, submission_id, source_relpath, content) with encoding, decode_ok, tokenize_ok, parse_ok, the three digests (of bytes, of the normalised text, of the structure), and shingles of width tokens."""
    text = files.withColumn("d", decoded(F.col("content")))
    whole = text.withColumn("source", normalize_source(F.col("d.text"))).withColumn("s", program_signatures(F.col("source")))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("s.tokens") - width + 1, F.lit(1))), lambda i: F.array_join(F.slice("s.tokens", i, width), "\0"))
    shingles = F.when(F.size("s.tokens") >= width, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))
    return whole.select(
        "problem_id", "submission_id", "source_relpath", F.col("d.encoding").alias("encoding"), F.col("d.text").isNotNull().alias("decode_ok"), F.col("s.tokens").isNotNull().alias("tokenize_ok"), F.col("s.structure").isNotNull().alias("parse_ok"),
        F.sha2("content", 256).alias("d0"), F.sha2("source", 256).alias("d1"), F.col("s.structure").alias("d2"), F.coalesce(shingles, F.array().cast("array<string>")).alias("shingles"),
    )


def exact_components(rows: DataFrame, member: str, digests: tuple[str, ...] = DIGESTS) -> DataFrame:
    """rows with component: the smallest member that a chain of equal digests, of whichever kind, leads to.

    Every member is tied to the smallest of each of its digests alone, so that a digest of n rows makes n links. Null digests tie nothing.
    """
    marks = cut(rows.select(F.col(member).alias("m"), F.explode(F.array(*[F.concat(F.lit(f"{d}:"), F.col(d)) for d in digests])).alias("mark")).where("mark IS NOT NULL"))
    first = marks.groupBy("mark").agg(F.min("m").alias("first"), F.count("*").alias("n")).where("n > 1")
    edges = marks.join(first, "mark").where("m != first").select(F.col("m").alias("left"), F.col("first").alias("right")).distinct()
    found = connected_components(rows.select(F.col(member).alias("node")), edges)
    return rows.join(found.select(F.col("node").alias(member), "component"), member)


def exact_retained(rows: DataFrame, member: str, parses: str, digests: tuple[str, ...] = DIGESTS) -> DataFrame:
    """exact_components() with retained: rows that parse and are the first of their component."""
    found = exact_components(rows, member, digests)
    return found.withColumn("retained", F.coalesce((F.col(member) == F.col("component")) & F.col(parses), F.lit(False)))


def near_retained(rows: DataFrame, member: str, items: str, threshold: float = 0.9, bands: int = 32, band_rows: int = 8) -> DataFrame:
    """rows (of exact_retained()) with near_component and near_retained: of retained rows that similar shingles tie together the first stays.

    A row without shingles is tied to none. Rows that were not retained have no component here.
    """
    left = cut(rows.where("retained").select(F.col(member).alias("id"), F.col(items).alias("items")))
    sets = left.where("size(items) > 0")
    groups = sets.select("id", F.array_sort("items").alias("items")).groupBy("items").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    copies = sets.select("id", F.array_sort("items").alias("items")).join(groups.where("n > 1"), "items").where("id != first").select(F.col("first").alias("left"), F.col("id").alias("right"))
    pairs = fuzzy_pairs(sets, threshold, bands, band_rows).select("left", "right").union(copies)
    found = connected_components(left.select(F.col("id").alias("node")), pairs).select(F.col("node").alias(member), F.col("component").alias("near_component"))
    return rows.join(found, member, "left").withColumn("near_retained", F.coalesce(F.col(member) == F.col("near_component"), F.lit(False)))


def clusters(rows: DataFrame, group: str, digest: str, retained: str, least_shared: int = 5, least_share: float = 0.05, least_programs: int = 64) -> DataFrame:
    """cluster_id, groups, group_count, retained and eligible: groups tied by digests that they share, what is retained in them together, and whether that is enough."""
    edges = shared_digest_edges(rows, digest, group, least_shared, least_share)
    counts = rows.groupBy(F.col(group).alias("node")).agg(F.sum(F.col(retained).cast("long")).alias("retained"))
    found = connected_components(counts.select("node"), edges.select("left", "right")).join(counts, "node")
    whole = found.groupBy("component").agg(F.sort_array(F.collect_list(F.col("node").cast("string"))).alias("groups"), F.sum("retained").alias("retained"))  # groups are few beside their rows
    return whole.select(F.concat(F.lit("problem-"), F.substring(F.sha2(F.array_join("groups", "|"), 256), 1, 20)).alias("cluster_id"), "groups", F.size("groups").alias("group_count"), "retained", (F.col("retained") >= least_programs).alias("eligible"))


def group_summary(rows: DataFrame, group: str, parses: str) -> DataFrame:
    """Per group: rows, those that parse and their share, exact duplicates removed, and retained."""
    count = lambda c: F.sum(c.cast("long"))
    return rows.groupBy(group).agg(F.count("*").alias("files"), count(F.col(parses)).alias("parse_ok"), F.avg(F.col(parses).cast("double")).alias("parse_rate"), count(F.col(parses) & ~F.col("retained")).alias("exact_removed"), count(F.col("retained")).alias("retained"))
