"""Mixing sources to target weights: words a source, repetition rates, whole copies and one drawn copy.

A source's size is the words of its documents. Targets share the sizes of all sources by weight, but stop at a
stated multiple of the source's own size; what is over goes to the others by weight until none is above its
stop. A source's rate is its target by its size: each document is emitted floor(rate) times, and once more
where its own number, a digest of seed and id, is below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import table_columns, written

#: Weights of sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Times its own words that a source gives at most.
STOP = 3
#: What a word is made of, and what parts words.
WORD, BLANKS = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
SEED = "lodestrata mix"
#: Sources that one task ranks, and that a broadcast holds, at most; each with names of so many bytes together.
RANK_ROWS, BROADCAST_BYTES = 50_000, 32 << 20


def words(text: Column) -> Column:
    """Words of a text: each becomes one letter, and letters are counted; a null text has none."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "a"), BLANKS, "")), F.lit(0)).cast("long")


def drawn(doc_id: Column, text: Column, seed: str) -> Column:
    """A document's own number from 0 to under 1: 52 bits of a digest of seed and id, or of seed and text where the id is null."""
    own = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))).cast("binary"))
    return F.conv(F.substring(own, 1, 13), 16, 10).cast("double") / float(1 << 52)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], parts: int) -> DataFrame:
    """df with running sums (of whole numbers) in an order without ties, this row left out; in parts by range and by their offsets.

    df is written before, so that the parts of each run are the same; no task holds more than a part.
    """
    ranged = written(df.withColumns({f"__{k}": v.cast("decimal(38,0)") for k, v in sums.items()}).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "mix-ranges")
    before = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    inside = before(Window.partitionBy("__part").orderBy(*order))
    total = ranged.groupBy("__part").agg(*[F.sum(f"__{k}").alias(f"__{k}") for k in sums])
    starts = total.select("__part", *[F.sum(f"__{k}").over(before(Window.orderBy("__part"))).alias(f"__start_{k}") for k in sums])  # a row a part
    got = ranged.withColumns({f"__in_{k}": F.sum(f"__{k}").over(inside) for k in sums}).join(F.broadcast(starts), "__part")
    none = F.lit(0).cast("decimal(38,0)")
    return got.select(*df.columns, *[(F.coalesce(f"__in_{k}", none) + F.coalesce(f"__start_{k}", none)).cast("decimal(38,0)").alias(k) for k in sums])


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, stop: int = STOP) -> DataFrame:
    """Per source of sized (source, size): source_size, weight, target and rate; a null source is one, and comes last.

    The sources that end at their stop are those that come first by stop / weight while an even share of what is left
    would be above it; that is settled in whole numbers. A source without words has target and rate 0, and no
    source at all gives no row.
    """
    per = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    count, total = per.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    parts = 1 + count // RANK_ROWS
    ranked = running(per, [F.col("source").asc_nulls_last()], {"__before": F.lit(1)}, parts)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__before") % len(weights) + 1).cast("int"))
    stops = ranked.withColumn("weight", weight.cast("long")).withColumn("__stop", F.col("source_size") * stop).drop("__before")
    order = [F.col("__stop") / F.col("weight"), F.col("source").asc_nulls_last()]
    summed = running(stops, order, {"__stops": F.col("__stop"), "__weights": F.col("weight")}, parts)
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    all_weights = F.lit(stops.agg(F.sum("weight")).first()[0] or 0).cast("decimal(19,0)")
    left = (F.lit(total).cast("decimal(19,0)") - whole("__stops")).cast("decimal(19,0)")
    above = left * whole("weight") > whole("__stop") * (all_weights - whole("__weights")).cast("decimal(19,0)")
    flagged = written(summed.withColumn("__above", above), "mix-stops")
    given, weighing = flagged.agg(F.sum(F.when(F.col("__above"), F.col("__stop"))), F.sum(F.when(~F.col("__above"), F.col("weight")))).first()
    share = F.lit(float(total - (given or 0))) * F.col("weight") / F.lit(float(weighing or 1))
    target = F.when(F.col("__above"), F.col("__stop").cast("double")).otherwise(F.least(share, F.col("__stop").cast("double")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(stop)))).otherwise(0.0)
    return flagged.withColumn("target", target).select("source", "source_size", "weight", "target", rate.alias("rate"))


def mixed(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, stop: int = STOP, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """df with size (words), source_size, target (of its source), copies (times it is emitted) and taken (its words by copies).

    A null text has no words; it and an empty one are emitted like the others of their source, taking none. Null
    sources are one source, the last. Rows that repeat, or share an id, draw alike; a null id draws by its text.
    Very long texts are counted whole, inside the JVM. Columns of df named like a result are replaced, and an empty
    table gives an empty result. df is read twice; only rows a source are shuffled, unless the sources outgrow a broadcast.
    """
    rows = df.withColumns({"__key": F.col(source).cast("string"), "__size": words(F.col(text))})
    by_source = written(targets(rows.select(F.col("__key").alias("source"), F.col("__size").alias("size")), weights, stop), "mix-targets")
    held = by_source.agg(F.coalesce(F.sum(F.coalesce(F.length("source"), F.lit(0)) * 4 + 64), F.lit(0))).first()[0]
    side = by_source.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("__source"), *[F.col(c).alias(f"__{c}") for c in ("source_size", "target", "rate")])
    got = rows.withColumn("__source", F.coalesce(F.concat(F.lit("="), "__key"), F.lit("")))  # the null source is the empty key
    got = got.join(F.broadcast(side) if held <= BROADCAST_BYTES else side.hint("shuffle_merge"), "__source")
    whole = F.floor("__rate")
    copies = (whole + (drawn(F.col(doc_id), F.col(text), seed) < F.col("__rate") - whole).cast("long")).cast("long")
    own = {"size": F.col("__size"), "source_size": F.col("__source_size"), "target": F.col("__target"), "copies": copies, "taken": copies * F.col("__size")}
    return got.withColumns({f"__out_{k}": v for k, v in own.items()}).select(*table_columns(df, own), *[F.col(f"__out_{k}").alias(k) for k in own])


def mixture(df: DataFrame, **stated) -> DataFrame:
    """The mix itself: every row of df once a copy, with copy (from 1); what stated says goes to mixed()."""
    got = mixed(df, **stated).where("copies > 0")
    return got.select(*table_columns(df, ["copy"]), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
