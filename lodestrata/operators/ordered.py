"""Running sums and best values over a whole table's order, in ranges: no task holds more than a range of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.graphs import cut

#: Rows of a range, about.
RANGE_ROWS = 1_000_000


def running(df: DataFrame, order: list[str], sums: dict[str, Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with the sums (decimals) of whole numbers over all rows before each, by an order without ties."""
    none = F.lit(0).cast("decimal(38,0)")
    exact = {k: v.cast("decimal(38,0)") for k, v in sums.items()}
    whole = lambda a, b: (F.coalesce(a, none) + F.coalesce(b, none)).cast("decimal(38,0)")
    return over_ranges(df, order, exact, range_rows, F.sum, whole)


def running_best(df: DataFrame, order: list[str], value: str, out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with the largest value of all rows before each, null for the first."""
    return over_ranges(df, order, {out: F.col(value)}, range_rows, F.max, F.greatest)


def over_ranges(df: DataFrame, order: list[str], values: dict[str, Column], range_rows: int, total: Callable[[str], Column], both: Callable[[Column, Column], Column]) -> DataFrame:
    """df with each value's total over all rows before.

    Up to range_rows rows, as counted, are one window. More are sorted into ranges, which are written, so that every read finds
    the same; totals inside a range are windows over it, and each range starts at those of the ranges before it, one row a range.
    """
    rows = df.withColumns({f"__{k}": v for k, v in values.items()})
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    count = df.count()
    if count <= range_rows:
        own = before(Window.orderBy(*order))
        return rows.select(*df.columns, *[both(total(f"__{k}").over(own), F.lit(None)).alias(k) for k in values])
    ranged = cut(rows.repartitionByRange(1 + count // range_rows, *order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy("__range").agg(*[total(f"__{k}").alias(f"__{k}") for k in values])
    starts = totals.select("__range", *[total(f"__{k}").over(before(Window.orderBy("__range"))).alias(f"__start_{k}") for k in values])
    inside = before(Window.partitionBy("__range").orderBy(*order))
    own = ranged.withColumns({f"__in_{k}": total(f"__{k}").over(inside) for k in values}).join(F.broadcast(starts), "__range")
    return own.select(*df.columns, *[both(F.col(f"__in_{k}"), F.col(f"__start_{k}")).alias(k) for k in values])
