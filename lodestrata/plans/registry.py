"""The register of queries: each under its function's name, with the SQL it is held against.

Numbers are rounded alike on both sides, as sums of doubles depend on their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: The key of keyed digests, and its two pads for SQL.
BEACON = hashlib.sha256(b"lodestrata").digest()
INNER, OUTER = (bytes(b ^ pad for b in BEACON.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as a query under its name, with its SQL if there is any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def hmac_sql(message: str) -> str:
    """SQL for the hex HMAC of a blob expression."""
    return f"sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || {message})))"


def nul_joined(*fields: str) -> str:
    return r" || '\x00'::BLOB || ".join(f"encode(CAST({f} AS VARCHAR))" for f in fields)
