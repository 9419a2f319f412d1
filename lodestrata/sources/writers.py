"""Sinks: canonical JSON, content-verified writes, partitioned tables, wide CSV, Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(*columns: str) -> Column:
    """Compact JSON of the columns in name order, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows whatever their order and partitions: of count, sum and xor of row digests."""
    digest = F.xxhash64(canonical_json(*df.columns))
    row = df.agg(F.count("*"), F.sum(digest.cast("decimal(38,0)")), F.bit_xor(digest)).first()
    import hashlib

    return hashlib.sha256("|".join(map(str, row)).encode()).hexdigest()


def exists(df: DataFrame, path: str) -> bool:
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf).exists(at)


def write_once_or_verify(df: DataFrame, path: str) -> bool:
    """Write Parquet where there is none (True); else require equal content (False) and raise if it differs."""
    if not exists(df, path):
        df.write.mode("errorifexists").parquet(path)
        return True
    if content_digest(df.sparkSession.read.parquet(path).select(df.columns)) != content_digest(df):
        raise ValueError(f"{path} holds other content")
    return False


def write_json_lines(df: DataFrame, path: str) -> None:
    """Canonical JSON lines; a file a partition."""
    df.select(canonical_json(*df.columns).alias("value")).write.text(path)


def write_by(df: DataFrame, path: str, *keys: str) -> None:
    """A folder a key value; rows of one value are spread over tasks as they come, so that a large one is several files."""
    df.write.partitionBy(*keys).parquet(path)


def write_csv_union(frames: list[DataFrame], path: str) -> None:
    """CSV with the union of the frames' columns."""
    from functools import reduce

    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).write.option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A Markdown table of a small result; raises for more than most rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.6g}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)]) + "\n"


def write_bytes_atomically(spark, path: str, content: bytes) -> str:
    """Write a small file beside its place, then rename it there, so that no reader sees a part of it; the content's SHA-256."""
    import hashlib
    import uuid

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    store = at.getFileSystem(conf)
    out = store.create(beside, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    if store.exists(at):
        store.delete(at, False)
    if not store.rename(beside, at):
        raise OSError(f"{path} could not be put in place")
    return hashlib.sha256(content).hexdigest()


def write_json_atomically(spark, path: str, value) -> dict[str, object]:
    """Canonical JSON of a small value, written atomically: path, bytes and sha256 of what was written."""
    import json

    content = (json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2) + "\n").encode()
    return {"path": path.rsplit("/", 1)[-1], "bytes": len(content), "sha256": write_bytes_atomically(spark, path, content)}


def write_signatures(df: DataFrame, path: str, key: str, signature: str) -> None:
    """key and signature (an array of whole numbers) as Parquet in the order of the key within files, one row a key."""
    df.select(key, F.col(signature).cast("array<long>").alias(signature)).sortWithinPartitions(key).write.parquet(path)


def tar_archives(df: DataFrame, name: str, content: str) -> DataFrame:
    """part and archive: the bytes of one tar archive for each partition of df, its members in the order of their names, without times or owners.

    An archive is in memory while it is made: partitions are the caller's to size.
    """

    def packed(frames):
        import io
        import tarfile

        import pandas as pd

        found = [(n, bytes(c)) for f in frames for n, c in zip(f["name"], f["content"], strict=True)]
        if found:
            buffer = io.BytesIO()
            with tarfile.open(fileobj=buffer, mode="w") as archive:
                for n, c in sorted(found):
                    member = tarfile.TarInfo(n)
                    member.size = len(c)
                    archive.addfile(member, io.BytesIO(c))
            yield pd.DataFrame({"archive": [buffer.getvalue()]})

    made = df.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).mapInPandas(packed, "archive binary")
    return made.select(F.spark_partition_id().alias("part"), "archive")
