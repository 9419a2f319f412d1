"""What the operators of this subpackage share: tables, written intermediates, held-out rows."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python, so that long texts do not pile up in a worker.
BATCH_BYTES = 2 << 20
#: Rows that a reader of whole texts decodes at once.
READ_ROWS = 512
#: Bytes of a row group of written tables, which a task holds while it writes.
BLOCK_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes from now on in this session, whatever bound it has: the operators' memory is reckoned by it.

    So are the rows that a Parquet reader of whole texts holds at once, and the row groups that a task holds while
    it writes them, where the session has no size of its own.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(rows)) > READ_ROWS:
        spark.conf.set(rows, str(READ_ROWS))
    if spark.conf.get("parquet.block.size", None) is None:
        spark.conf.set("parquet.block.size", str(BLOCK_BYTES))


def give_back() -> None:
    """Return freed memory of this worker to the system, which serves other operators' batches later; where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir: set it to a folder that the driver and all executors share")
        found = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="lodestrata-")
        shared_folder.own = found
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete written() tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "written_path", None):
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of rows that no model learns from; a null id is held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def table_columns(df: DataFrame, own) -> list[Column]:
    """The columns of df but for those named, in any case, like an operator's own."""
    names = {c.lower() for c in own}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
