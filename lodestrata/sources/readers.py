"""Scans: everything is opened by Spark's readers, so that any store Spark knows will do."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestrata.functions.text import code2vec_contexts


def task_csv(spark: SparkSession, folder: str, limit_per_task: int | None = None) -> DataFrame:
    """record_id, task_id, row_index, source_file and code (stripped) of task-NN.csv files; blank code is skipped.

    row_index numbers a file's rows in its order, blank ones too; the limit counts kept rows. A file with quoted
    line ends is one part of a scan, whose rows come in order: their growing numbers tell it.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/task-*.csv")
    rows = rows.select(F.col("_metadata.file_name").alias("source_file"), F.regexp_replace(F.coalesce("code", F.lit("")), r"^\s+|\s+$", "").alias("code"), F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("task_id", F.regexp_extract("source_file", r"^task-(\d+)\.csv$", 1)).where("task_id != ''")
    rows = rows.withColumn("task_id", F.col("task_id").cast("int"))
    in_order = Window.partitionBy("source_file").orderBy("place")
    rows = rows.withColumns({"row_index": F.row_number().over(in_order) - 1, "kept": F.sum((F.col("code") != "").cast("int")).over(in_order)}).where("code != ''")
    rows = rows if limit_per_task is None else rows.where(F.col("kept") <= limit_per_task)
    record_id = F.concat(F.lit("task-"), F.lpad(F.col("task_id").cast("string"), 2, "0"), F.lit(":"), F.col("row_index").cast("string"))
    return rows.select(record_id.alias("record_id"), "task_id", "row_index", "source_file", "code")


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; a malformed line fails the read, or with strict false is kept in _corrupt_record."""
    reader = spark.read.schema(schema if strict else f"{schema}, _corrupt_record STRING")
    return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """path and document (VARIANT) of whole JSON files."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return text.select("path", F.try_parse_json("value").alias("document"))


def labelled_tables(spark: SparkSession, parts: dict[str, str], code: str, label: str) -> DataFrame:
    """Union by name of CSV, JSON and JSONL files (format -> path), rows with code and label only."""
    readers = {"csv": lambda p: spark.read.option("header", True).option("multiLine", True).csv(p), "json": lambda p: spark.read.option("multiLine", True).json(p), "jsonl": spark.read.json}
    frames = [readers[kind](path) for kind, path in parts.items()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return whole.where(F.col(code).isNotNull() & F.col(label).isNotNull() & (F.trim(F.col(code).cast("string")) != ""))


def source_tree(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """problem_id (the folder), submission_id (the name without extension), source_relpath, size and content of source files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    parts = F.regexp_extract("path", r"([^/]+)/([^/]+)\.[^./]+$", 1), F.regexp_extract("path", r"([^/]+)/([^/]+)\.[^./]+$", 2)
    return files.select(parts[0].alias("problem_id"), parts[1].alias("submission_id"), F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("source_relpath"), F.col("length").alias("size"), "content")


def code2vec(spark: SparkSession, path: str, limit: int | None = None, strict: bool = True) -> DataFrame:
    """label and contexts of path-context lines, limit of them at most; a line without a whole context fails the read, or is left out."""
    rows = spark.read.text(path).where("trim(value) != ''").select("value", code2vec_contexts(F.col("value")).alias("r"))
    whole = F.size("r.contexts") > 0
    rows = rows.where(whole | F.raise_error(F.concat(F.lit("no valid path contexts: "), F.substring("value", 1, 80))).cast("boolean")) if strict else rows.where(whole)
    rows = rows.select("r.*")
    return rows if limit is None else rows.limit(limit)


def duplicate_map(spark: SparkSession, path: str) -> DataFrame:
    """cluster and member of lines of comma-separated ids; raises if an id is in two lines."""
    lines = spark.read.text(path).where("trim(value) != ''").withColumn("cluster", F.sha2("value", 256))
    rows = lines.select("cluster", F.explode(F.transform(F.split("value", ","), F.trim)).alias("member")).where("member != ''")
    if rows.groupBy("member").agg(F.countDistinct("cluster").alias("n")).where("n > 1").head(1):
        raise ValueError("an id is in two clusters")
    return rows


class TarMember(InputPartition):
    """One archive; members are read by the task that has it."""


class TarReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def partitions(self):
        return [TarMember(p) for p in self.path.split(",")]

    def read(self, partition):
        import tarfile

        with tarfile.open(partition.value, "r|*") as archive:  # a stream, a member at a time
            for member in archive:
                if member.isfile() and member.name.endswith(self.suffix):
                    yield partition.value, member.name, member.size, archive.extractfile(member).read()


class TarSource(DataSource):
    """format("tar"): archive, name, size and content of the members of mounted tar files (path, comma separated; suffix)."""

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return "archive string, name string, size long, content binary"

    def reader(self, schema):
        return TarReader(self.options)


def tar_members(spark: SparkSession, paths: list[str], suffix: str = "") -> DataFrame:
    spark.dataSource.register(TarSource)
    return spark.read.format("tar").option("path", ",".join(paths)).option("suffix", suffix).load()


def tar_csv_rows(spark: SparkSession, paths: list[str], where: str) -> DataFrame:
    """Rows of CSV members with a header, as name and a map of columns, filtered by an expression on the map (row['status'] = ...)."""
    @F.pandas_udf("array<map<string,string>>")
    def rows(contents: pd.Series) -> pd.Series:
        import csv
        import io

        return pd.Series([list(csv.DictReader(io.StringIO(bytes(c).decode("utf-8", "replace")))) for c in contents], dtype=object)

    return tar_members(spark, paths, ".csv").select("name", F.explode(rows("content")).alias("row")).where(where)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1) and value of text files, by splits: a split counts its lines, and starts at the sum of those before it in its file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("path", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("path", "split", "first", F.coalesce(before, F.lit(0)).alias("start"))
    return lines.join(starts, ["path", "split"]).select("path", (F.col("at") - F.col("first") + F.col("start") + 1).alias("line"), "value")


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, line and the schema's columns of JSON lines, blank ones left out; a line that is no JSON object fails the read, named by file and number."""
    rows = numbered_lines(spark, path).where("trim(value) != ''")
    good = F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT")
    said = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(" is not a JSON object"))
    rows = rows.where(F.coalesce(good, F.lit(False)) | F.raise_error(said).cast("boolean"))
    return rows.select("path", "line", F.from_json("value", schema).alias("r")).select("path", "line", "r.*")


def file_listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path and size of all files below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("size"))


def discovered_tables(spark: SparkSession, root: str, code: str, label: str) -> DataFrame:
    """labelled_tables() of all CSV, JSON and JSONL files below root; raises if there are none."""
    names = [r.path for r in file_listing(spark, root, "*.{csv,json,jsonl}").select("path").collect()]  # file names
    by_kind = {kind: sorted(n for n in names if n.endswith(f".{kind}")) for kind in ("csv", "json", "jsonl")}
    parts = {kind: found for kind, found in by_kind.items() if found}
    if not parts:
        raise ValueError(f"no .csv, .json or .jsonl files below {root}")
    return labelled_tables(spark, parts, code, label)


#: File extensions of languages, and folders of a language in a layout of problems.
EXTENSIONS = {"python": ".py", "java": ".java", "c": ".c", "cpp": ".cpp"}
LANGUAGE_FOLDERS = {"python": ("Python", "python"), "java": ("Java", "java"), "c": ("C", "c"), "cpp": ("C++", "cpp")}


def task_sources(spark: SparkSession, root: str, layout: str, language: str = "python") -> DataFrame:
    """task, source_relpath, size and content of source files.

    layout: generic (task/.../file), codenet (task/language/.../file, below data if there is one), or poj104 (the folder
    right above the file, or of files at the top the first run of digits of the name).
    """
    extension = EXTENSIONS[language]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:(//)?", "")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:(//)?", ""), F.concat(F.lit("^.*?"), F.lit(r"\Q"), base, F.lit(r"\E/")), "")
    parts = F.split(relative, "/")
    if layout == "generic":
        task, fits = parts[0], F.size(parts) > 1
    elif layout == "codenet":
        at = F.when(parts[0] == "data", 1).otherwise(0)
        task, fits = F.get(parts, at), F.get(parts, at + 1).isin(*LANGUAGE_FOLDERS[language]) & (F.size(parts) > at + 2)
    elif layout == "poj104":
        digits = F.regexp_extract(parts[0], r"(\d+)", 1)
        task = F.when(F.size(parts) > 1, F.element_at(parts, -2)).when(digits != "", digits)
        fits = task.isNotNull()
    else:
        raise ValueError(f"unknown layout {layout}")
    rows = files.select(task.alias("task"), relative.alias("source_relpath"), F.col("length").alias("size"), "content", fits.alias("fits"))
    return rows.where("fits").drop("fits")


def split_inventory(spark: SparkSession, root: str) -> DataFrame:
    """split, path and lines of the first file (by path) of each split below root: train, val (or valid) and test, named in .c2s or .c2v files."""
    files = file_listing(spark, root, "*.{c2s,c2v}").withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    split = F.when(F.col("name").contains("train"), "train").when(F.col("name").contains("val"), "val").when(F.col("name").contains("test"), "test")
    exact = F.col("name").rlike(r"\.(train|val|valid|test)\.c2[sv]$")
    first = files.withColumn("split", split).where("split IS NOT NULL").groupBy("split").agg(F.min_by("path", F.struct(~exact, ~F.col("name").endswith(".c2s"), F.col("path"))).alias("path"))
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{c2s,c2v}").text(root).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("lines"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return first.withColumn("path", plain("path")).join(lines.withColumn("path", plain("path")), "path", "left").select("split", "path", F.coalesce("lines", F.lit(0)).alias("lines"))


def archive_status(spark: SparkSession, paths: dict[str, int | None]) -> DataFrame:
    """path, exists, bytes and size_matches of files with the size that each should have, if known."""
    rows = []
    for path, expected in paths.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        there = store.exists(at)
        size = store.getFileStatus(at).getLen() if there else None
        rows.append((path, there, size, there and (expected is None or size == expected)))
    return spark.createDataFrame(rows, "path string, exists boolean, bytes long, size_matches boolean")


def manifest_tasks(spark: SparkSession, path: str, list_field: str, schema: str) -> DataFrame:
    """Rows of a list in a JSON manifest: one document, whose list_field holds objects of the schema."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"{list_field} array<struct<{schema}>>")[list_field]).alias("r")).select("r.*")


def verified_split(assignments: DataFrame, sources: DataFrame, key: str, digest: str, split: str, expected: int) -> DataFrame:
    """Rows of one split with their sources: every assigned key is there once, its digest is the one assigned, and there are as many as expected; else it raises."""
    own = assignments.where(F.col("split") == split).select(key, F.col(digest).alias("__want"))
    both = own.join(sources, key, "left")
    bad = both.agg(F.count("*").alias("n"), F.countDistinct(key).alias("d"), F.sum((F.col(digest).isNull() | (F.col(digest) != F.col("__want"))).cast("long")).alias("wrong")).first()
    if bad.n != expected or bad.d != expected or bad.wrong:
        raise ValueError(f"split {split}: {bad.d} keys, {bad.n} rows, {bad.wrong or 0} with other content; {expected} expected")
    return both.drop("__want")
