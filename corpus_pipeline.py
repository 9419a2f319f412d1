"""The corpus pipeline: language filter, near-duplicates, decontamination, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and returns all that it keeps; but for the last they return
the columns of documents. A null or empty text has no letter and goes at the first stage, with texts of
digits and marks alone; later stages meet it only if they are run by themselves, and keep it. A null id is
like any other but for near-duplicates, where it takes no part and stays. Repeated rows stay or go together;
ties go to the smaller id; a very long text is read whole by every stage; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import bpe, decontam, langid, neardup, secrets
from lodestrata.llm.queries import tokenizer_path
from lodestrata.llm.shared import forget, table, written


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without any letter go."""
    found = langid.identify(docs, langid.train(docs))
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles at 0.8: the one with the smallest id.

    Rows go by id and text: another text under a removed id stays, and rows that repeat stay or go together.
    """
    return neardup.one_of_each(docs, width=5, percent=80).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced; n_chars counts the new text."""
    found = secrets.scan(docs, secrets.scanner(spark))
    n_chars = F.when(F.exists("findings", lambda c: c["is_secret"]), F.length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"text": F.col("redacted"), "n_chars": n_chars}).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document left."""
    return bpe.digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language", with_language),
    ("near-duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", tokens),
]
#: No SQL expresses the stages; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
