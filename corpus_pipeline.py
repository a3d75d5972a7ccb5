"""The training-text pipeline: each stage takes the documents its predecessor kept.

All stages but the last return the columns of ``documents``.  Each stage's rows are written as
Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayframe.llm import contamination, lines, mixing, ngrams, toxicity
from wayframe.llm.registry import ready, table
from wayframe.runtime import cut

# Two stages are not SQL: a fitted classifier and matching by edit distance.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.clean(docs, table(ready(spark), sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go, and documents that have no other line left; ``n_chars`` follows the text."""
    ready(spark)
    left = lines.dedup(docs.select("doc_id", "text", "lang", "source", "n_chars"))
    lost = F.col("exact") + F.col("near") > 0
    left = left.filter(~lost | (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return left.select("doc_id", "text", "lang", "source", F.when(lost, F.length("text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


def keep_one_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are alike the one with the least id stays."""
    ready(spark)
    return ngrams.first_of_class(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return contamination.clean(docs, table(ready(spark), sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes from each document, repeats counted."""
    ready(spark)
    return mixing.mix(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_classes", keep_one_of_class), ("decontamination", drop_benchmark), ("source_mix", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
