"""The corpus pipeline: quality rules, line dedup, near dedup, decontamination, packing.

Each stage takes what the one before kept, written as Parquet and read again;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutover.llm import decontaminate, line_runs, near_forest, pack_windows, quality_divergence
from cutover.llm.queries import table, tokenizer_path
from cutover.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_divergence.judged(docs).filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs; one of which no word is left goes."""
    left = line_runs.without_repeated_runs(docs).filter((F.size("deleted_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return near_forest.near_duplicates(docs).filter("kept").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    found = decontaminate.find_occurrences(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.filter(F.size("items") == 0).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens."""
    return pack_windows.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("benchmark", benchmark), ("packing", packing)]

#: Token ids and signatures are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
