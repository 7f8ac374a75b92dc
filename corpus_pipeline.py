"""A training-corpus pipeline: five filters and rewrites of `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offerlake.llm import compact_windows, decontam, mixing, setsketch, toxicity
from offerlake.llm.store import durable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores below one half."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group over links of 0.8 on five-word shingles: the one with the smallest doc_id."""
    return setsketch.drop_near_duplicates(docs, k=5, percent=80)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that near-duplicate an earlier one."""
    return compact_windows.drop_repeated_passages(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim benchmark window."""
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson copies of documents, sources weighing as the square root of their sizes, shuffled globally."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("minhash_near_dedup", remove_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("benchmark_decontamination", remove_benchmark),
    ("source_mixing", mix_sources),
]

#: A trained classifier's decisions are no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
