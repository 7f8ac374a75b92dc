"""The queries of this package: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, compact_windows, ctw, decontam, html_diff, langid, mixing, runs, setsketch, topk, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.chat_digest(chat.format_chats(chat.to_turns(rows.unionByName(more))))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract_main_text(_read(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.passage_pairs(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), k=2, percent=80)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.lm_scores(_read(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantise(_read(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_report(_read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_report(_read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(runs.with_repeats(_read(spark, sf_dir, "documents")))


_ALL = (
    op1_chat_formatting, op2_toxicity, op3_html_extraction, op4_language_id, op5_substring_dedup, op6_mixing, op7_minhash_near_dedup, op8_decontamination, op9_lm_scoring, op10_exact_top_k, op11_bpe, op12_tokenizer_alignment,
    op13_periodic_runs,
)
QUERIES = {f.__name__: f for f in _ALL}
