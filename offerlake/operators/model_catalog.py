"""Ranking of language models by price, size and kind. A model has seq, id, name, context_length, pricing, architecture, top_provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_free_text_model() -> Column:
    """Whether a model costs nothing and writes text, but no audio."""
    free_id = F.col("id").endswith(":free") | (F.col("id") == "openrouter/free")
    request = F.coalesce(F.nullif("pricing.request", F.lit("")), F.lit("0")) == "0"
    free = free_id | F.coalesce((F.col("pricing.prompt") == "0") & (F.col("pricing.completion") == "0") & request, F.lit(False))
    outputs = F.coalesce("architecture.output_modalities", F.array().cast("array<string>"))
    kind = F.coalesce("architecture.modality", F.lit(""))
    writes = F.array_contains(outputs, "text") | kind.contains("->text")
    speaks = F.array_contains(outputs, "audio") | kind.contains("->text+audio")
    return free & writes & ~speaks


def rank_models(models: DataFrame) -> DataFrame:
    """Free text models with localScore and selectionReason, best first. seq is the provider's order.

    The catalogue is one short table, so its order number is taken in one window.
    """
    free = models.where(is_free_text_model()).withColumn("_i", F.row_number().over(Window.orderBy("seq")))
    context = F.coalesce("context_length", "top_provider.context_length", F.lit(0))
    output = F.coalesce("top_provider.max_completion_tokens", F.lit(0))
    ident, both = F.lower("id"), F.concat_ws(" ", F.lower("id"), F.lower(F.coalesce("name", F.lit(""))))
    rules = [
        (context >= 1_000_000, 80, "very large context"),
        ((context >= 250_000) & (context < 1_000_000), 40, "large context"),
        (output >= 32_000, 20, "large completion budget"),
        (ident.rlike("nemotron|gemma|cohere|qwen|deepseek|gpt-oss|llama"), 30, "general reasoning family"),
        (both.rlike("code"), 8, "coding-capable family"),
        (both.rlike("safety|guard|moderation"), -250, "penalized safety/moderation model"),
        (ident == "openrouter/free", -60, "router fallback, not a fixed model"),
    ]
    score = F.lit(1001) - F.col("_i") + sum((F.when(test, n).otherwise(0) for test, n, _ in rules), F.lit(0))
    reason = F.concat_ws("; ", F.lit("free text model"), F.concat(F.lit("OpenRouter sorted rank #"), F.col("_i").cast("string")), *[F.when(test, why) for test, _, why in rules])
    return free.withColumn("localScore", score).withColumn("selectionReason", reason).drop("_i").orderBy(F.desc("localScore"), "seq")


def best_model(models: DataFrame) -> DataFrame:
    """The best free text model, as one row; no rows if there is none."""
    return rank_models(models).limit(1)


def model_line(rank: Column) -> Column:
    context = F.coalesce("context_length", "top_provider.context_length", F.lit(0))
    output = F.coalesce("top_provider.max_completion_tokens", F.lit(0))
    return F.concat(rank.cast("string"), F.lit(". "), F.col("id"), F.lit(" | "), F.coalesce("name", F.lit("unnamed")), F.lit(" | ctx "), context.cast("string"), F.lit(" | max out "), output.cast("string"), F.lit(" | score "), F.col("localScore").cast("string"))
