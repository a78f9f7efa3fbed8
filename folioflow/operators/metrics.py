"""Totals of a run from the log of its calls (a table, so that repeated tasks count nothing twice)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.requests import tokens


def call_metrics(calls: DataFrame, by: list[str] = ()) -> DataFrame:
    """``calls`` has ok, elapsed, prompt_tokens, completion_tokens, total_tokens, prompt_chars and completion_chars.

    Token counts that a server didn't report are estimated from the characters; failed calls add none; nothing counts below 0.
    """
    prompt = F.coalesce("prompt_tokens", tokens(F.coalesce("prompt_chars", F.lit(0))))
    completion = F.coalesce("completion_tokens", tokens(F.coalesce("completion_chars", F.lit(0))))
    total = F.coalesce("total_tokens", prompt + completion)
    add = lambda c: F.coalesce(F.sum(F.when(F.col("ok"), F.greatest(F.lit(0), c))), F.lit(0)).cast("long")
    return calls.groupBy(*by).agg(
        F.count("*").alias("requests_total"), F.count_if("ok").alias("requests_ok"), F.count_if(~F.col("ok")).alias("requests_failed"),
        add(prompt).alias("prompt_tokens"), add(completion).alias("completion_tokens"), add(total).alias("total_tokens"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.greatest(F.lit(0.0), F.col("elapsed")))), F.lit(0.0)).alias("successful_elapsed"))


def rates(metrics: DataFrame, translated: int, total_elapsed: float) -> DataFrame:
    """With ``tokens_per_second`` (0 without a successful call) and ``blocks_per_second``."""
    return metrics.withColumns({
        "tokens_per_second": F.when(F.col("successful_elapsed") > 0, F.col("completion_tokens") / F.col("successful_elapsed")).otherwise(0.0),
        "blocks_per_second": F.lit(translated / max(total_elapsed, 1e-6))})


def page_totals(summaries: DataFrame) -> DataFrame:
    """Pages that were retried, blocks that kept their source text, and the first page that failed."""
    return summaries.agg(F.count_if(F.col("retry_count") > 0).alias("pages_retried"), F.coalesce(F.sum("source_fallback_blocks"), F.lit(0)).alias("fallback_blocks"),
                         F.min(F.when(F.col("status").isin("page_too_large", "page_batch_failed"), F.col("page"))).alias("first_failed_page"))
