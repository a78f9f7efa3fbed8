"""Translation requests: items by page, their payload, and how large they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.classify import block_kind
from folioflow.functions.text import for_translation, is_noise
from folioflow.operators.segments import ready
from folioflow.thresholds import DEFAULTS, Thresholds

PROMPT_HEAD = ("Translate every t of these items into the target language. Keep each id, the order and the number of items, and the paragraph "
               "breaks within a t. Answer with one JSON object of the same form and nothing else.\n\n")
REPAIR_HEAD = "Rewrite the following answer as one valid JSON object {{\"items\": [{{\"id\": ..., \"t\": ...}}]}} with {} items. Change no text.\n\n"
TRANSLATE_HEAD = "Translate the text into the target language. Answer with the translation only.\n"
MARKER_RULE = "Keep each line that is a block marker unchanged and in its place.\n"
POLISH_HEAD = "Make this translation read naturally. Keep its meaning, numbers and line breaks. Answer with the text only.\n\n"


def item_id(page: Column, block_idx: Column) -> Column:
    return F.concat(F.lit("p"), page.cast("string"), F.lit("_b"), block_idx.cast("string"))


def items(blocks: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """A row for each block that has something to translate: ``id``, ``t``, ``kind``."""
    made = for_translation(F.col("text"))
    rows = ready(blocks).where(~is_noise(F.col("text"))).withColumn("t", made).where("t != ''")
    return rows.select("doc_id", "page", F.coalesce("reading_order", "block_idx").alias("place"), "ordinal", "block_idx",
                       item_id(F.col("page"), F.col("block_idx")).alias("id"), "t", block_kind(F.col("text"), F.col("size"), t).alias("kind"))


def page_items(blocks: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """``items`` of each page in reading order."""
    rows = items(blocks, t).groupBy("doc_id", "page").agg(
        F.sort_array(F.collect_list(F.struct("place", "ordinal", F.struct("id", "t", "kind").alias("item")))).alias("rows"))
    return rows.select("doc_id", "page", F.col("rows.item").alias("items"))


def payload(items: Column) -> Column:
    """Compact JSON of ids and texts."""
    return F.to_json(F.struct(F.transform(items, lambda i: F.struct(i["id"].alias("id"), i["t"].alias("t"))).alias("items")))


def tokens(chars: Column, t: Thresholds = DEFAULTS) -> Column:
    return F.ceil(F.greatest(F.lit(0), chars) / t.chars_per_token).cast("long")


def requests(pages: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Pages with ``payload`` and the five sizes of a request."""
    rows = pages.withColumn("payload", payload(F.col("items")))
    return rows.withColumns({
        "n_items": F.size("items").cast("long"),
        "input_chars": F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + F.length(i["t"])),
        "payload_chars": F.length("payload").cast("long"),
        "prompt_chars": (F.length("payload") + len(PROMPT_HEAD)).cast("long"),
    }).withColumn("estimated_prompt_tokens", tokens(F.col("prompt_chars"), t))


def page_stats(blocks: DataFrame, max_input_chars: int = DEFAULTS.max_input_chars, max_output_tokens: int = DEFAULTS.max_output_tokens,
               t: Thresholds = DEFAULTS) -> DataFrame:
    """How large the request of every page is, and whether it is over the limit."""
    return requests(page_items(blocks, t), t).select(
        "doc_id", "page", F.col("n_items").alias("items"), "input_chars", "payload_chars", "prompt_chars", "estimated_prompt_tokens",
        F.lit(max_output_tokens).cast("long").alias("max_output_tokens"),
        (F.col("estimated_prompt_tokens") + max_output_tokens).alias("estimated_total_tokens"),
        (F.col("input_chars") > max_input_chars).alias("over_input_char_limit"), F.lit(max_input_chars).cast("long").alias("max_input_chars"))


def select_pages(blocks: DataFrame, wanted: list[int] | None) -> DataFrame:
    """Blocks of the wanted pages (None: all); an error if there are none."""
    if wanted is None:
        return blocks
    kept = blocks.where(F.col("page").isin(wanted))
    if kept.isEmpty():
        raise RuntimeError(f"no blocks on the wanted pages {wanted}")
    return kept
