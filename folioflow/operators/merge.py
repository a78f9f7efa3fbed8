"""Results joined back onto their source blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import is_noise

KEYS = ["doc_id", "page", "block_idx"]


def last_by_key(rows: DataFrame, order: str, keys: list[str] = KEYS) -> DataFrame:
    """One row for each key: that of the largest ``order``. An aggregate, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}") for c in rest))


def merge_results(blocks: DataFrame, results: DataFrame, kind: Column | None = None, order: str | None = None) -> DataFrame:
    """All blocks in their order, with the results' text where there is one.

    ``results`` has the keys and ``translated`` (and ``segment_kind``, unless ``kind`` tells it). Blocks without a
    result keep their text. A text counts only if it isn't empty and the source isn't noise.
    """
    if order:
        results = last_by_key(results, order)
    given = [c for c in ("translated", "segment_kind") if c in results.columns]
    joined = blocks.join(results.select(*KEYS, *(F.col(c).alias(f"_{c}") for c in given)), KEYS, "left")
    use = F.col("_translated").isNotNull() & (F.col("_translated") != "") & ~is_noise(F.col("text"))
    named = kind if kind is not None else F.lit(None).cast("string")
    if "segment_kind" in given:
        named = F.coalesce("_segment_kind", named)
    out = joined.withColumns({"original_text": F.col("text"), "segment_kind": named, "text": F.when(use, F.col("_translated")).otherwise(F.col("text"))})
    return out.drop(*(f"_{c}" for c in given))


def translated_count(blocks: DataFrame, by: list[str] = ()) -> DataFrame:
    """How many blocks read otherwise than before, noise aside."""
    changed = (F.col("text") != F.col("original_text")) & ~is_noise(F.col("original_text"))
    return blocks.groupBy(*by).agg(F.count_if(changed).alias("translated"), F.count("*").alias("blocks"))


def id_difference(expected: Column, returned: Column) -> tuple[Column, Column]:
    """Ids that are missing and ids that nobody asked for."""
    return F.array_except(expected, returned), F.array_except(returned, expected)


def first_by_id(rows: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """The first row of each key; answers may repeat an id."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}") for c in rest))


def missing_items(items: Column, answers: Column) -> Column:
    """Items without an answer that says anything."""
    return F.filter(items, lambda i: ~F.exists(answers, lambda a: (a["id"] == i["id"]) & (F.trim(a["t"]) != "")))


def by_position(items: Column, answers: Column) -> Column:
    """Answers under the ids of the items at their places, if there are as many; else null."""
    zipped = F.transform(F.arrays_zip(items.alias("i"), answers.alias("a")), lambda z: F.struct(z["i"]["id"].alias("id"), z["a"]["t"].alias("t")))
    return F.when(F.size(items) == F.size(answers), zipped)


def ordinals(rows: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Rows numbered from 0 within their keys."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
