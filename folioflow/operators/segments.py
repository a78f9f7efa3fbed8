"""Runs of blocks that are translated together.

Whether a block joins the one before it depends on these two only: a merge needs equal kinds, so the kind of a
run's first block is that of its last. A window with ``lag`` gives the reason for each block, and a running
count of breaks numbers the runs. Windows are by document; a document's blocks are bounded by its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.classify import block_kind
from folioflow.functions.text import for_translation, is_noise, is_short, normalize, strip
from folioflow.thresholds import DEFAULTS, Thresholds

#: Reasons that merge; all others break.
MERGES = ["toc_short_lines", "toc_font_match", "list_continuation", "mid_sentence", "continuation_start", "short_paragraph_lines"]
#: Fixed value: words that go on a sentence.
CONTINUES = "and|or|but|to|for|with|of|the"


def ends_mid_sentence(text: Column) -> Column:
    s = strip(text)
    return (s != "") & ~s.rlike(r"[.!?:;。！？]\z") & (s.rlike(r"[,—/-]\z") | s.rlike(r"\p{IsLowercase}\z"))


def starts_continuation(text: Column) -> Column:
    s = strip(text)
    return s.rlike(r"\A\p{IsLowercase}") | s.rlike(rf"(?i)\A(?:{CONTINUES})(?![\p{{L}}\p{{N}}_])")


def _edge(block, name: str, i: int) -> Column:
    return F.coalesce(block(name), F.try_element_at(block("bbox"), F.lit(i + 1)))


def merge_reason(prev, this, t: Thresholds = DEFAULTS) -> Column:
    """``prev`` and ``this`` give the columns of two neighbouring blocks by name."""
    size = lambda b: F.coalesce(b("size"), F.lit(0.0))
    font = (F.abs(size(prev) - size(this)) <= t.font_size_shift) & prev("font").eqNullSafe(this("font"))
    gap = _edge(this, "y0", 1) - _edge(prev, "y1", 3)
    both = lambda k: (prev("kind") == k) & (this("kind") == k)
    short = is_short(prev("text"), t) & is_short(this("text"), t)
    flow = (this("kind") == "paragraph") & font
    return (F.when(is_noise(prev("text")) | is_noise(this("text")), "noise")
            .when(prev("page") != this("page"), "cross_page")
            .when(F.abs(_edge(prev, "x0", 0) - _edge(this, "x0", 0)) > t.column_shift, "column_change")
            .when((gap < t.least_gap) | (gap > F.greatest(F.coalesce(prev("size"), F.lit(t.gap_size)) * t.gap_ratio, F.lit(t.gap_floor))), "large_gap")
            .when(both("toc"), F.when(short, "toc_short_lines").when(font, "toc_font_match").otherwise("toc_break"))
            .when(both("list") & font, "list_continuation")
            .when(prev("kind") != this("kind"), "kind_change")
            .when(this("kind") == "heading", "heading")
            .when(flow & ends_mid_sentence(prev("text")), "mid_sentence")
            .when(flow & starts_continuation(this("text")), "continuation_start")
            .when(flow & short, "short_paragraph_lines")
            .otherwise("default_break"))


def in_order(doc: str = "doc_id") -> Window:
    return Window.partitionBy(doc).orderBy("page", F.coalesce("reading_order", "block_idx"), "ordinal")


def ready(blocks: DataFrame) -> DataFrame:
    """Blocks with the columns that order and compare them; what is missing is null."""
    for name, kind in (("reading_order", "int"), ("bbox", "array<double>"), ("font", "string"), ("size", "double")):
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast(kind))
    if "ordinal" not in blocks.columns:
        blocks = blocks.withColumn("ordinal", F.col("block_idx").cast("long"))
    return blocks


def with_reasons(blocks: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Blocks with ``kind`` and ``reason``, why they join the block before or don't; null for a document's first."""
    blocks = ready(blocks).withColumn("kind", block_kind(F.col("text"), F.col("size"), t))
    used = ["page", "text", "size", "font", "kind", "bbox"] + [c for c in ("x0", "y0", "y1") if c in blocks.columns]
    w = in_order()
    blocks = blocks.withColumn("_prev", F.lag(F.struct(*used)).over(w))
    none = F.lit(None).cast("double")
    prev = lambda n: F.col(f"_prev.{n}") if n in used else none
    this = lambda n: F.col(n) if n in used else none
    return blocks.withColumn("reason", F.when(F.col("_prev").isNotNull(), merge_reason(prev, this, t))).drop("_prev")


def segmented(blocks: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Blocks with ``segment_id`` (from 0 in each document) and whether they joined (``merged``)."""
    rows = with_reasons(blocks, t).withColumn("merged", F.coalesce(F.col("reason").isin(MERGES), F.lit(False)))
    breaks = F.sum((~F.col("merged")).cast("long")).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("segment_id", breaks - 1)


def segments(blocks: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """A row for each run: ``kind``, its blocks in order and the reasons of its merges."""
    rows = segmented(blocks, t)
    cells = [c for c in rows.columns if c not in ("doc_id", "segment_id", "kind", "merged")]
    place = [F.col("page"), F.coalesce("reading_order", "block_idx").alias("_ro"), F.col("ordinal").alias("_n")]
    grouped = rows.groupBy("doc_id", "segment_id").agg(
        F.first("kind").alias("kind"), F.sort_array(F.collect_list(F.struct(*place, F.struct(*cells).alias("block"), "merged"))).alias("rows"))
    return grouped.select("doc_id", "segment_id", "kind", F.col("rows.block").alias("blocks"),
                          F.transform(F.filter("rows", lambda r: r["merged"]), lambda r: r["block"]["reason"]).alias("merge_reasons"))


def segment_payload(blocks: Column, marker: str = "[[block {}]]") -> Column:
    """A marker line and the flattened text of every block; ``{}`` in the marker is the block's index."""
    before, after = marker.split("{}")
    cells = F.transform(blocks, lambda b, i: F.concat(F.lit(before), i.cast("string"), F.lit(after + "\n"), for_translation(b["text"], False)))
    return F.array_join(cells, "\n")


def debug_records(runs: DataFrame, strategy: Column | None = None, result: Column | None = None) -> DataFrame:
    """What is kept of each run for inspection."""
    preview = F.substring(F.array_join(F.transform("blocks", lambda b: normalize(F.coalesce(b["text"], F.lit("")))), " "), 1, 180)
    return runs.select(
        "doc_id", "segment_id", "kind", (strategy if strategy is not None else F.lit(None).cast("string")).alias("strategy"),
        (result if result is not None else F.lit(None).cast("string")).alias("result"),
        F.transform("blocks", lambda b: F.array(b["page"], b["block_idx"])).alias("block_refs"), "merge_reasons", preview.alias("source_preview"))
