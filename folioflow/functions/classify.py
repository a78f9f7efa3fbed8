"""What a text block is: noise, toc, list, heading or paragraph; the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import WS, is_noise, let, normalize
from folioflow.thresholds import DEFAULTS, Thresholds


def is_toc(flat: Column, text: Column, t: Thresholds = DEFAULTS) -> Column:
    start = flat.rlike(r"\A(?:\p{Nd}|/|[A-Za-z])") & (F.length(flat) <= t.toc_text)
    return (flat != "") & (start | F.contains(F.lower(flat), F.lit("contents")) | F.contains(text, F.lit("\t")))


def is_list(flat: Column) -> Column:
    return flat.rlike(rf"\A(?:[-•]|\p{{Nd}}+[.)])[{WS}]+")


def is_heading(flat: Column, size: Column, t: Thresholds = DEFAULTS) -> Column:
    """Large and not like a sentence, or short and without lower case."""
    words = F.regexp_count(flat, F.lit(r"[\p{L}\p{N}_]+"))
    sentence = flat.rlike("[。！？!?.,;:—-]") | (F.length(flat) > t.short_text) | (words > t.heading_words)
    upper = (F.length(flat) <= t.heading_upper) & (flat == F.upper(flat)) & flat.rlike(r"\p{L}")
    return (flat != "") & (((F.coalesce(size, F.lit(0.0)) >= t.heading_size) & ~sentence) | upper)


def block_kind(text: Column, size: Column, t: Thresholds = DEFAULTS) -> Column:
    """``flat`` above is the text with single blanks; it is made once for all rules."""
    return F.when(is_noise(text), "noise").otherwise(let(normalize(text), lambda flat: F.when(is_toc(flat, text, t), "toc").when(
        is_list(flat), "list").when(is_heading(flat, size, t), "heading").otherwise("paragraph")))
