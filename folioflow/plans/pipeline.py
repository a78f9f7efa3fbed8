"""From documents to a layout plan of their translation."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.config import Options, elapsed_text, parse_pages
from folioflow.operators import layout, merge, requests, translate
from folioflow.operators.segments import ready
from folioflow.plans.staging import settled
from folioflow.thresholds import DEFAULTS, Thresholds

log = logging.getLogger(__name__)


@dataclass
class Result:
    """Blocks, what was recorded of pages or segments, and the number of translated blocks; only statistics if just these are asked for."""

    blocks: DataFrame | None
    records: DataFrame
    translated: int = 0
    seconds: float = 0.0
    calls: DataFrame | None = None
    #: In page mode, what became of each document.
    outcomes: DataFrame | None = None


def _merged(blocks: DataFrame, translated: DataFrame) -> DataFrame:
    return merge.merge_results(blocks, translated.select(*merge.KEYS, F.col("text").alias("translated"), "segment_kind"))


def translate_documents(blocks: DataFrame, translator, options: Options, t: Thresholds = DEFAULTS, pause: float = translate.PAUSE) -> Result:
    """Blocks of any number of documents, by pages or by segments as the options say."""
    began, calls, outcomes = time.monotonic(), None, None
    blocks = ready(requests.select_pages(blocks, parse_pages(options.llm.target_pages)))
    if options.engine == "llm" and options.llm.page_stats_only:
        limit = max(t.least_input_chars, options.llm.page_max_chars)
        return Result(None, requests.page_stats(blocks, limit, options.llm.max_tokens, t))
    if options.engine == "llm" and options.llm.translate_mode == "page":
        out, records, outcomes, calls = translate.by_pages(blocks, translator, options, t, pause)
        if options.on_page_failure == "segment":
            failed = outcomes.where(F.col("status").isin(*translate.FAILED)).select("doc_id")
            if not failed.isEmpty():
                again, _ = translate.by_segments(blocks.join(failed, "doc_id", "left_semi"), translator, options, t, pause=pause)
                kept = out.join(failed, "doc_id", "left_anti")
                out = kept.unionByName(_merged(blocks.join(failed, "doc_id", "left_semi"), again))
    else:
        out, records = translate.by_segments(blocks, translator, options, t, pause=pause)
        out = _merged(blocks, out)
    out = settled(out)
    count = merge.translated_count(out).first()["translated"]
    seconds = time.monotonic() - began
    log.info("translated %d blocks in %s", count, elapsed_text(seconds))
    return Result(out, records, count, seconds, calls, outcomes)


def run(blocks: DataFrame, pages: DataFrame, translator, options: Options, t: Thresholds = DEFAULTS, pause: float = translate.PAUSE):
    """The translated blocks and, for each of them, where and how large its text is set."""
    result = translate_documents(blocks, translator, options, t, pause)
    return result, layout.render_plan(result.blocks, pages, t=t) if result.blocks is not None else None


def segment_mode(options: Options) -> Options:
    return replace(options, llm=replace(options.llm, translate_mode="segment"))
