"""One PDF file in, one out; the command line.

``python -m folioflow.plans.files source.pdf [output.pdf] --engine llm`` reads settings from the environment and from settings files first.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import time
from dataclasses import dataclass, fields
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import config
from folioflow.functions.config import LlmOptions, Options, elapsed_text
from folioflow.operators.paragraphs import extract_blocks
from folioflow.plans import pipeline
from folioflow.plans.staging import settled
from folioflow.sources import blocks as json_blocks
from folioflow.sources import pdf
from folioflow.sources.translators import GoogleClient, LlmClient

log = logging.getLogger(__name__)


@dataclass
class Summary:
    output: str | None
    extracted: int
    translated: int
    seconds: dict[str, float]
    stats: DataFrame | None = None


def working_files(source: str) -> list[Path]:
    """Where extracted blocks, translated blocks and records go while a file is worked on."""
    path = Path(source)
    return [path.with_name(f"{path.stem}_{kind}.json") for kind in ("extracted_text", "translated_text", "segment_debug")]


def debug_record(options: Options, result: pipeline.Result | None = None, failure: str | None = None) -> dict:
    """What is kept of a run on one document, in four shapes: statistics only, pages translated, pages failed, segments."""
    pages = options.engine == "llm" and options.llm.translate_mode == "page"
    rows = [r.asDict(recursive=True) for r in result.records.toLocalIterator()] if result is not None else []
    out = {"segment_debug": [] if pages or options.llm.page_stats_only else rows, "engine": options.engine, "workers": 1 if pages else options.workers,
           "llm_translate_mode": options.llm.translate_mode, "llm_target_pages": config.parse_pages(options.llm.target_pages)}
    if result is not None and result.blocks is None:
        return out | {"llm_page_stats_only": True, "llm_page_stats": rows}
    if options.engine == "llm" and failure is None:
        kept = ("model", "base_url", "temperature", "max_tokens")
        out["llm"] = {k: getattr(options.llm, k) for k in kept} | {"max_workers": out["workers"]}
    if pages:
        done = result.outcomes.first().asDict() if result is not None and result.outcomes is not None else {}
        out["llm_page"] = done | {"page_summaries": rows}
    if failure is not None:
        out["failure"] = {"stage": "page_mode", "message": failure}
    return out


def translate_file(spark: SparkSession, source: str, translator, options: Options, output: str | None = None, parse=pdf.parse_pdf, write=None,
                   page_sizes=None) -> Summary:
    """Extract, translate, plan and write one file; the working files stay only if the options keep them.

    ``page_sizes`` gives (page, x0, y0, x1, y1) of the source's bytes. With page statistics only, nothing is written.
    """
    if not Path(source).is_file():
        raise FileNotFoundError(source)
    write = write or partial(pdf.write_pdf, font_file=options.font_file)
    content, seconds, began = Path(source).read_bytes(), {}, time.monotonic()
    output = output or config.output_path(source, options.engine)
    extracted, translated, records = working_files(source)

    def lap(name: str) -> None:
        nonlocal began
        seconds[name], began = time.monotonic() - began, time.monotonic()

    blocks = settled(extract_blocks(pdf.read_raw(spark, source, parse)).withColumn("ordinal", F.monotonically_increasing_id()))
    json_blocks.export_array(blocks, str(extracted))
    count = json_blocks.count_items(str(extracted)) or 0
    lap("extract")
    note = lambda *known: records.write_text(json.dumps(debug_record(options, *known), ensure_ascii=False, indent=2), encoding="utf-8") if options.keep_debug else None
    try:
        result = pipeline.translate_documents(blocks, translator, options)
    except RuntimeError as e:
        note(None, str(e))
        raise
    note(result)
    if result.blocks is None:
        return Summary(None, count, 0, seconds, result.records)
    json_blocks.export_array(result.blocks, str(translated))
    lap("translate")
    sizes = (page_sizes or sizes_of)(content)
    doc = blocks.select("doc_id").first()
    rows = [(doc["doc_id"] if doc else source, *s) for s in sizes]
    pages = spark.createDataFrame(rows, "doc_id string, page int, page_x0 double, page_y0 double, page_x1 double, page_y1 double")
    plan = pipeline.layout.render_plan(result.blocks, pages).join(blocks.select("doc_id", "page", "block_idx", "bbox"), ["doc_id", "page", "block_idx"])
    Path(output).write_bytes(write(content, [r.asDict(recursive=True) for r in plan.orderBy("page", "block_idx").toLocalIterator()]))
    lap("generate")
    if not options.keep_debug:
        for path in (extracted, translated, records):
            path.unlink(missing_ok=True)
    log.info("%d of %d blocks translated; %s", result.translated, count, ", ".join(f"{k} {elapsed_text(v)}" for k, v in seconds.items()))
    return Summary(output, count, result.translated, seconds)


def sizes_of(content: bytes) -> list[tuple]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as file:
        return [(i, float(p.rect.x0), float(p.rect.y0), float(p.rect.x1), float(p.rect.y1)) for i, p in enumerate(file)]


def parser(environ=os.environ) -> argparse.ArgumentParser:
    """Options; each default is the environment's value of ``FOLIOFLOW_<NAME>``, if it has one."""
    out = argparse.ArgumentParser(description="Translate a PDF file and keep its layout.")
    out.add_argument("source")
    out.add_argument("output", nargs="?")
    out.add_argument("--engine", choices=("google", "llm"), default=environ.get("FOLIOFLOW_ENGINE", "google"))
    out.add_argument("--env-file")
    out.add_argument("--debug", action=argparse.BooleanOptionalAction, default=config.switch("FOLIOFLOW_DEBUG", environ=environ))
    out.add_argument("--font-file", default=environ.get("FOLIOFLOW_FONT_FILE"))
    out.add_argument("--google-max-workers", type=int, default=int(environ.get("FOLIOFLOW_GOOGLE_MAX_WORKERS", 8)))
    out.add_argument("--google-timeout", type=float, default=float(environ.get("FOLIOFLOW_GOOGLE_TIMEOUT", 30)))
    for f in fields(LlmOptions):
        name, set_to = f.name.upper(), environ.get(f"FOLIOFLOW_LLM_{f.name.upper()}")
        flag = f"--llm-{f.name.replace('_', '-')}"
        if isinstance(f.default, bool):
            out.add_argument(flag, action=argparse.BooleanOptionalAction, default=config.switch(f"FOLIOFLOW_LLM_{name}", default=f.default, environ=environ))
        else:
            kind = type(f.default) if f.default is not None else float
            out.add_argument(flag, type=kind, default=kind(set_to) if set_to is not None else f.default, choices=("page", "segment") if f.name == "translate_mode" else None)
    return out


def options_of(args: argparse.Namespace) -> Options:
    """Options of the arguments; a timeout of 0 means none."""
    llm = LlmOptions(**{f.name: getattr(args, f"llm_{f.name}") for f in fields(LlmOptions)} | {"timeout": args.llm_timeout or None})
    return Options(engine=args.engine, google_max_workers=args.google_max_workers, google_timeout=args.google_timeout, keep_debug=args.debug, font_file=args.font_file, llm=llm)


def main(argv: list[str]) -> int:
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    first = parser().parse_known_args(argv)[0]
    config.load_all_settings(first.source, first.env_file)
    args = parser().parse_args(argv)
    options = options_of(args)
    translator = LlmClient(options.llm) if options.engine == "llm" else GoogleClient(options.google_timeout)
    summary = translate_file(SparkSession.builder.getOrCreate(), args.source, translator, options, args.output)
    if summary.stats is not None:
        log.info("first page: %s", (first := summary.stats.orderBy("page").first()) and first.asDict())
        for row in summary.stats.orderBy("page").toLocalIterator():
            print(json.dumps(row.asDict(), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
