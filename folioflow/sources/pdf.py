"""PDF files in and out, where a PDF library is installed."""

from __future__ import annotations

import importlib.util
from collections import defaultdict
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.blocks import RAW


def available() -> bool:
    return importlib.util.find_spec("fitz") is not None


def parse_pdf(content: bytes) -> Iterator[dict]:
    """Raw blocks of every page."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as pdf:
        for number, page in enumerate(pdf):
            for i, block in enumerate(page.get_text("dict")["blocks"]):
                yield {"page": number, "block_no": i, "type": block.get("type"), "bbox": list(block.get("bbox") or ()), "lines": [
                    {"bbox": list(x.get("bbox") or ()), "spans": [{k: s.get(k) for k in ("text", "font", "size", "color")} for s in x.get("spans", ())]}
                    for x in block.get("lines", ())]}


def read_raw(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[dict]] = parse_pdf) -> DataFrame:
    """Raw blocks of the PDF files below ``path``; ``parse`` runs on the executors."""
    if "://" not in path and not any(c in path for c in "*?[") and not Path(path).exists():
        raise FileNotFoundError(path)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in RAW]
        for part in parts:
            for doc_id, content in zip(part["doc_id"], part["content"]):
                yield pd.DataFrame([{"doc_id": doc_id, **b} for b in parse(bytes(content))], columns=names)

    return files.mapInPandas(run, RAW)


def font_of(file: str | None) -> dict:
    """How the PDF library is told the font: a file that is there, or its own font for ideographs."""
    return {"fontname": "given", "fontfile": file} if file and Path(file).is_file() else {"fontname": "cjk"}


def write_pdf(source: bytes, plan: list[dict], font_file: str | None = None) -> bytes:
    """The source with the text of the planned boxes replaced."""
    import fitz

    by_page, font = defaultdict(list), font_of(font_file)
    for r in plan:
        by_page[r["page"]].append(r)
    with fitz.open(stream=source, filetype="pdf") as pdf:
        for number, page in enumerate(pdf):
            rows = by_page[number]
            for r in rows:
                page.add_redact_annot(fitz.Rect(r["bbox"]), fill=False)
            page.apply_redactions(images=0, graphics=0)
            for r in rows:
                box = fitz.Rect(r["set_x0"], r["set_y0"], r["set_x1"], r["set_y1"])
                page.insert_textbox(box, r["set_text"], **font, fontsize=r["font_size"], color=tuple(r["color"] or (0, 0, 0)), align=r["align"])
        return pdf.tobytes(garbage=3, deflate=True)


def write_documents(plan: DataFrame, files: DataFrame, write: Callable[[bytes, list[dict]], bytes] = write_pdf) -> DataFrame:
    """``doc_id`` and ``content`` of the new PDF files; one document is in memory at a time."""
    cells = plan.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in plan.columns if c != "doc_id"])).alias("plan"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [write(bytes(c), [dict(r) if isinstance(r, dict) else r.asDict() for r in (p if p is not None else [])]) for c, p in zip(part["content"], part["plan"])]
            yield pd.DataFrame({"doc_id": part["doc_id"], "content": made})

    return files.join(cells, "doc_id", "left").select("doc_id", "content", "plan").mapInPandas(run, "doc_id string, content binary")
