"""Text blocks from the lines and spans that a page parser reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import WS, strip
from folioflow.thresholds import DEFAULTS, Thresholds

#: Marks that stand alone before a list item; ends of a sentence.
BULLETS = ["•", "-", "*", "・"]
SENTENCE_ENDS = "[.!?:;。！？]"


def line_text(line: Column) -> Column:
    return F.array_join(F.transform(line["spans"], lambda s: F.coalesce(s["text"], F.lit(""))), "")


def leading_span(line: Column) -> Column:
    """The first span that says something, else the first."""
    said = F.filter(line["spans"], lambda s: strip(F.coalesce(s["text"], F.lit(""))) != "")
    return F.coalesce(F.try_element_at(said, F.lit(1)), F.try_element_at(line["spans"], F.lit(1)))


def paragraph_groups(lines: str = "lines", t: Thresholds = DEFAULTS) -> Column:
    """Lines in groups: a blank line ends one, and so does an indent after a finished sentence.

    An indent counts against the line before and against the group's least one, which starts anew with each group, so
    this is a fold. Lines without spans are passed over. A line without a box is at 0.
    """
    joined = "array_join(transform(x.spans, s -> coalesce(s.text, '')), '')"
    ws = WS.replace("\\", "\\\\")
    clean = lambda e: f"regexp_replace({e}, '\\\\A[{ws}]+|[{ws}]+\\\\z', '')"
    bullets = ", ".join(f"'{b}'" for b in BULLETS)
    facts = (f"transform(filter({lines}, l -> coalesce(size(l.spans), 0) > 0), x -> named_struct('line', x, 'text', {joined}, "
             "'x0', coalesce(try_element_at(x.bbox, 1), 0D)))")
    none = f"filter({lines}, l -> false)"
    blank = f"{clean('y.text')} = ''"
    indent = f"(y.x0 - acc.prev.x0 >= {t.indent_split} OR y.x0 - acc.least >= {t.indent_split})"
    ends = f"{clean('acc.prev.text')} RLIKE '{SENTENCE_ENDS}\\\\z'"
    split = f"(size(acc.open) > 0 AND {indent} AND {ends} AND NOT {clean('acc.prev.text')} IN ({bullets}) AND NOT {clean('y.text')} IN ({bullets}))"
    closed = "IF(size(acc.open) > 0, concat(acc.done, array(acc.open)), acc.done)"
    zero = f"named_struct('done', filter(array({none}), g -> false), 'open', {none}, 'least', CAST(NULL AS DOUBLE), 'prev', named_struct('x0', CAST(NULL AS DOUBLE), 'text', CAST(NULL AS STRING)))"
    step = (f"IF({blank}, named_struct('done', {closed}, 'open', {none}, 'least', CAST(NULL AS DOUBLE), 'prev', named_struct('x0', CAST(NULL AS DOUBLE), 'text', CAST(NULL AS STRING))), "
            f"IF({split}, named_struct('done', {closed}, 'open', array(y.line), 'least', y.x0, 'prev', named_struct('x0', y.x0, 'text', y.text)), "
            "named_struct('done', acc.done, 'open', concat(acc.open, array(y.line)), 'least', least(acc.least, y.x0), 'prev', named_struct('x0', y.x0, 'text', y.text))))")
    return F.expr(f"aggregate({facts}, {zero}, (acc, y) -> {step}, acc -> {closed})")


def box_of(lines: Column, fallback: Column) -> list[Column]:
    """Least and greatest edges of the lines; a line without a box has its block's."""
    edge = lambda i: F.transform(lines, lambda l: F.coalesce(F.try_element_at(l["bbox"], F.lit(i)), F.try_element_at(fallback, F.lit(i))))
    return [F.array_min(edge(1)), F.array_min(edge(2)), F.array_max(edge(3)), F.array_max(edge(4))]


def extract_blocks(raw: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Text blocks from raw ones: ``doc_id, page, block_no, type, bbox, lines``.

    Only blocks of type 0 with lines count; groups without text are dropped; ``block_idx`` numbers a page's blocks from 0.
    """
    kept = raw.where((F.col("type") == 0) & (F.size("lines") > 0))
    groups = kept.select("doc_id", "page", "block_no", "bbox", F.posexplode(paragraph_groups("lines", t)).alias("group_no", "group"))
    said = F.filter("group", lambda l: strip(line_text(l)) != "")
    spans = F.filter(F.transform("group", leading_span), lambda s: s.isNotNull())
    first = F.try_element_at(spans, F.lit(1))
    x0, y0, x1, y1 = box_of(F.col("group"), F.col("bbox"))
    rgb = F.coalesce(first["color"], F.lit(0)).cast("int")
    part = lambda shift: F.shiftright(rgb, shift).bitwiseAND(F.lit(255)) / 255.0
    rows = groups.select(
        "doc_id", "page", "block_no", "group_no", F.array_join(F.transform(said, line_text), "\n").alias("text"),
        F.coalesce(first["size"], F.lit(t.default_size)).alias("size"), F.array(part(16), part(8), part(0)).alias("color"),
        F.coalesce(first["font"], F.lit(t.default_font)).alias("font"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"),
        F.size(said).alias("line_count")).where(F.regexp_replace("text", f"[{WS}]+", "") != "")
    order = Window.partitionBy("doc_id", "page").orderBy("block_no", "group_no")
    rows = rows.withColumn("block_idx", F.row_number().over(order) - 1)
    return rows.select("doc_id", "page", "block_idx", F.array("x0", "y0", "x1", "y1").alias("bbox"), "text", "size", "color", "font", "x0", "y0", "x1", "y1",
                       (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), "line_count",
                       F.col("block_idx").alias("reading_order"))
