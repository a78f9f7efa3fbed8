"""Boxes on a page: overlap, decoration, body text, and the boxes that text is set into."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import let, render_text, strip
from folioflow.thresholds import DEFAULTS, Thresholds


def real(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def overlaps(y0: Column, y1: Column, other_y0: Column, other_y1: Column, ratio: float = DEFAULTS.overlap_ratio) -> Column:
    """Whether two boxes share enough height to stand side by side."""
    shared = F.least(y1, other_y1) - F.greatest(y0, other_y0)
    return (shared > 0) & (shared >= F.least(y1 - y0, other_y1 - other_y0) * ratio)


def is_decorative(text: Column, kind: Column, width: Column, height: Column, page_width: Column, page_height: Column, t: Thresholds = DEFAULTS) -> Column:
    """Few characters in a box that covers much of the page. Hardly a box does, so only then the text is cleaned to count them."""
    area = F.greatest(F.lit(1.0), real(page_width) * real(page_height))
    wide = real(width) * real(height) >= area * t.decorative_area
    tall = real(height) >= real(page_height) * t.decorative_height
    n = F.length(strip(render_text(text, F.coalesce(kind, F.lit("")))))
    few = let(n, lambda n: ((n <= t.decorative_chars) & wide) | ((n <= t.decorative_tall_chars) & tall))
    return F.when(wide | tall, few).otherwise(F.lit(False))


def body_size_limit(page_height: Column, t: Thresholds = DEFAULTS) -> Column:
    return F.greatest(F.lit(t.body_size_floor), real(page_height) * t.body_size_ratio)


def is_body(kind: Column, text: Column, line_count: Column, width: Column, size: Column, page_width: Column, page_height: Column,
            t: Thresholds = DEFAULTS) -> Column:
    """Paragraphs whose size is evened out over their column."""
    lines = F.greatest(F.lit(1), F.coalesce(line_count.cast("int"), F.lit(1)))
    box = ((F.coalesce(kind, F.lit("")) == "paragraph") & (lines >= t.body_lines)
           & (F.greatest(F.lit(0.0), real(width)) >= F.greatest(F.lit(1.0), real(page_width)) * t.body_width)
           & (F.greatest(F.lit(t.least_size), F.coalesce(real(size), F.lit(t.least_size))) <= body_size_limit(page_height, t)))
    return F.when(box, F.length(render_text(text, F.lit("paragraph"))) >= t.body_chars).otherwise(box)


def widened_right(x0: Column, x1: Column, page_x0: Column, page_x1: Column, neighbor_x0: Column, t: Thresholds = DEFAULTS) -> Column:
    """Right edge of a paragraph: widened up to the mirrored margin, or to before its neighbour; unchanged if that is too narrow."""
    x0, x1, page_x0, page_x1 = map(real, (x0, x1, page_x0, page_x1))
    margin = F.greatest(F.lit(t.right_margin), F.greatest(F.lit(0.0), x0 - page_x0))
    wide = F.least(page_x1 - margin, x0 + F.greatest((x1 - x0) * t.widen_ratio, (x1 - x0) + t.widen_by))
    bound = F.least(page_x1 - margin, real(neighbor_x0) - t.neighbor_padding)
    right = F.when(neighbor_x0.isNotNull(), F.least(wide, bound)).otherwise(wide)
    return F.when(right <= x0 + t.least_width, x1).otherwise(right)


def alignment(kind: Column, has_neighbor: Column, width: Column, page_width: Column, t: Thresholds = DEFAULTS) -> Column:
    """3 (justified) for a wide paragraph in a single column, else 0 (left)."""
    return F.when((kind == "paragraph") & ~has_neighbor & (real(width) >= real(page_width) * t.justify_width), 3).otherwise(0)


def padded(kind: Column, size: Column, y0: Column, y1: Column, page_y0: Column, page_y1: Column, t: Thresholds = DEFAULTS) -> tuple[Column, Column]:
    """Top and bottom with the room that a kind gets, inside the page."""
    y0, y1, page_y0, page_y1, size = map(real, (y0, y1, page_y0, page_y1, size))
    pad = lambda p: F.greatest(F.lit(p[1]), F.least(F.lit(p[2]), size * p[0]))
    room = F.when(kind == "paragraph", pad(t.paragraph_pad)).when(kind == "list", pad(t.list_pad))
    top, bottom = F.greatest(page_y0, y0 - room), F.least(page_y1, y1 + room)
    changed = room.isNotNull() & (bottom > top + t.least_height)
    return F.when(changed, top).otherwise(y0), F.when(changed, bottom).otherwise(y1)
