"""Where translated text is set: neighbours, columns and their sizes, boxes and alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import geometry as g
from folioflow.functions.text import let, render_text
from folioflow.thresholds import DEFAULTS, Thresholds

PAGE = ["doc_id", "page"]


def with_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks of pages that exist, with ``page_x0`` to ``page_y1``."""
    return blocks.join(pages.select(*PAGE, "page_x0", "page_y0", "page_x1", "page_y1"), PAGE)


def page_width() -> Column:
    return F.col("page_x1") - F.col("page_x0")


def page_height() -> Column:
    return F.col("page_y1") - F.col("page_y0")


def decorated(blocks: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Blocks with ``decorative``."""
    return blocks.withColumn("decorative", g.is_decorative(F.col("text"), F.col("segment_kind"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"),
                                                           page_width(), page_height(), t))


def by_page(blocks: DataFrame) -> DataFrame:
    """A row for each page: ``cells``, its blocks as structs ``b`` in the order of left edge and block number.

    All that depends on a page's other blocks is worked out on this array, so a page is shuffled once.
    """
    cell = F.struct(F.col("x0").cast("double").alias("_x"), F.col("block_idx").alias("_i"), F.struct(*(F.col(f"`{c}`") for c in blocks.columns)).alias("b"))
    pages = blocks.groupBy(*PAGE).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    return pages.select(*PAGE, F.transform("cells", lambda c: c["b"]).alias("cells"))


def _neighbor(b: Column, cells: Column, t: Thresholds) -> Column:
    beside = lambda p: ~p["decorative"] & (p["x0"] > b["x0"] + t.neighbor_gap) & g.overlaps(b["y0"], b["y1"], p["y0"], p["y1"], t.overlap_ratio)
    return F.array_min(F.transform(F.filter(cells, beside), lambda p: p["x0"]))


def right_neighbors(blocks: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Blocks with ``decorative`` and ``neighbor_x0``, the nearest left edge of a block beside them on the right, null without one."""
    pages = by_page(decorated(blocks, t))
    cells = F.transform("cells", lambda b: F.struct(b.alias("b"), _neighbor(b, F.col("cells"), t).alias("neighbor_x0")))
    return pages.select(F.explode(cells).alias("c")).select("c.b.*", "c.neighbor_x0")


def adjusted(blocks: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Blocks with ``adjusted_x1`` and ``align``; only paragraphs are widened."""
    right = g.widened_right(F.col("x0"), F.col("x1"), F.col("page_x0"), F.col("page_x1"), F.col("neighbor_x0"), t)
    rows = blocks.withColumn("adjusted_x1", F.when(F.col("segment_kind") == "paragraph", right).otherwise(F.col("x1").cast("double")))
    return rows.withColumn("align", g.alignment(F.col("segment_kind"), F.col("neighbor_x0").isNotNull(), F.col("adjusted_x1") - F.col("x0"), page_width(), t))


def _columns(cells: Column, t: Thresholds) -> Column:
    """The number of the column of each cell.

    In order of the left edge a cell joins the first column whose first member is near in left edge and width.
    That depends on earlier choices, so it is a fold over the page's sorted cells.
    """
    places = F.transform(cells, lambda b: F.struct(b["x0"].cast("double").alias("x"), F.greatest(F.lit(1.0), b["width"].cast("double")).alias("w")))
    zero = F.expr("named_struct('anchors', CAST(array() AS array<struct<x: double, w: double>>), 'groups', CAST(array() AS array<bigint>))")

    def step(acc, c):
        fits = lambda a: (F.abs(c["x"] - a["x"]) <= t.column_x) & (F.abs(c["w"] - a["w"]) / F.greatest(c["w"], a["w"]) <= t.column_width)
        return let(F.array_position(F.transform(acc["anchors"], fits), F.lit(True)), lambda at: F.struct(
            F.when(at > 0, acc["anchors"]).otherwise(F.concat(acc["anchors"], F.array(c))).alias("anchors"),
            F.concat(acc["groups"], F.array(F.when(at > 0, at - 1).otherwise(F.size(acc["anchors"]).cast("long")))).alias("groups")))

    return F.aggregate(places, zero, step, lambda acc: acc["groups"])


def percentile_of(values: Column, share: float) -> Column:
    """The percentile of the numbers in an array, interpolated; nulls aside, null without any."""
    def pick(v):
        place = F.lit(share) * (F.size(v) - 1)
        low, high = F.element_at(v, F.floor(place).cast("int") + 1), F.element_at(v, F.ceil(place).cast("int") + 1)
        return F.when(F.size(v) > 0, low + (high - low) * (place - F.floor(place)))

    return let(F.sort_array(F.filter(values, lambda x: x.isNotNull())), pick)


def _column_cells(cells: Column, t: Thresholds, percentile: float) -> Column:
    """The body paragraphs of a page with ``col_group`` and ``target_size``, as structs with the cell ``b``."""
    share = max(0.0, min(1.0, percentile))

    def sized(known):
        sizes = lambda i: F.transform(F.filter(F.arrays_zip(known["c"].alias("b"), known["g"].alias("g")), lambda z: z["g"] == i), lambda z: z["b"]["size"].cast("double"))
        targets = F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce(F.array_max(known["g"]), F.lit(0))), lambda i: percentile_of(sizes(i), share))
        return let(F.struct(known["c"].alias("c"), known["g"].alias("g"), targets.alias("s")), lambda k: F.transform(
            F.arrays_zip(k["c"].alias("b"), k["g"].alias("g")),
            lambda z: F.struct(z["b"].alias("b"), z["g"].alias("col_group"), F.element_at(k["s"], z["g"].cast("int") + 1).alias("target_size"))))

    return let(F.filter(cells, lambda b: F.coalesce(b["_body"], F.lit(False))), lambda body: let(F.struct(body.alias("c"), _columns(body, t).alias("g")), sized))


def with_body(blocks: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    return blocks.withColumn("_body", g.is_body(F.col("segment_kind"), F.col("text"), F.col("line_count"), F.col("width"), F.col("size"), page_width(), page_height(), t))


def body_columns(blocks: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Body paragraphs with ``col_group``, the number of their column on the page, and ``target_size``, the percentile of its sizes."""
    pages = by_page(with_body(blocks, t).where("_body"))
    return pages.select(F.explode(_column_cells(F.col("cells"), t, t.column_percentile)).alias("c")).select("c.b.*", "c.col_group", "c.target_size").drop("_body")


def column_groups(blocks: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """The keys of body paragraphs with ``col_group``."""
    return body_columns(blocks, t).select(*PAGE, "block_idx", "col_group")


def column_sizes(rows: DataFrame, group: list[str], percentile: float = DEFAULTS.column_percentile, size: str = "size") -> DataFrame:
    """Rows with ``target_size``: the percentile of the sizes of their group, interpolated."""
    share = max(0.0, min(1.0, percentile))
    return rows.withColumn("target_size", F.percentile(F.col(size).cast("double"), F.lit(share)).over(Window.partitionBy(*group)))


def width_model(text: str, width: float, height: float, size: float) -> bool:
    """Whether text fits a box, if a character is half as wide as the size, or as wide beyond Latin, and lines are 1.2 sizes apart."""
    lines = 0
    for line in text.split("\n"):
        wide = sum(ord(c) > 0x2E7F for c in line)
        lines += max(1, -(-((wide + (len(line) - wide) / 2) * size) // width) if width > 0 else 10**9)
    return lines * size * 1.2 <= height


def native_size(text: Column, width: Column, height: Column, size: Column, t: Thresholds = DEFAULTS) -> Column:
    """``best_size`` with the width model as columns: lines are measured once, then the range is halved in a fold."""
    units = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: (F.length(x) + F.length(F.regexp_replace(x, r"[\x00-\x{2E7F}]", ""))) / 2.0)

    def search(k):
        lines = lambda mid: F.aggregate(k["u"], F.lit(0.0), lambda a, u: a + F.when(k["w"] > 0, F.greatest(F.lit(1.0), F.ceil(u * mid / k["w"]).cast("double"))).otherwise(1e9))
        zero = F.struct(F.lit(t.least_size).alias("low"), (k["s"] * t.size_headroom).alias("high"), F.lit(t.least_size).alias("best"))

        def step(acc, _):
            return let((acc["low"] + acc["high"]) / 2, lambda mid: let(lines(mid) * mid * 1.2 <= k["h"], lambda ok: F.struct(
                F.when(ok, mid + t.fit_delta).otherwise(acc["low"]).alias("low"), F.when(ok, acc["high"]).otherwise(mid - t.fit_delta).alias("high"),
                F.when(ok, mid).otherwise(acc["best"]).alias("best"))))

        return F.when(k["s"] <= t.least_size, k["s"]).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(t.fit_steps)), zero, step, lambda acc: acc["best"]))

    return let(F.struct(units.alias("u"), width.alias("w"), height.alias("h"), size.cast("double").alias("s")), search)


def best_size(text: str, width: float, height: float, size: float, fits: Callable[[str, float, float, float], bool], t: Thresholds = DEFAULTS) -> float:
    """The largest size found to fit by halving the range from the least size to a little above the given one."""
    if size <= t.least_size:
        return size
    low, high, best = t.least_size, size * t.size_headroom, t.least_size
    for _ in range(t.fit_steps):
        mid = (low + high) / 2
        if fits(text, width, height, mid):
            best, low = mid, mid + t.fit_delta
        else:
            high = mid - t.fit_delta
    return best


def fitted(rows: DataFrame, fits: Callable[[str, float, float, float], bool] | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """Rows with ``font_size``; ``fits`` is any function of text, width, height and size, which takes a pandas UDF; without it columns do."""
    width, height, size = F.col("set_x1") - F.col("set_x0"), F.col("set_y1") - F.col("set_y0"), F.col("target_size").cast("double")
    if fits is None:
        return rows.withColumn("font_size", native_size(F.col("set_text"), width, height, size, t))

    @F.pandas_udf("double")
    def search(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, width, height, size in parts:
            yield pd.Series([best_size(x or "", w, h, s, fits, t) for x, w, h, s in zip(text, width, height, size)], dtype="float64")

    return rows.withColumn("font_size", search("set_text", width, height, size))


def render_plan(blocks: DataFrame, pages: DataFrame, fits: Callable[[str, float, float, float], bool] | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """For every translated block: the box, the text as set, its size, alignment and colour."""
    grouped = by_page(with_body(decorated(with_pages(blocks, pages), t), t))
    sizes = F.transform(_column_cells(F.col("cells"), t, t.column_percentile), lambda c: F.struct(c["b"]["block_idx"].alias("i"), c["target_size"].alias("s")))
    grouped = grouped.select("cells", F.map_from_entries(F.filter(sizes, lambda x: x["i"].isNotNull())).alias("sizes"))
    cells = F.transform("cells", lambda b: F.struct(b.alias("b"), _neighbor(b, F.col("cells"), t).alias("neighbor_x0"), F.try_element_at("sizes", b["block_idx"]).alias("_column")))
    placed = adjusted(grouped.select(F.explode(cells).alias("c")).select("c.b.*", "c.neighbor_x0", "c._column"), t)
    placed = placed.withColumn("target_size", F.least(F.col("size").cast("double"), F.coalesce("_column", F.col("size").cast("double"))))
    top, bottom = g.padded(F.col("segment_kind"), F.col("target_size"), F.col("y0"), F.col("y1"), F.col("page_y0"), F.col("page_y1"), t)
    placed = placed.withColumns({"set_x0": F.col("x0").cast("double"), "set_y0": top, "set_x1": F.col("adjusted_x1"), "set_y1": bottom,
                                 "set_text": render_text(F.col("text"), F.coalesce("segment_kind", F.lit("")))})
    color = [F.col("color")] if "color" in blocks.columns else [F.lit(None).cast("array<double>").alias("color")]
    return fitted(placed, fits, t).select(*PAGE, "block_idx", "set_x0", "set_y0", "set_x1", "set_y1", "set_text", "target_size", "font_size", "align", *color)
