"""Blocks as JSON: one array for each document, as other programs exchange them, or lines at scale."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REALS = T.ArrayType(T.DoubleType())


def _fields(kinds: dict) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for kind, names in kinds.items() for name in names.split()])


SPAN = _fields({T.StringType(): "text font", T.DoubleType(): "size", T.IntegerType(): "color"})
LINE = T.StructType([T.StructField("bbox", REALS), T.StructField("spans", T.ArrayType(SPAN))])
RAW = T.StructType([T.StructField("doc_id", T.StringType()), *_fields({T.IntegerType(): "page block_no type"}), T.StructField("bbox", REALS), T.StructField("lines", T.ArrayType(LINE))])
BLOCK = T.StructType([*_fields({T.IntegerType(): "page block_idx"}), T.StructField("bbox", REALS), T.StructField("text", T.StringType()), T.StructField("size", T.DoubleType()),
                      T.StructField("color", REALS), T.StructField("font", T.StringType()), *_fields({T.DoubleType(): "x0 y0 x1 y1 width height"}),
                      *_fields({T.IntegerType(): "line_count reading_order"})])
TRANSLATED = T.StructType([*BLOCK.fields, T.StructField("original_text", T.StringType()), T.StructField("segment_kind", T.StringType())])


def read_blocks(spark: SparkSession, path: str, translated: bool = False) -> DataFrame:
    """Blocks of the JSON arrays below ``path``; ``doc_id`` is the file, ``ordinal`` the place in its array.

    A file that isn't an array of blocks is an error.
    """
    return blocks_of(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), "value"), translated)


def arrays_of(blocks: DataFrame, order: str = "ordinal") -> DataFrame:
    """``doc_id`` and ``value``, a document's blocks as one array of JSON; a document must fit in a row."""
    cells = F.struct(*(f.name for f in TRANSLATED if f.name in blocks.columns))
    rows = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(order, cells.alias("b")))).alias("rows"))
    return rows.select("doc_id", F.to_json("rows.b").alias("value"))


def blocks_of(arrays: DataFrame, translated: bool = False) -> DataFrame:
    """The blocks of such arrays; a value that is no array of blocks is an error."""
    schema = T.ArrayType(TRANSLATED if translated else BLOCK)
    files = arrays.select("doc_id", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("rows"))
    return files.select("doc_id", F.posexplode("rows").alias("ordinal", "b")).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "b.*")


def write_blocks(blocks: DataFrame, path: str) -> None:
    """At scale: a line of JSON for each block, by document."""
    blocks.write.partitionBy("doc_id").mode("overwrite").json(path)


def export_array(blocks: DataFrame, path: str, order: str = "ordinal") -> None:
    """One document as a readable JSON array in a local file."""
    names = [f.name for f in TRANSLATED if f.name in blocks.columns]
    rows = [r.asDict(recursive=True) for r in blocks.orderBy(order).select(*names).toLocalIterator()]
    with open(path, "w", encoding="utf-8") as out:
        json.dump(rows, out, ensure_ascii=False, indent=2)


def count_items(path: str) -> int | None:
    """Length of the JSON array in a local file; null if it can't be read."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return None
    return len(found) if isinstance(found, list) else None
