"""Translated text dealt back to the blocks that it came from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.functions.text import WS, let, normalize, split_lines, strip
from folioflow.thresholds import DEFAULTS, Thresholds


def capacity(text: Column, width: Column, size: Column, line_count: Column, t: Thresholds = DEFAULTS) -> Column:
    """How much text a block has room for, from its length and its box."""
    lines = F.greatest(F.lit(1), F.coalesce(line_count.cast("int"), F.lit(1)))
    room = F.greatest(F.lit(1.0), width.cast("double")) / F.greatest(F.lit(1.0), F.coalesce(size.cast("double"), F.lit(t.default_size))) * lines
    return F.greatest(F.lit(t.capacity_floor), F.length(normalize(F.coalesce(text, F.lit("")))) * t.capacity_text + room)


def split_marked(text: Column, expected: Column, marker: str = "[[block {}]]") -> Column:
    """The text after each marker line, in order of the markers' numbers; null unless 0 to n-1 are all there and say something.

    Text before the first marker is passed over; of a repeated marker the last counts.
    """
    before, after = (part.replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("(", "\\(").replace(")", "\\)") for part in marker.split("{}"))
    pattern = f"\\A{before}(\\p{{Nd}}+){after}\\z"
    lines = F.transform(split_lines(text), lambda x: F.struct(x.alias("line"), F.regexp_extract(strip(x), pattern, 1).alias("mark")))
    zero = F.expr("named_struct('at', CAST(NULL AS BIGINT), 'parts', map_from_arrays(CAST(array() AS array<bigint>), CAST(array() AS array<string>)))")

    def step(acc, x):
        number = x["mark"].cast("long")
        fresh = F.map_concat(F.map_filter(acc["parts"], lambda k, v: k != number), F.create_map(number, F.lit("")))
        grown = F.transform_values(acc["parts"], lambda k, v: F.when(k == acc["at"], F.concat(v, F.lit("\n"), x["line"])).otherwise(v))
        return F.struct(F.when(x["mark"] != "", number).otherwise(acc["at"]).alias("at"),
                        F.when(x["mark"] != "", fresh).when(acc["at"].isNull(), acc["parts"]).otherwise(grown).alias("parts"))

    parts = F.transform_values(F.aggregate(lines, zero, step, lambda acc: acc["parts"]), lambda k, v: strip(v))
    wanted = F.transform(F.sequence(F.lit(0).cast("long"), expected.cast("long") - 1), lambda i: F.try_element_at(parts, i))
    full = (F.size(parts) == expected) & ~F.exists(wanted, lambda v: v.isNull() | (v == ""))
    return F.when((expected > 0) & full, wanted)


def deal_chunks(chunks: Column, capacities: Column) -> Column:
    """A text for each block from chunks in order, by the blocks' shares of the capacity; null if there are too few.

    Fewer chunks than blocks are first split after commas. Every block gets one chunk at least, the last the rest.
    """
    finer = F.flatten(F.transform(chunks, lambda c: _pieces(c)))
    pieces = F.when(F.size(chunks) < F.size(capacities), finer).otherwise(chunks)
    return let(F.struct(pieces.alias("p"), capacities.alias("c"), F.aggregate(capacities, F.lit(0.0), lambda a, c: a + c).alias("all")), _dealt)


def _dealt(known: Column) -> Column:
    pieces, shares, total = known["p"], known["c"], known["all"]
    n, m = F.size(pieces), F.size(shares)
    zero = F.expr("named_struct('at', 0, 'texts', CAST(array() AS array<string>))")

    def step(acc, x):
        left, blocks = n - acc["at"], m - F.size(acc["texts"])
        want = F.floor(F.greatest(F.lit(1.0), n * (x / total))).cast("int")
        take = F.when(blocks == 1, left).otherwise(F.greatest(F.lit(1), F.least(left - blocks + 1, want)))
        return let(take, lambda k: F.struct((acc["at"] + k).alias("at"), F.concat(acc["texts"], F.array(
            strip(F.array_join(F.slice(pieces, acc["at"] + 1, k), " ")))).alias("texts")))

    dealt = F.when((n > 0) & (n >= m), F.aggregate(shares, zero, step, lambda acc: acc["texts"]))
    return let(dealt, lambda texts: F.when(~F.exists(texts, lambda v: v == ""), texts))


def _pieces(chunk: Column) -> Column:
    parts = F.filter(F.transform(F.split(chunk, rf"(?<=[、，,])[{WS}]+", -1), strip), lambda p: p != "")
    return let(parts, lambda p: F.when(F.size(p) >= 2, p).otherwise(F.array(chunk)))
