"""Documents that hold benchmark items, verbatim or with other parameters.

Words are stripped of punctuation and put in lower case. Windows of ``WINDOW`` words are hashed in up to three
readings: as they are; as a template with numbers and units of measure replaced by typed placeholders; and with
capitalised words replaced by a name placeholder as well. Only windows with at least ``LITERAL`` plain words are read as
templates. Items and documents are joined on the hashes. The templates that an item and a document share at one
distance from each other must fill the slots consistently: the same value of the item always becomes the same value
of the document, and different names become different names. Templates with a slot that conflicts don't count; windows found
as they are have no slots and always do. An item is in a document if its windows found that way
reach the share ``SIMILARITY`` of all its windows, also those that no template is made of: an item that is mostly
numbers or names is found as it is only. An item of fewer than ``WINDOW`` words has one window, all of its words, and is found wherever these
words stand in a row.

A bitmap of bounded size over the items' window hashes keeps most windows of clean documents out of the shuffle; where
many items fill it up, more windows are shuffled and none is missed. Spark chooses the join by the items' size.

Defined results: null texts have no words; items without words are found nowhere; a text of any length is read whole, and its rows
leave the task a few thousand at a time; an item found several times in a document gives one row;
rows with equal doc_id are one document; rows with a null doc_id or item_id give no rows; tables without rows give none.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioflow.llm import common
from folioflow.llm.common import BASES, Rolling, cut, map_arrow, memo, split, texts

WINDOW = 5
SIMILARITY = 0.8
LITERAL = 2
#: Words of 64 bits of the bitmap of window hashes.
BITMAP_WORDS = 1 << 18
MEMO = 400_000

#: Units of measure; a word counts as one right after a number.
UNITS = frozenset("""mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz ounce ounces lb lbs pound pounds
ml cl dl l litre litres liter liters gallon gallons pint pints cup cups s sec second seconds min minute minutes h hr hour hours day days week weeks month months
year years dollar dollars cent cents euro euros usd eur gbp yen percent degree degrees c f k kelvin celsius fahrenheit v volt volts a amp amps w watt
watts kw mw j joule joules n newton newtons pa hz khz mhz ghz mol b kb mb gb tb bit bits byte bytes mph kmh km/h m/s""".split())
PLAIN, NUMBER, UNIT, NAME, GONE, SEVERAL = range(6)

_strip = re.compile(r"^[\W_]+|[\W_]+$").sub
_number = re.compile(r"[-+]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?").fullmatch
_joined = re.compile(r"([$€£¥]?)([-+]?\d+(?:[.,]\d+)*)([a-z°%]*(?:/[a-z]+)?)").fullmatch


def read(word: str) -> list[tuple[str, int]]:
    """Tokens of a word and their kinds; UNIT is decided by what stands before."""
    plain = word.rstrip(".,;:!?")
    if plain.isalpha():  # most words
        low = plain.lower()
        return [(low, UNIT if low in UNITS else NAME if plain[0].isupper() else PLAIN)]
    plain = _strip("", word)
    low = plain.lower()
    if _number(low):
        marks = [(c, UNIT) for c in word if c in "$€£¥%°"][:1]
        return [(low, NUMBER), *marks]
    if found := _joined(low):
        money, number, unit = found.groups()
        if unit in UNITS or money:
            return [(number, NUMBER), (unit or money, UNIT)]
    if not low:
        return []
    if low in UNITS:
        return [(low, UNIT)]
    return [(low, NAME if plain[0].isupper() else PLAIN)]


TOKENS = "tokens"


class Tokens(dict):
    """Numbers of the words met so far, and what each is read as."""

    def __init__(self):
        super().__init__()
        self.reset()

    def reset(self):
        self.clear()
        self.tokens: list = []  # the token, or all of them where there isn't exactly one
        self.hash = np.zeros(1 << 12, np.uint64)
        self.kind = np.zeros(1 << 12, np.uint8)

    def __missing__(self, word: str) -> int:
        known = self[word] = len(self.tokens)
        found = read(word)
        if known == len(self.hash):
            self.hash = np.concatenate((self.hash, np.zeros_like(self.hash)))
            self.kind = np.concatenate((self.kind, np.zeros_like(self.kind)))
        if len(found) == 1:
            token, self.kind[known] = found[0]
            self.hash[known] = xxhash.xxh64_intdigest(token)
            self.tokens.append(token)
        else:
            self.kind[known] = SEVERAL if found else GONE
            self.tokens.append(found)
        return known

    def of(self, number: int) -> list[tuple[str, int]]:
        found = self.tokens[number]
        return [(found, int(self.kind[number]))] if isinstance(found, str) else found


PLACEHOLDERS = np.array([xxhash.xxh64_intdigest(x) for x in ("", "<number>", "<unit>", "<name>")], np.uint64)


def windows(text: str, sizes: list[int] | None = None, window: int = WINDOW):
    """Every reading of every window: hashes, starts, sizes, readings (0 to 2), a function for the slots of one, and the number of windows.

    ``sizes`` lists the sizes of windows; without it the size is ``window``, or all words of a shorter text.
    """
    known: Tokens = memo(TOKENS, Tokens)
    if len(known.tokens) > MEMO:
        known.reset()
    numbers = np.fromiter(map(known.__getitem__, text.split()), np.int64)
    kinds, hashes = known.kind[numbers], known.hash[numbers]
    values = None
    if (kinds == SEVERAL).any():
        values = [t for i in numbers.tolist() for t in known.of(i)]
        kinds = np.array([k for _, k in values], np.uint8)
        hashes = np.array([xxhash.xxh64_intdigest(v) for v, _ in values], np.uint64)
    else:
        there = kinds != GONE
        numbers, kinds, hashes = numbers[there], kinds[there], hashes[there]
    n = len(kinds)
    if not n:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3, None, 0
    kinds = kinds.copy()
    lone = (kinds == UNIT) & ~np.concatenate(([False], kinds[:-1] == NUMBER))
    kinds[lone] = PLAIN
    made, places, lengths, readings, total = [np.zeros(0, np.uint64)], [], [], [], 0
    measured, named = (kinds == NUMBER) | (kinds == UNIT), kinds == NAME
    for reading, (slots, least) in enumerate(((np.zeros(n, bool), None), (measured, measured), (measured | named, named))):
        rolling = None
        for size in [min(window, n)] if sizes is None else [z for z in sizes if z <= n]:
            starts = np.arange(n - size + 1)
            within = lambda mask: (c := np.concatenate(([0], np.cumsum(mask))))[size:] - c[:-size]  # noqa: B023, E731
            chosen = starts if least is None else starts[(within(least) > 0) & (size - within(slots) >= LITERAL)]
            total += len(starts) if least is None else 0
            if len(chosen):
                rolling = rolling or Rolling(np.where(slots, PLACEHOLDERS[np.minimum(kinds, NAME)], hashes), BASES[reading > 0])
                made.append(rolling.at(chosen, size))
                places.append(chosen)
                lengths.append(np.full(len(chosen), size))
                readings.append(np.full(len(chosen), reading))

    def slots_of(start: int, size: int, reading: int) -> list[str]:
        out = []
        for i in range(start, start + size):
            if reading and (measured[i] or reading == 2 and named[i]):
                value = values[i][0] if values is not None else known.tokens[numbers[i]]
                out.append("-nup"[kinds[i]] + value)
        return out

    joined = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (places, lengths, readings)]
    return np.concatenate(made), *joined, slots_of, total


def table(df: DataFrame, key: str, text: str, bits=None, sizes: list[int] | None = None, window: int = WINDOW) -> DataFrame:
    """``key``, ``tag`` (hash of the text), ``place``, ``size``, ``hash``, ``slots`` and ``total`` of windows, if given only of those in the bitmap."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("tag", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("size", T.IntegerType()),
                           T.StructField("hash", T.LongType()), T.StructField("slots", T.ArrayType(T.StringType())), T.StructField("total", T.IntegerType())])

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for k, tag, x in zip(batch.column(key).to_pylist(), batch.column("tag").to_pylist(), texts(batch, text)):
                hashes, starts, lengths, readings, slots_of, total = windows(x, sizes, window)
                if bits is not None and len(hashes):
                    held = bits.value[(hashes & np.uint64(BITMAP_WORDS - 1)).astype(np.int64)] >> ((hashes >> np.uint64(32)) & np.uint64(63))
                    keep = np.flatnonzero(held & np.uint64(1))
                    hashes, starts, lengths, readings = hashes[keep], starts[keep], lengths[keep], readings[keep]
                for a in range(0, len(hashes), 5000):
                    part = slice(a, a + 5000)
                    for h, s, z, r in zip(hashes[part].view(np.int64).tolist(), starts[part].tolist(), lengths[part].tolist(), readings[part].tolist()):
                        out.append((k, tag, s, z, h, slots_of(s, z, r), total))
                    if len(out) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*out), schema)], names=schema.names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*out), schema)], names=schema.names)

    rows = df.where(F.col(key).isNotNull()).select(key, text, F.xxhash64(text).alias("tag"))
    return map_arrow(rows, run, schema, TOKENS)


def bitmap(items: DataFrame):
    """Bits of the items' window hashes: at most ``BITMAP_WORDS`` rows reach the driver."""
    rows = items.groupBy(F.pmod("hash", F.lit(BITMAP_WORDS)).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(shiftrightunsigned(hash, 32) & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(BITMAP_WORDS, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return items.sparkSession.sparkContext.broadcast(out)


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "text", window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_windows`` of the item, ``n_found``, ``similarity``, ``verbatim`` and ``first_word`` (in the document)."""
    items = cut(table(benchmark, item_id, item_text, None, None, window).withColumnRenamed("tag", "item_tag"))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # no more than ``window``
    found = table(docs, doc_id, text, bitmap(items), sizes, window).drop("total")
    inner = items.select(item_id, "item_tag", F.col("place").alias("item_place"), "size", "hash", F.col("slots").alias("item_slots"), "total")
    met = found.join(inner, ["hash", "size"]).withColumn("apart", F.col("place") - F.col("item_place"))
    # At one distance each window of the item stands once in each reading, so a group is no larger than three times the item.
    lines = met.groupBy(doc_id, "tag", item_id, "item_tag", "apart", "total").agg(
        F.collect_set(F.struct("item_place", "item_slots", "slots")).alias("met"))
    lines = lines.withColumn("pairs", F.expr("array_distinct(flatten(transform(met, w -> arrays_zip(w.item_slots, w.slots))))"))
    # Slots of the item that become several, and names of the document that several become.
    twice = lambda pairs, by: f"transform(filter({pairs}, (p, i) -> i > 0 AND p.{by} = {pairs}[i - 1].{by}), p -> p.{by})"
    lines = lines.withColumn("ordered", F.expr("array_sort(pairs)")).withColumn("turned", F.expr(
        "array_sort(transform(filter(pairs, p -> startswith(p.item_slots, 'p')), p -> named_struct('slots', p.slots, 'item_slots', p.item_slots)))"))
    lines = lines.withColumn("split", F.expr(twice("ordered", "item_slots"))).withColumn("joined", F.expr(twice("turned", "slots")))
    # Windows as they are have no slots, so nothing conflicts with them.
    lines = lines.withColumn("fit", F.expr("filter(met, w -> NOT arrays_overlap(w.item_slots, split) AND NOT arrays_overlap(w.slots, joined))"))
    lines = lines.withColumn("places", F.expr("transform(fit, w -> w.item_place)")).withColumn(
        "same", F.expr("transform(filter(met, w -> size(w.item_slots) = 0), w -> w.item_place)"))
    sums = lines.groupBy(doc_id, "tag", item_id, "item_tag", "total").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_found"),
        F.size(F.array_distinct(F.flatten(F.collect_list("same")))).alias("n_same"),
        F.min(F.expr("array_min(places) + apart")).alias("first"))
    kept = sums.where(F.col("n_found") >= similarity * F.col("total"))
    return kept.groupBy(doc_id, item_id).agg(
        F.max("total").cast("long").alias("n_windows"), F.max("n_found").cast("long").alias("n_found"),
        F.max(F.col("n_found") / F.col("total")).alias("similarity"), F.max(F.col("n_same") >= similarity * F.col("total")).alias("verbatim"),
        F.min("first").cast("long").alias("first_word"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no item; those with a null doc_id stay. Only those that may go are shuffled."""
    held = cut(matches(docs, benchmark, doc_id, **options).select(F.col(doc_id).alias("__held_")).distinct())
    maybe, rest = split(docs, doc_id, common.bitmap(held, "__held_"))
    return rest.unionByName(maybe.join(held, F.col(doc_id) == F.col("__held_"), "left_anti"))
