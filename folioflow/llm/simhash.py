"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

A 64-bit fingerprint is cut into a high segment of 29 and a low one of 35 bits. Two fingerprints
that differ in two bits at most agree in the whole high segment or differ in one bit of the low one
at most (else they would differ in three). So each fingerprint looks up its high segment, and the
ball of radius one around its low segment, in tables keyed by segment, and the complete distance
of what is found is verified. Segments of these lengths give both lookups about as many matches.

A table bucket with more than ``BUCKET`` fingerprints isn't compared pair by pair: its members enumerate
the ball of radius one in their other segment as well, and those that meet in a point of it are linked
to the smallest there. Two fingerprints within two bits always meet in such a point, and a point
has less than a hundred members, so the links stay whole and the groups small.

Equal fingerprints are one node of the graph, so a group of copies costs as much as one document.

Near copies that share less (see ``near``) are a dozen and more bits of 64 apart, too far for balls. For them a fingerprint goes
on beyond its first word, in ``SEGMENTS`` segments that are a table each. Fingerprints that agree in a whole segment are
candidates if their first words differ in ``RADIUS`` bits at most. Segments grow with the number of fingerprints, so that
chance brings few together. In a bucket each meets the next ``FOLLOWING`` in the order of the first words only; ``near`` has an exact way for the rest.

Defined results: null and empty texts have no words and the fingerprint zero, linked like any other;
repeated rows link with each other; rows with a null doc_id take part but name no group, a group without
any doc_id has a null component; an empty table gives no rows; other columns aren't carried.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import BASES, bitmap, cut, map_arrow, mix64, split, spread_join, texts
from folioflow.llm.components import components

SHINGLE = 3
LOW_BITS = 35
BUCKET = 64
#: Of the long fingerprint: its segments, most bits by which the first words of candidates differ, and how many next ones each meets in a bucket.
SEGMENTS, RADIUS, FOLLOWING = 32, 20, 3


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits that are set in over half of the shingles' hashes (XXH64, seed 42)."""
    words = text.encode("utf-8", "replace").lower().split()  # on bytes both mean ASCII only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), np.dtype("<u8"), len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", fp: str = "fp") -> DataFrame:
    """``df`` with ``fp``, the fingerprint as a signed long, in place of its text column."""
    kept = [f for f in df.schema.fields if f.name not in (text, fp)]

    def run(batches):
        for batch in batches:
            made = np.fromiter((fingerprint(x) for x in texts(batch, text)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(made.view(np.int64))], names=[*(f.name for f in kept), fp])

    return map_arrow(df, run, T.StructType([*kept, T.StructField(fp, T.LongType())]))


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges ``a``, ``b`` that connect all distinct ``fp`` within two bits of each other.

    Those in small table buckets are linked in person, those in large ones through a common neighbour.
    """
    high, low = f"shiftrightunsigned(fp, {LOW_BITS})", f"fp & {(1 << LOW_BITS) - 1}L"
    shelf = prints.selectExpr("fp", f"inline(array(struct(1 AS k, {high} AS key), struct(2 AS k, {low} AS key)))")
    full = shelf.groupBy("k", "key").count().where(F.col("count") > bucket).select("k", "key", F.lit(True).alias("hot"))
    # A bit is only set, never cleared, so each pair that differs in the low segment is looked up from one side.
    masks = "array(0L, " + ", ".join(f"{1 << i}L" for i in range(LOW_BITS)) + ")"
    probes = prints.selectExpr("fp", f"{low} AS own", f"explode({masks}) AS mask").where("(own & mask) = 0")
    probes = probes.selectExpr("fp", "2 AS k", "own | mask AS key", "mask = 0 AS same").unionByName(
        prints.selectExpr("fp", "1 AS k", f"{high} AS key", "true AS same"))
    table = shelf.join(full, ["k", "key"], "left")
    cold = table.where("hot IS NULL").select("k", "key", F.col("fp").alias("b"))
    pairs = probes.join(cold, ["k", "key"]).where("bit_count(fp ^ b) <= 2 AND (NOT same OR fp < b)").select(F.col("fp").alias("a"), "b")
    # All that look up a full bucket: its members with their ball in the other segment, the rest with that segment.
    other = f"IF(k = 1, {low}, {high})"
    rings = ("IF(NOT same, array(0L), IF(k = 1, " + masks + ", array(0L, " + ", ".join(f"{1 << i}L" for i in range(64 - LOW_BITS)) + ")))")
    met = probes.join(full, ["k", "key"]).selectExpr("fp", "k", "key", f"{other} AS own", f"explode({rings}) AS mask").selectExpr(
        "fp", "k", "key", "own ^ mask AS point")
    first = F.min("fp").over(Window.partitionBy("k", "key", "point"))
    meets = met.select(F.col("fp").alias("a"), first.alias("b")).where("a != b")
    return pairs.unionByName(meets).distinct()


def segment_bits(n: int) -> int:
    """Bits of a segment for so many fingerprints: unequal ones share it by chance with less than one other."""
    return min(30, max(16, n.bit_length() + 1))


def wide(hashes: np.ndarray, bits: int) -> tuple[int, np.ndarray]:
    """First word and segments of a long fingerprint: bits set in over half of the hashes, which are mixed anew for each further word."""
    words = 1 + -(-SEGMENTS * bits // 64)
    steps = np.arange(words, dtype=np.uint64) * np.uint64(BASES[0])
    counts = np.zeros(words * 64, np.int64)
    for a in range(0, len(hashes), 255 * 16):
        part = hashes[a : a + 255 * 16].view(np.uint64)
        mixed = mix64(part[:, None] + steps)
        mixed[:, 0] = part
        # Eight counts are added at once, as bytes of a long, which 255 rows can't overflow.
        lanes = np.unpackbits(mixed.view(np.uint8).reshape(-1), bitorder="little").view(np.uint64).reshape(len(part), -1)
        counts += np.add.reduceat(lanes, np.arange(0, len(part), 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    over = counts * 2 > len(hashes)
    return int(np.packbits(over[:64], bitorder="little").view(np.int64)[0]), over[64 : 64 + SEGMENTS * bits].reshape(SEGMENTS, bits) @ (1 << np.arange(bits))


def candidates(prints: DataFrame, radius: int = RADIUS, following: int = FOLLOWING) -> DataFrame:
    """Pairs ``a``, ``b`` of different ``fp`` that agree in one of ``marks``, the segments, and whose ``print``, the first word, differs in ``radius`` bits at most.

    In a bucket each meets the next ones in the order of ``print``, so work grows with the members, however many.
    """
    rows = prints.selectExpr("fp", "print", "posexplode(marks) AS (place, mark)").selectExpr("fp", "print", "shiftleft(CAST(place AS BIGINT), 32) | mark AS key")
    order = Window.partitionBy("key").orderBy("print", "fp")
    nexts = [F.lead(F.struct("fp", "print"), i).over(order) for i in range(1, following + 1)]
    near = f"filter(nexts, x -> x IS NOT NULL AND bit_count(x.print ^ print) <= {radius})"
    met = rows.withColumn("nexts", F.array(*nexts)).where("nexts[0] IS NOT NULL").selectExpr("fp", f"explode({near}) AS other")
    return met.selectExpr("least(fp, other.fp) AS a", "greatest(fp, other.fp) AS b").distinct()


def groups(prints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``prints`` with ``component_id``, the smallest doc_id reachable over links of ``fp``, and ``root``, a name of the group."""
    prints = cut(prints)
    distinct = cut(prints.groupBy("fp").agg(F.min(doc_id).alias("__least_"), F.count("*").alias("__n_")))
    found = components(links(distinct.select("fp")), "a", "b").withColumnRenamed("node", "fp")
    rooted = cut(distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = cut(rooted.groupBy("root").agg(F.min("__least_").alias("component_id"), F.count("*").alias("__of_")))
    named = cut(spread_join(rooted, least, "root", "__of_").select("fp", "root", "component_id", "__n_"))
    return spread_join(prints, named, "fp", "__n_")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row."""
    return groups(fingerprints(df.select(doc_id, text), text), doc_id).select(doc_id, "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group: that of the smallest doc_id, of several such that of the smallest text hash, once.

    Only rows that go, or that repeat, are joined; a bitmap of bounded size tells the others, which aren't shuffled.
    """
    docs = docs.withColumn("__row_", F.xxhash64(doc_id, text))
    return keep_first(docs, cut(groups(fingerprints(docs.select(doc_id, text, "__row_"), text), doc_id)), doc_id).drop("__row_")


def keep_first(docs: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    """The first row of each ``root`` of ``found``, which names the rows of ``docs`` by ``__row_``."""
    rows = cut(found.groupBy("root", "__row_").agg(F.count("*").alias("count"), F.min(F.col(doc_id)).alias("__id_")))
    first = cut(rows.groupBy("root").agg(F.min(F.struct(F.col("__id_").isNull().alias("none"), F.col("__id_"), F.col("__row_"))).alias("keep"), F.count("*").alias("__n_")))
    marked = spread_join(rows.drop("__id_"), first, "root", "__n_").withColumn("__stays_", F.col("__row_") == F.col("keep.__row_"))
    touched = cut(marked.where(~F.col("__stays_") | (F.col("count") > 1)).groupBy(F.col("__row_").alias("__touched_")).agg(F.max("__stays_").alias("__stays_")))
    maybe, rest = split(docs, "__row_", bitmap(touched, "__touched_"))
    joined = maybe.join(touched, F.col("__row_") == F.col("__touched_"), "left")
    others = joined.where("__touched_ IS NULL").select(rest.columns)
    once = joined.where("__stays_").dropDuplicates(["__row_"]).select(rest.columns)
    return rest.unionByName(others).unionByName(once)
