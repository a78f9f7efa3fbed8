"""Near-duplicate groups by the Jaccard similarity of word shingles, with no pair missed.

A text is the set of its runs of ``SHINGLE`` words (words as for the SimHash fingerprint). Two texts are linked if their sets'
similarity is at least ``SIMILARITY``.

First SimHash fingerprints of the sets find pairs by multi-index hashing (``simhash.candidates``); those whose sets are similar are links.
Fingerprints find a pair with some probability only, so what they leave is completed by prefixes: if all shingles have one order, and each text keeps the first n - ceil(0.8 n) + 1 of its n, then
two similar texts share one that they keep. Any order is right; here shingles that are frequent in a sample come last, the others
go by hash, so that common lines bring few texts together. Texts that
fingerprints have already connected aren't compared again.

Texts that share enough of the kept shingles for that similarity are compared by their whole sets, computed anew for only those texts. Where more than ``BUCKET``
share one, all are first compared with one of them, the pivot; those similar to it, or connected with it, are linked to it and so with each other. The
others are dealt into blocks, each of which meets every block of all in a task, and of the pairs found only those leave it that
connect the same texts. All comparisons are exact; nothing is capped. So a group of near copies of one text costs as much as its
size, however large; work grows with the product of those that aren't like the pivot and all that keep the shingle.

Equal sets are one node of the graph, so a group of copies costs as much as one document.

Defined results: null and empty texts have one shingle, the empty one; texts of fewer than ``SHINGLE`` words have
one, all their words; otherwise as in ``simhash``.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import bitmap, cut, map_arrow, split, spread_join, texts
from folioflow.llm.components import components
from folioflow.llm.simhash import candidates, keep_first, segment_bits, wide

SHINGLE = 5
#: Least similarity, as a fraction.
SIMILARITY = (4, 5)
BUCKET = 256
BLOCK = 512
#: One text of so many is sampled for the order of shingles, and so many frequent ones at most are put last.
SAMPLE, FREQUENT = 16, 1 << 17
#: Columns of a block that are multiplied at once.
COLUMNS = 4096


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Different hashes (XXH64, seed 42) of the text's shingles, ascending as signed numbers."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        hashes = list(map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, zip(*(words[i:] for i in range(size))))))
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def similar(shared, a, b):
    """Whether sets of ``a`` and ``b`` members that share so many are similar, in whole numbers."""
    over, under = SIMILARITY
    return (over + under) * shared >= over * (a + b)


def kept(n: int) -> int:
    over, under = SIMILARITY
    return n - (over * n + under - 1) // under + 1


def prefix(hashes: np.ndarray, last: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of ``hashes`` in order of frequency (0 if not in ``last``), then hash."""
    k = kept(len(hashes))
    if not len(last):
        return hashes[:k]
    at = np.minimum(np.searchsorted(last, hashes), len(last) - 1)
    often = np.where(last[at] == hashes, counts[at], 0)
    return hashes[np.argsort(often, kind="stable")[:k]]


def frequent(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, ascending, and how many hold them."""
    sample = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0).distinct()

    def run(batches):
        for batch in batches:
            for x in texts(batch, text):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x))], names=["key"])

    counted = map_arrow(sample, run, "key long").groupBy("key").count().where("count > 2")
    found = counted.orderBy(F.desc("count"), "key").limit(FREQUENT).toArrow()
    keys, counts = found.column("key").to_numpy(), found.column("count").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def prefixes(docs: DataFrame, text: str, keep: list[str], bits: int) -> DataFrame:
    """``keep``, ``fp`` (hash of the set), ``n`` (its size), ``keys`` (the prefix), ``print`` and ``marks`` (its SimHash, with segments of so many bits) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent(docs, text))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("print", T.LongType()), T.StructField("marks", T.ArrayType(T.IntegerType()))])

    def run(batches):
        last, counts = sent.value
        for batch in batches:
            fps, sizes, keys, words, marks = [], [], [], [], []
            for x in texts(batch, text):
                hashes = shingles(x)
                fps.append(xxhash.xxh64_intdigest(hashes.tobytes(), 42))
                sizes.append(len(hashes))
                keys.append(prefix(hashes, last, counts))
                word, mark = wide(hashes, bits)
                words.append(word)
                marks.append(mark)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                                              pa.array(keys, pa.list_(pa.int64())), pa.array(words, pa.int64()), pa.array(marks, pa.list_(pa.int32()))], names=schema.names)

    return map_arrow(docs.select(*keep, text), run, schema)


def sets(docs: DataFrame, text: str) -> DataFrame:
    """``fp`` of ``docs`` and ``hashes``, the whole set."""
    schema = "fp long, hashes array<long>"

    def run(batches):
        for batch in batches:
            made = pa.array([shingles(x) for x in texts(batch, text)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("fp"), made], names=["fp", "hashes"])

    return map_arrow(docs.select("fp", text), run, schema)


def wholes(wanted: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``fp`` and ``hashes`` of the ``wanted`` (``fp``, ``row``: the hash of a row of ``docs``, its ``__row_``)."""
    maybe, _ = split(docs.select("__row_", text), "__row_", bitmap(wanted, "row"))
    return cut(sets(maybe.dropDuplicates(["__row_"]).join(wanted, F.col("__row_") == F.col("row")), text))


def confirmed(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose whole sets are similar."""
    over, under = SIMILARITY
    first, second = whole.select(F.col("fp").alias("a"), F.col("hashes").alias("x")), whole.select(F.col("fp").alias("b"), F.col("hashes").alias("y"))
    return pairs.select("a", "b").join(first, "a").join(second, "b").where(f"{over + under} * size(array_intersect(x, y)) >= {over} * (size(x) + size(y))").select("a", "b")


def print_links(nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Edges ``a``, ``b`` between similar nodes that their fingerprints find (``fp``, ``print``, ``marks``, ``row``)."""
    pairs = cut(candidates(nodes.select("fp", "print", "marks")))
    ends = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    return cut(confirmed(pairs, wholes(cut(nodes.select("fp", "row").join(ends, "fp")), docs, text)))


def connect(frame: pd.DataFrame) -> pd.DataFrame:
    """Links ``a``, ``b`` that connect the similar ones of some sets: no more than there are sets."""
    frame = frame.drop_duplicates("fp")
    fps, sizes = frame["fp"].to_numpy(), np.array([len(h) for h in frame["hashes"]])
    n = len(fps)
    row, flat = np.repeat(np.arange(n), sizes), np.concatenate(list(frame["hashes"]))
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    several = often[column] > 1
    row = row[several]
    names, column = np.unique(column[several], return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), np.float32)
    for a in range(0, len(names), COLUMNS):
        i, j = np.searchsorted(column, (a, a + COLUMNS))
        part = np.zeros((n, min(COLUMNS, len(names) - a)), np.float32)
        part[row[i:j], column[i:j] - a] = 1
        shared += part @ part.T
    near = similar(shared.astype(np.int64), sizes[:, None], sizes[None, :])
    new, links = np.ones(n, bool), []
    while new.any():  # a tree over each group
        front = [int(new.argmax())]
        new[front] = False
        while front:
            i = front.pop()
            for j in np.flatnonzero(near[i] & new).tolist():
                new[j] = False
                links.append((fps[i], fps[j]))
                front.append(j)
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def links(nodes: DataFrame, docs: DataFrame, text: str, known: DataFrame, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """Edges ``a``, ``b`` that, with those known, connect all similar nodes (``fp``, ``n``, ``keys``, ``row``: the hash of a row of ``docs``, its ``__row_``).

    ``known`` has the ``root`` of each ``fp`` that other edges connect."""
    rows = nodes.selectExpr("fp", "n", "row", "explode(keys) AS key")
    shared = rows.withColumn("many", F.count("*").over(Window.partitionBy("key"))).where("many > 1")
    shared = cut(shared.join(known, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    cold, hot = shared.where(F.col("many") <= bucket), shared.where(F.col("many") > bucket)
    over, under = SIMILARITY
    other = cold.select("key", F.col("fp").alias("b"), F.col("n").alias("m"), F.col("row").alias("row_b"), F.col("root").alias("root_b"))
    pairs = cold.join(other, "key").where(f"fp < b AND root != root_b AND {under} * least(n, m) >= {over} * greatest(n, m)")
    pairs = pairs.groupBy(F.col("fp").alias("a"), "b", "n", "m", "row", "row_b").agg(F.count("*").alias("c"))
    # Of the text whose prefix ends first all shared ones in it are counted, so no more than the rest can follow.
    # (A pair that also shares a hot shingle is counted short, and compared for that.)
    rest = lambda n: f"({over} * {n} + {under - 1}) div {under} - 1"
    pairs = cut(pairs.where(f"{over + under} * (c + greatest({rest('n')}, {rest('m')})) >= {over} * (n + m)").drop("c"))
    wanted = cut(pairs.selectExpr("a AS fp", "row").unionByName(pairs.selectExpr("b AS fp", "row_b AS row")).unionByName(hot.select("fp", "row")).distinct())
    whole = wholes(wanted, docs, text)
    near = confirmed(pairs, whole)
    # In a full bucket all meet the pivot. What is told of a bucket goes to each of its salts, so no task gets a large one.
    salts = f"CAST(ceil(many / {block}) AS BIGINT)"
    salted = hot.selectExpr("fp", "key", "many", "root", f"pmod(xxhash64(fp), {salts}) AS salt")
    pivots = hot.groupBy("key").agg(F.min("fp").alias("fp"), F.min_by("root", "fp").alias("center_root"), F.first("many").alias("many")).join(whole, "fp").selectExpr(
        "key", "fp AS pivot", "center_root", "hashes AS center", f"explode(sequence(0L, {salts} - 1)) AS salt")
    known = salted.join(whole, "fp").join(pivots, ["key", "salt"]).withColumn("like", F.expr(
        f"root = center_root OR {over + under} * size(array_intersect(hashes, center)) >= {over} * (size(hashes) + size(center))"))
    known = cut(known.select("fp", "key", "salt", "pivot", "many", "like"))
    by_pivot = known.where("like AND fp != pivot").select(F.col("pivot").alias("a"), F.col("fp").alias("b"))
    # Every block of the others meets each block of the bucket once; those like the pivot needn't meet each other.
    others = known.where("NOT like").groupBy("key").agg(F.count("*").alias("unlike"), F.first("many").alias("many")).selectExpr(
        "key", "unlike", f"explode(sequence(0L, {salts} - 1)) AS salt")
    dealt = known.join(others, ["key", "salt"]).selectExpr(
        "fp", "key", "like", f"CAST(ceil(unlike / {block}) AS BIGINT) AS k", f"CAST(ceil((many - unlike) / {block}) AS BIGINT) AS l")
    dealt = dealt.selectExpr("fp", "key", "IF(like, k + pmod(xxhash64(fp), l), pmod(xxhash64(fp), k)) AS own", "explode(sequence(0L, IF(like, k, k + l) - 1)) AS other").selectExpr(
        "fp", "key", "least(own, other) AS i", "greatest(own, other) AS j")
    met = dealt.join(whole, "fp").groupBy("key", "i", "j").applyInPandas(lambda frame: connect(frame), "a long, b long")
    return near.unionByName(by_pivot).unionByName(met).distinct()


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group: that of the smallest doc_id, of several such that of the smallest text hash, once."""
    docs = docs.withColumn("__row_", F.xxhash64(doc_id, text))
    prints = cut(prefixes(docs, text, [doc_id, "__row_"], segment_bits(docs.count())))
    # Only the prefixes of sets that repeat are shuffled to leave one.
    often, once = split(prints, "fp", bitmap(cut(prints.groupBy("fp").count().where("count > 1")), "fp"))
    told = ["n", "keys", "print", "marks"]
    nodes = often.groupBy("fp").agg(*(F.first(c).alias(c) for c in told), F.min("__row_").alias("row")).unionByName(
        once.select("fp", *told, F.col("__row_").alias("row")))
    near = print_links(nodes, docs, text)
    rest = links(nodes, docs, text, components(near, "a", "b").withColumnRenamed("node", "fp"))
    found = components(near.unionByName(rest), "a", "b").withColumnRenamed("node", "fp")
    many = prints.groupBy("fp").agg(F.count("*").alias("__n_"))
    roots = cut(many.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    return keep_first(docs, cut(spread_join(prints.select("fp", doc_id, "__row_"), roots, "fp", "__n_")), doc_id).drop("__row_")
