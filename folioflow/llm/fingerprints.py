"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases: each is the shortest piece that is no phrase yet. The set of phrases is what a
compressor's dictionary would hold, and two texts that would compress well together share many of them. The phrases'
hashes are dealt into ``BINS`` by their high bits; 16 bits of the least hash of each bin make the fingerprint.
The likeness of two fingerprints is the share of equal bins among those that either fills, an estimate
of the phrase sets' Jaccard similarity.

``with_next`` gives each document its follower in the order of ids, at any size: the ids (not the texts) are summarised
into range boundaries that are ids themselves (ids that aren't numbers by a sample, chosen by hash, of ``SAMPLED`` ids for each range), every row
goes to its range once, and the first document of a range also to the range before it. A task then reads its range in order, holding two documents at a time.

Defined results: ids of any type with an order will do; texts of any length are parsed whole; null text counts as empty; an empty text has no phrases and the fingerprint of empty bins, and two
such are alike (1); null ids come first; rows with equal ids follow each other in the order of their
texts; a single document follows itself; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioflow.llm.common import BASES, Rolling, map_arrow, mix64, shuffle_partitions

BINS = 64
#: Ranges for each shuffle partition, to even out how they fall.
RANGES = 3
#: Sampled ids for each range, where ids aren't numbers.
SAMPLED = 100


def parse(text: str, start: int, known: int, end: int, seen: set[str], cuts: list[int]) -> int:
    """Parse on to ``end``; the phrase that begins at ``start`` is in ``seen`` as far as ``known``.

    Adds phrases and their ends; returns where the unfinished phrase begins.
    """
    add = seen.add
    note = cuts.append
    for i in range(known + 1, end + 1):
        piece = text[start:i]
        if piece not in seen:
            add(piece)
            note(i)
            start = i
    return start


def fingerprint(text: str, cuts: list[int]) -> np.ndarray:
    """Bins (0: empty) of the phrases that end at ``cuts``."""
    out = np.zeros(BINS, np.int64)
    if not cuts:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.array(cuts, np.int64)
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
    hashes = np.sort(Rolling(mix64(points.astype(np.uint64) + np.uint64(1)), BASES[0]).at(starts, ends - starts))
    shift = np.uint64(64 - (BINS - 1).bit_length())
    first = np.searchsorted(hashes, np.arange(BINS, dtype=np.uint64) << shift)
    there = np.minimum(first, len(hashes) - 1)
    full = (first < len(hashes)) & ((hashes[there] >> shift) == np.arange(BINS, dtype=np.uint64))
    out[full] = 1 + (hashes[there[full]] % np.uint64(65535)).astype(np.int64)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    either = int(((a > 0) | (b > 0)).sum())
    return float(((a == b) & (a > 0)).sum()) / either if either else 1.0


def shown(bins: np.ndarray) -> str:
    return bins.astype(">u2").tobytes().hex()


def with_next(docs: DataFrame, make, fields: list[T.StructField], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and what ``make()`` gives of each document and its follower in the order of ids, after the last the first.

    What ``make`` returns is called with both texts and with two dicts, one for each document, that last while it is in memory.
    """
    kind = docs.schema[doc_id].dataType
    n = shuffle_partitions(docs.sparkSession)
    shares = [i / (RANGES * n) for i in range(1, RANGES * n)]
    numeric = isinstance(kind, T.NumericType)
    cuts = F.percentile_approx(doc_id, shares, 100 * len(shares)) if numeric else F.lit(None)
    known = docs.agg(F.min(doc_id), cuts, F.count("*"), F.count(doc_id)).first()
    found = known[1] or []
    if not numeric and known[3]:
        part = max(1, known[3] // (SAMPLED * RANGES * n))
        sample = sorted(r[0] for r in docs.where(F.col(doc_id).isNotNull() & (F.pmod(F.xxhash64(doc_id), F.lit(part)) == 0)).select(doc_id).distinct().collect())
        found = [sample[int(x * len(sample))] for x in shares] if sample else []
    begins = sorted({known[0], *found}) if known[0] is not None else []
    nulls = known[2] > known[3]
    last = max(0, len(begins) - 1)
    schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("ahead", T.IntegerType()), T.StructField("id", kind), T.StructField("text", T.StringType())])

    def deal(batches):
        for batch in batches:
            ids, rows = batch.column(doc_id).to_pylist(), batch.column(text)
            at = np.array([0 if x is None else max(0, bisect.bisect_right(begins, x) - 1) for x in ids], np.int32)
            first = [x is None if nulls and (x is None or at[i] == 0) else x == begins[at[i]] for i, x in enumerate(ids)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(ids), np.int32)), batch.column(doc_id), rows], names=schema.names)
            chosen = [i for i, x in enumerate(first) if x]
            if chosen:
                before = np.array([at[i] - 1 if at[i] else last for i in chosen], np.int32)
                take = pa.array(chosen, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(before), pa.array(np.ones(len(chosen), np.int32)), batch.column(doc_id).take(take), rows.take(take)], names=schema.names)

    def walk(batches):
        step = make()
        waiting = None  # range, id, text, results
        current = done = None
        for batch in batches:
            out: list[tuple] = []
            places, heads, ids, rows = (batch.column(c).to_pylist() for c in ("range", "ahead", "id", "text"))
            for place, ahead, key, row in zip(places, heads, ids, rows):
                row = row or ""
                if place != current:
                    current, waiting, done = place, None, False
                if done:
                    continue
                mine: dict = {}
                if waiting is not None:
                    out.append((waiting[0], *step(waiting[1], row, waiting[2], mine)))
                waiting = (key, row, mine)
                done = bool(ahead)  # the first one ahead closes the range
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [to_arrow_type(kind), *(to_arrow_type(f.dataType) for f in fields)])],
                                                 names=[doc_id, *(f.name for f in fields)])

    dealt = map_arrow(docs.select(doc_id, text), deal, schema)
    ranged = dealt.repartition(n, "range").sortWithinPartitions("range", "ahead", F.col("id").asc_nulls_first(), "text")
    return map_arrow(ranged, walk, T.StructType([T.StructField(doc_id, kind), *fields]))


def edited(text: str, follower: str) -> str:
    """The last quarter replaced by the begin of the follower."""
    k = len(text) // 4
    return text[: len(text) - k] + follower[:k]


FIELDS = [T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
          T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]


def prepared(text: str):
    """The fingerprint of a text, and a function that gives its edited text's from the parse of what both begin with."""
    keep = len(text) - len(text) // 4
    seen: set[str] = set()
    cuts: list[int] = []
    at = parse(text, 0, 0, keep, seen, cuts)
    kept, ends = seen.copy(), cuts.copy()
    parse(text, at, keep, len(text), seen, cuts)

    def changed_bins(changed: str) -> np.ndarray:
        parse(changed, at, keep, len(changed), kept, ends)
        return fingerprint(changed, ends)

    return fingerprint(text, cuts), changed_bins


def compare():
    """For ``with_next``: fingerprints of a document, its edited text and its follower, and their likeness."""

    def step(text: str, follower: str, mine: dict, theirs: dict) -> tuple:
        if not mine:
            mine["bins"], mine["edit"] = prepared(text)
        theirs["bins"], theirs["edit"] = prepared(follower)
        changed = edited(text, follower)
        other = mine["edit"](changed)
        return (len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), shown(mine["bins"]), shown(other),
                likeness(mine["bins"], other), likeness(mine["bins"], theirs["bins"]))

    return step
