"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point alone. A trigram's vector binds
its three letters: their vectors, permuted (rolled) by their place, are multiplied. A document's vector
bundles (adds) the vectors of all its trigrams; a language's prototype bundles its learning documents, each with
the same weight. A document gets the language whose prototype has the largest cosine with its vector.

Text is lower-cased; runs of other characters than letters count as one blank, as do both ends.
Learning covers all rows that the caller passes; sums are of integers, so the prototypes don't depend on
how rows are dealt to tasks. Only the prototypes (one vector for each language, ``LANGUAGES`` at most) reach the driver
and are broadcast.

Defined results: null text and text without a letter is ``und`` with score 0, as is every text if
nothing was learned; of equal cosines the first language in order wins; repeated rows count repeatedly; an empty table teaches nothing and gives no
rows; texts of any length are read whole, in runs of ``RUN`` letters whose vectors add up; rows with a null language or text aren't learned from; the input's other columns are kept, but for the two that are made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import chunks, map_arrow, mix64, texts, worker_cache

DIMENSIONS = 1024
UNDETERMINED = "und"
#: A learning document's vector is multiplied by this over the number of its trigrams, and rounded.
WEIGHT = 1 << 24
#: Letters that are bound at once, different trigrams that are added at once, labels whose sums a task keeps, labels that are learned at most.
RUN, SLICE, KEPT, LANGUAGES = 1 << 19, 1 << 13, 256, 8192
BLANK = 32


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    words = dimensions // 64
    seeds = points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64)
    bits = np.unpackbits(mix64(seeds + np.uint64(0x9E3779B97F4A7C15)).view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def is_letter() -> np.ndarray:
    cache = worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return cache["letters"]


def letters_of(text: str) -> np.ndarray:
    """The code points of a text's letters in lower case, one blank for each run of others and at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int32)
    points = np.where(is_letter()[points], points, np.int32(BLANK))
    points = np.concatenate((np.array([BLANK], np.int32), points, np.array([BLANK], np.int32)))
    return points[np.concatenate(([True], (points[1:] != BLANK) | (points[:-1] != BLANK)))]


def bundles(rows: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text, and how many trigrams it has.

    A text is cut into runs of ``RUN`` letters that overlap by two; runs are bound and added together up to that size, and of their different
    trigrams ``SLICE`` at a time. So memory doesn't grow with the number of different trigrams. Sums stay whole numbers.
    """
    total, count = np.zeros((len(rows), dimensions)), np.zeros(len(rows), np.int64)
    owners: list[int] = []
    parts: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(rows):
        points = letters_of(text)
        count[i] = max(0, len(points) - 2)
        for a in range(0, int(count[i]), RUN):
            owners.append(i)
            parts.append(points[a : a + RUN + 2])
            size += len(parts[-1])
            if size >= RUN:
                _add(total, owners, parts)
                owners, parts, size = [], [], 0
    if parts:
        _add(total, owners, parts)
    return total, count


def _add(total: np.ndarray, owners: list[int], parts: list[np.ndarray]) -> None:
    flat, n, dimensions = np.concatenate(parts), len(parts), total.shape[1]
    row = np.repeat(np.arange(n), [len(p) - 2 for p in parts])
    alphabet, place = np.unique(flat, return_inverse=True) if len(flat) < 1 << 12 else _places(flat)
    k = len(alphabet)
    keep = np.ones(len(flat), bool)
    ends = np.cumsum([len(p) for p in parts])
    keep[ends - 1] = keep[ends - 2] = False
    first = np.flatnonzero(keep)
    code = (place[first] * k + place[first + 1]) * k + place[first + 2]
    if k**3 <= 1 << 22:
        there = np.zeros(k**3, np.int32)
        there[code] = 1
        codes = np.flatnonzero(there)
        there[codes] = np.arange(len(codes))
        column = there[code].astype(np.int64)
    else:
        codes, column = np.unique(code, return_inverse=True)
    many = len(codes) > 8 * SLICE  # few slices are found faster without an order
    if many:
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
    vectors = letter_vectors(alphabet, dimensions)
    turned = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
    for a in range(0, len(codes), SLICE):
        part = codes[a : a + SLICE]
        here = slice(*np.searchsorted(column, (a, a + SLICE))) if many else slice(None) if len(codes) <= SLICE else (column >= a) & (column < a + SLICE)
        counts = np.bincount(row[here] * len(part) + column[here] - a, minlength=n * len(part)).reshape(n, len(part)).astype(np.float32)
        bound = turned[0][part // (k * k)] * turned[1][part // k % k] * vectors[part % k]
        np.add.at(total, owners, counts @ bound.astype(np.float32))  # float32 holds the whole numbers of a run


def _places(flat: np.ndarray):
    seen = np.zeros(0x110000, bool)
    seen[flat] = True
    alphabet = np.flatnonzero(seen)
    at = np.zeros(0x110000, np.int64)
    at[alphabet] = np.arange(len(alphabet))
    return alphabet, at[flat]


def learn(df: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototype of each language of ``df``; more than ``LANGUAGES`` of them are an error."""

    def rows(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "vector"])

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            found, labels = texts(batch, text), batch.column(lang).to_pylist()
            for a, b in chunks(found, RUN, 250):
                whole, sizes = bundles(found[a:b], dimensions)
                weighed = np.rint(whole * (WEIGHT / np.maximum(sizes, 1))[:, None]).astype(np.int64)
                for name in set(labels[a:b]):
                    made = weighed[[x == name for x in labels[a:b]]].sum(axis=0)
                    sums[name] = sums[name] + made if name in sums else made
                if len(sums) > KEPT:
                    yield rows(sums)
                    sums = {}
        if sums:
            yield rows(sums)

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, np.int64) for v in frame["vector"])
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "vector": [total.tobytes()]})

    schema = "lang string, vector binary"
    known = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, F.col(lang).cast("string").alias(lang))
    # Two steps, so that no task gets a language's vectors from all partitions.
    parts = map_arrow(known, bundle, schema).withColumn("salt", F.spark_partition_id() % 64)
    sums = parts.groupBy("lang", "salt").applyInPandas(add, schema).groupBy("lang").applyInPandas(add, schema)
    found = sums.limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    return {r["lang"]: np.frombuffer(r["vector"], np.int64) for r in found}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text",
            out: str = "lang_pred", score: str = "score", size: str | None = None) -> DataFrame:
    """``df`` with the predicted language and its cosine (0 to 1) of every whole text, and the number of its trigrams if asked."""
    names = sorted(prototypes)
    profile = np.array([prototypes[n] / max(1e-9, float(np.linalg.norm(prototypes[n].astype(float)))) for n in names], np.float32)
    sent = df.sparkSession.sparkContext.broadcast((names, profile))
    kept = [f for f in df.schema.fields if f.name not in (out, score, size)]
    schema = T.StructType([*kept, T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())]
                          + ([T.StructField(size, T.LongType())] if size else []))

    def run(batches):
        names, profile = sent.value
        for batch in batches:
            rows = texts(batch, text)
            for a, b in chunks(rows, RUN, 250):
                found, near = [UNDETERMINED] * (b - a), [0.0] * (b - a)
                whole, sizes = bundles(rows[a:b], profile.shape[1] if names else 64)
                if names:
                    cosine = whole @ profile.T / np.maximum(np.linalg.norm(whole, axis=1), 1e-9)[:, None]
                    best = cosine.argmax(axis=1)
                    for i in np.flatnonzero(sizes).tolist():
                        found[i], near[i] = names[best[i]], min(1.0, max(0.0, float(cosine[i, best[i]])))
                part = batch.slice(a, b - a)
                more = [pa.array(sizes, pa.int64())] if size else []
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in kept] + [pa.array(found, pa.string()), pa.array(near, pa.float64()), *more],
                                                 names=schema.names)

    return map_arrow(df, run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing is learned from: the checksum of the id, as text, leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, learned from the labelled documents that aren't held out."""
    return predict(docs, learn(docs.where(~held_out()).select("text", "lang")))


#: The least score that a long text needs to be in a learned language, three times the spread of unrelated vectors' cosines, and the
#: number of trigrams at which a text's least score is the square root of one half of it.
LEAST_SCORE, HALF_SIZE = 3 / DIMENSIONS**0.5, 200


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents in a learned language, learned from all labelled ones; the columns stay as they are.

    Texts without a letter go, and those that resemble no language. A text of n trigrams shares fewer of a language's the shorter it is,
    about as the square root of n / (n + a constant), so the least score is ``LEAST_SCORE`` times that.
    """
    scored = predict(docs, learn(docs.select(text, lang), text, lang), text, "__lang_", "__score_", "__size_")
    least = LEAST_SCORE * F.sqrt(F.col("__size_") / (F.col("__size_") + HALF_SIZE))
    return scored.where((F.col("__lang_") != UNDETERMINED) & (F.col("__score_") >= least)).drop("__lang_", "__score_", "__size_")
