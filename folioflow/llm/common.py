"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import folioflow

# Executors need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(folioflow)

MASK64 = (1 << 64) - 1
#: Rows and bytes of a batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bases of rolling hashes, any odd numbers.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Words of 64 bits in a bitmap of keys, at least and at most; a quarter as many as there are keys is wanted. As rows that is 4 to 34 MB.
BITMAP_WORDS, MOST_WORDS = 1 << 18, 1 << 21
#: A key with more than one row in so many is hot; there are fewer of them than this.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only in a local session that names none."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folioflow-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder in any file system that the session knows; one that is gone, or a session that has ended, is no error."""
    with contextlib.suppress(Exception):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, across its tasks."""
    return sys.__dict__.setdefault("_folioflow_worker_cache", {})


def memo(name: str, make):
    """A large table that the worker keeps while tasks ask for it by this name; a task that runs without it drops it."""
    cache = worker_cache()
    if cache.get("memo", (None,))[0] != name:
        cache["memo"] = (name, make())
    return cache["memo"][1]


def _trim() -> None:
    """Give freed memory back to the system, which counts it against the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run, schema, uses: str | None = None) -> DataFrame:
    """``mapInArrow`` in batches small enough for a worker, whatever the length of the texts.

    The limits of a batch are settings of the session that Spark reads when it runs the plan, so they are set for the
    session and stay. ``uses`` names the memo that ``run`` asks for; a worker that has another one drops it first.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def task(batches):
        if worker_cache().get("memo", (None,))[0] != uses:
            worker_cache().pop("memo", None)
            _trim()
        yield from run(batches)
        _trim()

    return df.mapInArrow(task, schema)


def texts(batch: pa.RecordBatch, name: str) -> list:
    """The strings of a column, null as empty."""
    return [x if x is not None else "" for x in batch.column(name).to_pylist()]


def chunks(values: list, limit: int = 4 << 20, most: int = 1000):
    """Index ranges of at most ``most`` values whose summed length stays near ``limit`` characters (one value at least)."""
    start = total = 0
    for i, v in enumerate(values):
        if i > start and (total + len(v) > limit or i - start >= most):
            yield start, i
            start, total = i, 0
        total += len(v)
    if start < len(values):
        yield start, len(values)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of unsigned 64-bit integers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd base, modulo 2**64; negative bases mean the inverse's."""
    cache = worker_cache()
    known = cache.get(("powers", base))
    if known is None or len(known) < n:
        step = np.full(max(n, 1 << 14), pow(-base, -1, MASK64 + 1) if base < 0 else base, np.uint64)
        step[0] = 1
        known = cache["powers", base] = np.multiply.accumulate(step)
    return known[:n]


class Rolling:
    """Hashes of any ranges of one sequence of numbers."""

    def __init__(self, hashes: np.ndarray, base: int):
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers(base, len(hashes)), dtype=np.uint64)))
        self.back = powers(-base, len(hashes))

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        return mix64((self.sums[starts + size] - self.sums[starts]) * self.back[starts])


class Bits(NamedTuple):
    """Rows ``__word_``, ``__bits_``: which hashes of keys are there, in a bitmap of so many words."""

    rows: DataFrame
    words: int


def bitmap(keys: DataFrame, key: str) -> Bits:
    """A bitmap of the keys, which are counted first; it is broadcast, so its size has a bound, beyond which it fills up."""
    wanted = max(BITMAP_WORDS, min(MOST_WORDS, keys.count() // 4))
    words = 1 << (wanted - 1).bit_length()
    return Bits(_places(keys, key, words).groupBy("__word_").agg(F.bit_or(F.expr("shiftleft(1L, __bit_)")).alias("__bits_")), words)


def _places(df: DataFrame, key: str, words: int) -> DataFrame:
    h = F.xxhash64(F.col(key))
    return df.withColumns({"__word_": F.pmod(h, F.lit(words)), "__bit_": F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")})


def split(df: DataFrame, key: str, bits: Bits) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be in the bitmap, and the others."""
    marked = _places(df, key, bits.words).join(F.broadcast(bits.rows), "__word_", "left")
    there = F.col("__bits_").isNotNull() & F.expr("(shiftrightunsigned(__bits_, __bit_) & 1) = 1")
    clean = lambda x: x.drop("__word_", "__bit_", "__bits_")
    return clean(marked.where(there)), clean(marked.where(~F.coalesce(there, F.lit(False))))


def spread_join(df: DataFrame, small: DataFrame, key: str, many: str, how: str = "inner") -> DataFrame:
    """``df`` joined with ``small``, which has one row for each key and the number of its rows in ``df``, by a column of that name.

    Hot keys are joined where their rows are: fewer than ``HOT`` rows of ``small`` have more than their share of all, and these are broadcast. Only
    the rows of other keys are shuffled, so no task gets a large group. Both frames are read several times and should be materialised.
    """
    total = small.agg(F.sum(many)).first()[0] or 0
    hot, cold = small.where(F.col(many) > total // HOT), small.where(F.col(many) <= total // HOT)
    rest = df.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.drop(many), key, how)
    return df.join(F.broadcast(hot.drop(many)), key).unionByName(rest)
