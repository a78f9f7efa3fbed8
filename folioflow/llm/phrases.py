"""Removal of passages that a document with a smaller id holds already.

A window is ``WINDOW`` consecutive words. It goes if its word sequence also starts somewhere in a document with a
smaller id. The search works on repeated phrases:

1. Scan: of the ``PHRASE``-word phrases in a window, the one with the least hash stands for it, so that equal
   windows pick equal phrases. About one word in twenty begins such a phrase. Documents with equal texts are one
   here: all but the one with the least id are repeated as a whole.
2. Phrases that stand in two or more different texts recur; the document with the least id owns them.
3. The recurring phrases are dealt into shards by owner, and each shard's are compiled into an Aho-Corasick
   automaton whose letters are words. A document is streamed through the automata of the shards whose phrases it
   shares, which locates every occurrence. So the work grows with the text, not with text times shards. Shards
   that more documents visit than the average are salted: each salt has the shard's phrases and a part of its visitors. Shards and their further
   salts are numbered and dealt to tasks by number, so that tasks are even. Of all shards those are salted that have more than
   their share of ``SALTED`` parts of the visits, so that their table, which is broadcast, has a bound.
4. Every window round an occurrence is confirmed by a hash of 96 bits: its least document is an aggregate, and the
   windows of other documents go.
5. Texts with something to remove are read again and edited; all others pass without a shuffle.

Which documents are read again is told by a bitmap of bounded size over hashes of ids; where it fills up at very
large inputs, more texts are shuffled and none is missed.

Defined results: null text has no words; documents of fewer than ``WINDOW`` words stay whole; windows that
repeat within one document only stay; rows with equal doc_id are not smaller than each other, and rows with
a null doc_id lose nothing and take nothing from others; an empty table gives no rows. Other columns are kept.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import BASES, Rolling, bitmap, cut, map_arrow, memo, shuffle_partitions, split, spread_join, texts

WINDOW = 50
PHRASE = 10
#: Phrases of one automaton, on average at most.
AUTOMATON = 20_000
#: Shards that are salted at most; tasks for each shuffle partition at most; visitors of a salt at least.
SALTED, TASKS, VISITORS = 100_000, 8, 100
#: Entries of the memo of word hashes; a full memo is emptied.
MEMO = 300_000

WORDS = "word hashes"


class Words(dict):
    """Hash of each word (bytes)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        made = self[word] = xxhash.xxh64_intdigest(word)
        return made


def word_hashes(text: str) -> np.ndarray:
    known = memo(WORDS, Words)
    words = text.encode("utf-8", "replace").split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def anchors(hashes: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the phrases that stand for the document's windows."""
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = Rolling(hashes, BASES[0]).at(np.arange(len(hashes) - phrase + 1), phrase)
    span = window - phrase + 1
    least = np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1)
    starts = np.unique(least + np.arange(len(least)))
    return starts, grams[starts]


def spelled(hashes: np.ndarray) -> str:
    """One letter for each word: 20 bits of its hash, as a code point above 0xFFFF."""
    return ((hashes >> np.uint64(44)).astype(np.uint32) + np.uint32(0x10000)).tobytes().decode("utf-32-le")


def scan(docs: DataFrame, doc_id: str, text: str, window: int, phrase: int) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [np.unique(anchors(word_hashes(x), window, phrase)[1]).view(np.int64) for x in texts(batch, text)]
            sizes = np.cumsum([0, *map(len, found)])
            flat = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in (doc_id, "tag", "whole")]
                                             + [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))],
                                             names=["doc", "tag", "whole", "anchors"])

    rows = docs.where(F.col(doc_id).isNotNull()).select(doc_id, text, F.xxhash64(text).alias("tag"), F.md5(F.col(text).cast("binary")).alias("whole"))
    return map_arrow(rows, run, f"doc {kind}, tag long, whole string, anchors array<long>", WORDS).where("size(anchors) > 0")


def locate(docs: DataFrame, visits: DataFrame, salts: DataFrame, doc_id: str, text: str, window: int, phrase: int, shards: int, tasks: int) -> DataFrame:
    """Windows round the occurrences of recurring phrases: ``doc``, ``tag`` and arrays of hash, check and first start.

    ``salts`` has ``shard``, ``salts`` and ``before``, the further salts of the shards before it, for shards with more than one salt.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def deal(batches):
        """A row for each shard that a document visits, and a row for each phrase that it owns."""
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                out += [(s, 1, row["doc"], row["tag"], row["text"]) for s in row["shards"]]
                if row["own"]:
                    hashes = word_hashes(row["text"])
                    starts, grams = anchors(hashes, window, phrase)
                    owned = np.isin(grams.view(np.int64), np.array(row["own"], np.int64))
                    letters = spelled(hashes)
                    out += [(row["home"], 0, None, None, letters[a : a + phrase]) for a in starts[owned].tolist()]
            for a in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 1000]), types)],
                                                 names=["shard", "kind", "doc", "tag", "text"])

    def search(batches):
        shard = automaton = None
        for batch in batches:
            made: list[tuple] = []
            for row in batch.to_pylist():
                key = (row["shard"], row["salt"])
                if key != shard:
                    shard, automaton, ready = key, ahocorasick.Automaton(ahocorasick.STORE_LENGTH), False
                if row["kind"] == 0:
                    automaton.add_word(row["text"])
                    continue
                if not len(automaton):
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                hashes = word_hashes(row["text"])
                if len(hashes) < window:
                    continue
                ends = np.fromiter((end for end, _ in automaton.iter(spelled(hashes))), np.int64)
                if not len(ends):
                    continue
                count = len(hashes) - window + 1
                edge = np.zeros(count + 1, np.int64)
                np.add.at(edge, np.clip(ends + 1 - window, 0, count), 1)
                np.add.at(edge, np.clip(ends + 1 - phrase + 1, 0, count), -1)
                starts = np.flatnonzero(np.cumsum(edge[:-1]))
                wide, more = (Rolling(hashes, b).at(starts, window) for b in BASES)
                # A window that the document repeats is told once, at its first start.
                order = np.lexsort((starts, more, wide))
                wide, more, starts = wide[order], more[order], starts[order]
                new = np.concatenate(([True], (wide[1:] != wide[:-1]) | (more[1:] != more[:-1])))
                made.append((row["doc"], row["tag"], wide[new].view(np.int64), (more[new] >> np.uint64(32)).astype(np.uint32).view(np.int32), starts[new].astype(np.int32)))
            if made:
                ends = pa.array(np.concatenate(([0], np.cumsum([len(m[2]) for m in made]))), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], types[2]), pa.array([m[1] for m in made], pa.int64())]
                                                 + [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([m[i] for m in made]))) for i in (2, 3, 4)],
                                                 names=["doc", "tag", "wide", "more", "start"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [pa.int32(), pa.int32(), to_arrow_type(docs.schema[doc_id].dataType), pa.int64(), pa.string()]
    whole = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("tag")).join(visits, "doc")
    dealt = map_arrow(whole, deal, f"shard int, kind int, doc {kind}, tag long, text string", WORDS)
    # Phrases go to every salt of their shard, documents to one.
    salted = dealt.join(F.broadcast(salts), "shard", "left").fillna({"salts": 1, "before": 0}).withColumn(
        "salt", F.explode(F.expr("IF(kind = 0, sequence(0, salts - 1), array(CAST(pmod(xxhash64(doc, tag), salts) AS INT)))")))
    placed = salted.withColumn("place", F.expr(f"IF(salt = 0, CAST(shard AS BIGINT), {shards} + before + salt - 1)")).drop("salts", "before")
    ordered = placed.repartitionById(tasks, F.pmod("place", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "salt", "kind")
    return map_arrow(ordered, search, f"doc {kind}, tag long, wide array<long>, more array<int>, start array<int>", WORDS)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``doc``, ``tag`` (hash of the text) and ``starts``: the first starts of the windows to remove, which go wherever they stand in the text; null: all words go."""
    spark, n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    scanned = cut(scan(docs, doc_id, text, window, phrase))
    first = cut(scanned.groupBy("whole").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"))
    copies = cut(spread_join(scanned.select("doc", "tag", "whole"), first, "whole", "n").where("doc > first").select("doc", "tag"))
    # Copies pass on nothing that the first of them doesn't.
    maybe, rest = split(scanned, "doc", bitmap(copies, "doc"))
    once = rest.unionByName(maybe.join(copies, ["doc", "tag"], "left_anti"))
    single = once.select("doc", F.explode("anchors").alias("a"))
    recurring = cut(single.groupBy("a").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).where("owner < last").select("a", "owner"))
    shards = max(n, -(-recurring.count() // AUTOMATON))
    home = f"CAST(pmod(xxhash64(owner), {shards}) AS INT)"
    visits = cut(single.join(recurring, "a").withColumn("home", F.expr(home)).groupBy("doc").agg(
        F.collect_set("home").alias("shards"), F.collect_set(F.expr("IF(doc = owner, a, NULL)")).alias("own"),
        F.max(F.expr("IF(doc = owner, home, NULL)")).alias("home")))
    loads = visits.select(F.explode("shards").alias("shard")).groupBy("shard").count()
    total = visits.agg(F.sum(F.size("shards"))).first()[0] or 0
    limit = max(VISITORS, total // shards, total // SALTED)
    salts = cut(loads.where(F.col("count") > limit).select("shard", F.expr(f"CAST(ceil(count / {limit}) AS INT)").alias("salts")).withColumn(
        "before", F.coalesce(F.sum(F.col("salts") - 1).over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    further = salts.agg(F.sum(F.col("salts") - 1)).first()[0] or 0
    again, _ = split(docs, doc_id, bitmap(visits, "doc"))
    windows = cut(locate(again, visits, salts, doc_id, text, window, phrase, shards, min(shards + further, TASKS * n)))
    each = windows.select("doc", "tag", F.expr("inline(arrays_zip(wide, more, start))"))
    least = each.groupBy("wide", "more").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("least < last").drop("last")
    gone = each.join(least, ["wide", "more"]).where("doc > least").select("doc", "tag", "start")
    both = gone.unionByName(copies.withColumn("start", F.lit(None).cast("int")))
    return cut(both.groupBy("doc", "tag").agg(F.expr("IF(bool_or(start IS NULL), NULL, collect_set(start))").alias("starts")))


def covered(text: str, starts, window: int) -> tuple[list[bytes], np.ndarray]:
    """The words of a text, and which of them are in windows equal to those at ``starts``; all for None."""
    words = text.encode("utf-8", "replace").split()
    if starts is None:
        return words, np.ones(len(words), bool)
    hashes = word_hashes(text)
    places = np.arange(len(words) - window + 1)
    gone = np.ones(len(places), bool)
    for base in BASES:
        found = Rolling(hashes, base).at(places, window)
        gone &= np.isin(found, found[np.asarray(starts, np.int64)])
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, places[gone], 1)
    np.add.at(edge, places[gone] + window, -1)
    return words, np.cumsum(edge[:-1]) > 0


def edit(docs: DataFrame, found: DataFrame, make, fields: list[T.StructField], doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` with columns that ``make(text, kept words or None)`` gives; None: nothing is removed.

    ``found`` is the result of ``repeats``. Only texts with a removal are shuffled (and those that the bitmap
    can't tell from them).
    """
    names = [f.name for f in fields]
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *fields])
    from pyspark.sql.pandas.types import to_arrow_type

    def run(batches):
        for batch in batches:
            rows = texts(batch, text)
            remove = batch.column("__found_").to_pylist() if "__found_" in batch.schema.names else [False] * len(rows)
            starts = batch.column("__starts_").to_pylist() if "__starts_" in batch.schema.names else [None] * len(rows)
            out = []
            for x, there, at in zip(rows, remove, starts):
                if there:
                    words, gone = covered(x, at, window)
                    out.append(make(x, [w for w, g in zip(words, gone.tolist()) if not g]))
                else:
                    out.append(make(x, None))
            columns = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*out), fields)] if out else [pa.array([], to_arrow_type(f.dataType)) for f in fields]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + columns, names=[*(f.name for f in kept), *names])

    maybe, rest = split(docs, doc_id, bitmap(found, "doc"))
    to = found.select(F.col("doc").alias("__doc_"), F.col("tag").alias("__tag_"), F.col("starts").alias("__starts_"), F.lit(True).alias("__found_"))
    joined = maybe.withColumn("__hash_", F.xxhash64(text)).join(to, (F.col(doc_id) == F.col("__doc_")) & (F.col("__hash_") == F.col("__tag_")), "left")
    joined = joined.withColumn("__found_", F.coalesce("__found_", F.lit(False))).drop("__doc_", "__tag_", "__hash_")
    return map_arrow(joined, run, schema, WORDS).unionByName(map_arrow(rest, run, schema, WORDS))
