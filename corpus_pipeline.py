"""From raw documents to token ids, stage by stage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents:

1. Language ID: documents without a letter, or in no language that the labelled ones teach, go.
2. Near-dedup: of documents linked by a similarity of 0.8 of their five-word shingles, one stays. SimHash fingerprints
   find them, confirmed by the shingles; the pairs that fingerprints leave are found by the shingles alone.
3. Substring dedup: passages that a document with a smaller id holds are cut out; a document that loses every word goes.
4. Benchmark decontamination: documents that hold a benchmark item go.
5. Byte-level BPE: token ids, and the text as it is decoded from them.

Defined results, in all stages: an empty table gives no rows; columns beyond those of documents are dropped, also where they have the name of a
result; texts of any length are taken whole. A null text has no letter and goes in stage 1; given to a later stage, it counts as empty. A null
doc_id takes part, but only where nothing has to be told by it: stage 2 keeps another row of its group if there is one with an id, stage 3 cuts nothing out of
it or because of it, stage 4 keeps it. Null languages, sources and counts are passed on; languages that are null teach nothing. Repeated rows are
near copies of each other: stage 2 leaves one of them; the other stages treat each row for itself, and rows with equal ids and unequal texts likewise. Of rows
that tie (equal ids in one group) stage 2 keeps that with the least text hash; of equally near languages the first in order counts.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm import bpe, decontaminate, langid, near, phrases
from folioflow.llm.common import checkpoint_dir, drop, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs.select(COLUMNS))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs.select(COLUMNS)).select(COLUMNS)


def _kept(text: str, words: list[bytes] | None) -> tuple[str, int]:
    if words is not None:
        text = b" ".join(words).decode()
    return text, len(text)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    docs = docs.select(COLUMNS)
    return phrases.edit(docs, phrases.repeats(docs), _kept, fields).where("text != ''").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark")).select(COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs.select(COLUMNS), decoded="text", lean=True).withColumn("text", F.col("text").cast("string"))
    return coded.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Hashing, automata and merges are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents that all stages keep. Each stage's documents are written to the shared checkpoint folder; those of the stage before go then."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    atexit.register(drop, spark, folder)
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
