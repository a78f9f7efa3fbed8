"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

import atexit
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm import bpe, decontaminate, fingerprints, htmltext, langid, licenses, phrases, sharding, simhash, warc
from folioflow.llm.common import checkpoint_dir, drop, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 contiguous shards of near equal bytes. Equal texts stand together, so that only groups on a cut are split."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(text).alias("n_bytes"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.contiguous_shards(rows, 16, F.col("n_bytes").cast("long") + 1, ["text_crc32", "n_bytes", "doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the labelled documents that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole text and the bytes that they decode to, as digests."""
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded="decoded").drop("text")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents, verbatim or with other parameters."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, and their likeness."""
    return fingerprints.with_next(table(spark, sf_dir, "documents"), fingerprints.compare, fingerprints.FIELDS)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements of every whole text."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"), F.array_max("base.start").cast("long").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"), joined(F.concat("base.label", "detections.label")).alias("labels"),
        F.greatest(F.coalesce(F.array_max("detections.confidence"), F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _removal(text: str, kept: list[bytes] | None) -> tuple[int, int, str]:
    words = text.encode().split()
    left = words if kept is None else kept
    return len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages that a smaller doc_id holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    return phrases.edit(docs, phrases.repeats(docs), _removal, fields).drop("text")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold, after they were written to the shared folder and read again."""
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    warc.write(warc.captures(table(spark, sf_dir, "pages")), path)
    stored = F.col("record_type") == "response"
    return warc.read(spark, path).select(
        warc.page_of("record_id").alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.expr("substring(payload_digest, 6)")).alias("payload_digest"),
        "record_type", warc.page_of("refers_to").alias("refers_to"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_language_id, op3_byte_bpe, op4_decontamination, op5_lz_fingerprint, op6_license_scan, op7_simhash, op8_warc, op9_substring_dedup, op10_html_text)}

#: DuckDB SQL where SQL can express a query.
ORACLES: dict[str, str] = {
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
     m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
""",
    "op9_substring_dedup": """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     n AS (SELECT doc_id, w, len(w) AS n FROM d),
     s AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
           FROM (SELECT doc_id, w, unnest(range(1, n - 48)) AS i FROM n WHERE n >= 50)),
     f AS (SELECT h, min(doc_id) AS least FROM s GROUP BY h),
     g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM s JOIN f USING (h) WHERE doc_id > least),
     r AS (SELECT doc_id, list(k) AS ks, count(*) AS n_removed FROM g GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_words, coalesce(r.n_removed, 0) AS n_removed,
       sha256(array_to_string(CASE WHEN r.ks IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(r.ks, k)) END, ' ')) AS kept_sha256
FROM n LEFT JOIN r USING (doc_id)
""",
}
