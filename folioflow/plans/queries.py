"""The engine's operators as queries over the driver's tables, one for each entry of the inventory.

Lines of ``documents`` stand for text blocks; their boxes, sizes and fonts are made from their place in whole numbers, so that other
engines compute the same.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import geometry, model_json, text
from folioflow.functions.classify import block_kind
from folioflow.functions.config import Options, LlmOptions, parse_pages
from folioflow.operators import assign, layout, merge, metrics, paragraphs, requests, segments, translate
from folioflow.plans import pipeline
from folioflow.sources import blocks as json_blocks
from folioflow.sources.translators import Mapped

LIMIT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan in no fewer partitions than there are cores: a small table in one file is dealt to all; a larger one is read as it lies, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    cell = F.col("pos") % 12
    y0 = 60 + 100 * (cell % 6) + F.when((F.col("doc_id") + F.col("pos")) % 7 == 0, 30).otherwise(0)
    rows = lines.withColumns({"page": F.expr("CAST(pos div 12 AS INT)"), "block_idx": cell.cast("int"), "x0": (40 + 280 * F.expr("pos % 12 div 6")).cast("double"),
                              "y0": y0.cast("double")})
    return rows.select(
        "doc_id", "lang", F.col("pos").cast("long").alias("ordinal"), "page", "block_idx", F.col("block_idx").alias("reading_order"), "text",
        F.when((F.col("doc_id") * 3 + F.col("pos")) % 11 == 0, 20.0).otherwise(11.0).alias("size"),
        F.when((F.col("doc_id") + F.col("pos")) % 5 == 0, "F1").otherwise("F0").alias("font"),
        "x0", "y0", (F.col("x0") + 220).alias("x1"), (F.col("y0") + 80).alias("y1"), F.lit(220.0).alias("width"), F.lit(80.0).alias("height"),
        (2 + F.col("pos") % 3).cast("int").alias("line_count"))


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_blocks(spark, sf_dir).withColumn("kind", block_kind(F.col("text"), F.col("size")))


def page_rects(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "page").distinct().select("doc_id", "page", *(F.lit(float(v)).alias(k) for k, v in (
        ("page_x0", 0), ("page_y0", 0), ("page_x1", 600), ("page_y1", 800))))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line blocks with their kind and their page's box."""
    rows = kinds(spark, sf_dir).withColumnRenamed("kind", "segment_kind")
    return rows.withColumns({k: F.lit(float(v)) for k, v in (("page_x0", 0), ("page_y0", 0), ("page_x1", 600), ("page_y1", 800))})


def q01_line_blocks(spark, sf_dir):
    """Blocks with their layout."""
    cast = {"page": "long", "block_idx": "long", "line_count": "long"}
    return line_blocks(spark, sf_dir).select(*(F.col(c).cast(cast.get(c, "double" if c in ("size", "x0", "y0", "x1", "y1") else "string" if c in ("text", "font") else "long")).alias(c)
                                               for c in ("doc_id", "ordinal", "page", "block_idx", "text", "size", "font", "x0", "y0", "x1", "y1", "line_count")))


def q02_normalized_text(spark, sf_dir):
    """White space, hyphens and paragraph breaks of whole documents."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.normalize(F.col("text")).alias("flat"), text.for_translation(F.col("text")).alias("kept"),
        text.for_translation(F.col("text"), False).alias("flattened"))


def q03_block_kind(spark, sf_dir):
    return kinds(spark, sf_dir).select("doc_id", "ordinal", "kind")


def q04_kind_histogram(spark, sf_dir):
    return kinds(spark, sf_dir).groupBy("lang", "kind").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


def q05_kind_quality(spark, sf_dir):
    joined = kinds(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("kind", F.col("quality").cast("long").alias("quality")).agg(F.count("*").alias("blocks"), F.sum("toxic").alias("toxic"))


def q06_merge_reason(spark, sf_dir):
    return segments.with_reasons(line_blocks(spark, sf_dir)).select("doc_id", "ordinal", "reason")


def q07_segments(spark, sf_dir):
    return segments.segmented(line_blocks(spark, sf_dir)).select("doc_id", "ordinal", "segment_id", "merged")


def q08_segment_rollup(spark, sf_dir):
    runs = segments.segments(line_blocks(spark, sf_dir))
    return runs.select("doc_id", "segment_id", "kind", F.size("blocks").cast("long").alias("blocks"),
                       F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.length(b["text"])).alias("chars"), F.array_join("merge_reasons", ",").alias("reasons"))


def q09_page_items(spark, sf_dir):
    pages = requests.page_items(line_blocks(spark, sf_dir))
    return pages.select("doc_id", F.col("page").cast("long").alias("page"), F.array_join("items.id", ",").alias("ids"),
                        F.array_join("items.kind", ",").alias("kinds"), F.array_join("items.t", "\n").alias("texts"))


def q10_request_payload(spark, sf_dir):
    sized = requests.requests(requests.page_items(line_blocks(spark, sf_dir)))
    return sized.select("doc_id", F.col("page").cast("long").alias("page"), "payload")


def q11_page_stats(spark, sf_dir):
    """Flagship: how large the translation request of every page is, and which are over the limit."""
    return requests.page_stats(line_blocks(spark, sf_dir), LIMIT).withColumn("page", F.col("page").cast("long"))


def q12_conversation_items(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.lit(0).cast("long").alias("doc_id"), F.col("conv_id").alias("page"), F.col("turn").alias("block_idx"), "text")
    sized = requests.requests(requests.page_items(rows))
    return sized.select(F.col("page").alias("conv_id"), "n_items", "input_chars", "payload_chars", "estimated_prompt_tokens")


def _shout(spark, sf_dir):
    return translate.translate_blocks(line_blocks(spark, sf_dir), Mapped("T:{}".format), Options(google_max_workers=4), pause=0)


def q13_single_block(spark, sf_dir):
    """Block by block with a translator that marks what it got, on the executors."""
    return _shout(spark, sf_dir).select("doc_id", "ordinal", "text", "original_text")


def q14_merge_results(spark, sf_dir):
    """Results of some pages, the last of repeated ones, joined onto all blocks."""
    blocks = line_blocks(spark, sf_dir)
    wanted = requests.select_pages(blocks, parse_pages("0,2-3,x"))
    once = wanted.select("doc_id", "page", "block_idx", F.concat(F.lit("a:"), "text").alias("translated"), F.lit(1).alias("version"))
    twice = wanted.where("block_idx % 2 = 0").select("doc_id", "page", "block_idx", F.concat(F.lit("b:"), "text").alias("translated"), F.lit(2).alias("version"))
    out = merge.merge_results(blocks, once.unionByName(twice), block_kind(F.col("text"), F.col("size")), order="version")
    return out.select("doc_id", "ordinal", "text", "original_text", "segment_kind")


def q15_capacity(spark, sf_dir):
    room = assign.capacity(F.col("text"), F.col("width"), F.col("size"), F.col("line_count"))
    return line_blocks(spark, sf_dir).select("doc_id", "ordinal", F.round(room, 6).alias("capacity"))


def q16_id_difference(spark, sf_dir):
    """What answers leave out and add, and the first of repeated ones."""
    rows = requests.items(line_blocks(spark, sf_dir))
    answers = rows.where("ordinal % 7 != 0").select("doc_id", "page", F.when(F.col("ordinal") % 10 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"), "ordinal")
    again = answers.where("ordinal % 3 = 0").withColumn("ordinal", F.col("ordinal") + 1000)
    answers = merge.first_by_id(answers.unionByName(again), "ordinal", ["doc_id", "page", "id"])
    asked = rows.groupBy("doc_id", "page").agg(F.collect_set("id").alias("asked"))
    back = answers.groupBy("doc_id", "page").agg(F.collect_set("id").alias("back"), F.sum("ordinal").alias("ordinals"))
    both = asked.join(back, ["doc_id", "page"], "left").withColumn("back", F.coalesce("back", F.array().cast("array<string>")))
    missing, extra = merge.id_difference(F.col("asked"), F.col("back"))
    return both.select("doc_id", F.col("page").cast("long").alias("page"), F.array_join(F.array_sort(missing), ",").alias("missing"),
                       F.array_join(F.array_sort(extra), ",").alias("extra"), F.coalesce("ordinals", F.lit(0)).alias("ordinals"))


def q17_call_metrics(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    calls = events.select((F.col("event_type") != "error").alias("ok"), (F.floor(F.col("value") * 100)).cast("double").alias("elapsed"), F.lit(None).cast("long").alias("prompt_tokens"),
                          k.alias("completion_tokens"), F.lit(None).cast("long").alias("total_tokens"), (k * 7).alias("prompt_chars"),
                          F.lit(0).cast("long").alias("completion_chars"), F.pmod("user_id", F.lit(10)).alias("worker"))
    return metrics.call_metrics(calls, ["worker"])


def q18_translated_count(spark, sf_dir):
    return merge.translated_count(_shout(spark, sf_dir), ["lang"])


def q19_body_paragraphs(spark, sf_dir):
    body = geometry.is_body(F.col("segment_kind"), F.col("text"), F.col("line_count"), F.col("width"), F.col("size"), layout.page_width(), layout.page_height())
    return placed(spark, sf_dir).select("doc_id", "ordinal", body.alias("body"), geometry.body_size_limit(layout.page_height()).alias("size_limit"))


def q20_decorative(spark, sf_dir):
    """With boxes large enough to matter."""
    rows = placed(spark, sf_dir).withColumns({"x1": F.col("x0") + 200 + 40 * (F.col("ordinal") % 9), "y1": F.col("y0") + 60 * (F.col("ordinal") % 11)})
    return layout.decorated(rows).select("doc_id", "ordinal", "decorative")


def q21_right_neighbor(spark, sf_dir):
    return layout.right_neighbors(placed(spark, sf_dir)).select("doc_id", "ordinal", "neighbor_x0")


def q22_adjusted_box(spark, sf_dir):
    return layout.adjusted(layout.right_neighbors(placed(spark, sf_dir))).select("doc_id", "ordinal", "adjusted_x1", F.col("align").cast("long").alias("align"))


def q23_padded_box(spark, sf_dir):
    top, bottom = geometry.padded(F.col("segment_kind"), F.col("size"), F.col("y0"), F.col("y1"), F.col("page_y0"), F.col("page_y1"))
    return placed(spark, sf_dir).select("doc_id", "ordinal", F.round(top, 6).alias("top"), F.round(bottom, 6).alias("bottom"))


def q24_column_size(spark, sf_dir):
    """The size that body paragraphs of a column share; left edges and widths vary, so that a block's column depends on those before it."""
    left, width = F.col("x0") + (F.col("doc_id") + 13 * F.col("ordinal")) % 50, (220 - 25 * (F.col("ordinal") % 5)).cast("double")
    rows = placed(spark, sf_dir).withColumns({"x0": left, "width": width})
    return layout.body_columns(rows).select("doc_id", "ordinal", "col_group", F.round("target_size", 6).alias("target_size"))


def q25_paragraph_groups(spark, sf_dir):
    """Lines of a page, at indents made from their place, grouped into text blocks; some pages are images."""
    rows = line_blocks(spark, sf_dir)
    span = F.struct(F.col("text").alias("text"), F.col("font").alias("font"), F.col("size").alias("size"), F.lit(255).alias("color"))
    left = (F.col("x0") + 25 * (F.col("ordinal") % 3))
    line = F.struct("block_idx", F.struct(F.array(left, F.col("y0"), F.col("x1"), F.col("y1")).alias("bbox"), F.array(span).alias("spans")).alias("line"))
    raw = rows.groupBy("doc_id", "page").agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]).alias("lines"))
    raw = raw.select("doc_id", "page", F.lit(0).alias("block_no"), F.when(F.col("page") % 7 == 3, 1).otherwise(0).alias("type"),
                     F.array(*map(F.lit, (0.0, 0.0, 600.0, 800.0))).alias("bbox"), "lines")
    out = paragraphs.extract_blocks(raw)
    return out.select("doc_id", F.col("page").cast("long").alias("page"), F.col("block_idx").cast("long").alias("block_idx"), "text", "x0", "y1", "size", "font",
                      F.element_at("color", 3).alias("blue"), F.col("line_count").cast("long").alias("line_count"))


#: What is put round a line, its digits replaced, before it is cleaned: list markers, ideographs, lines of quotes, closing marks.
DRESSED = [("• ", " (2) two 3. three ③ four"), ("日 本 語 ", " 50 % 日本 A1 漢 字 "), ("", "\n」\n  next   line\n“"), ("", " 12) end」” ")]


def q26_render_text(spark, sf_dir):
    """Text as it is set, as a list, a paragraph and otherwise."""
    plain, n = F.regexp_replace("text", "[0-9]", "x"), F.col("ordinal") % 4
    dressed = F.coalesce(*(F.when(n == i, F.concat(F.lit(a), plain, F.lit(b))) for i, (a, b) in enumerate(DRESSED)))
    kind = F.element_at(F.array(*map(F.lit, ("list", "paragraph", "toc"))), (F.col("ordinal") % 3 + 1).cast("int"))
    return line_blocks(spark, sf_dir).select("doc_id", "ordinal", text.render_text(dressed, kind).alias("set_text"))


def q27_chunk_assign(spark, sf_dir):
    """Sentences of each segment dealt to its blocks."""
    runs = segments.segments(line_blocks(spark, sf_dir))
    joined = F.array_join(F.transform("blocks", lambda b: text.for_translation(b["text"])), "\n\n")
    room = F.transform("blocks", lambda b: assign.capacity(b["text"], b["width"], b["size"], b["line_count"]))
    dealt = assign.deal_chunks(text.sentence_chunks(text.normalize(F.regexp_replace(joined, r"\.", "!"))), room)
    return runs.select("doc_id", "segment_id", F.size("blocks").alias("n_blocks"), F.coalesce(F.array_join(dealt, "|"), F.lit("-")).alias("dealt"))


def q28_structured_response(spark, sf_dir):
    """Items of the JSON that a request carries, read back."""
    sized = requests.requests(requests.page_items(line_blocks(spark, sf_dir)))
    return sized.select("doc_id", F.col("page").cast("long").alias("page"), F.size(model_json.native_items(F.col("payload"))).cast("long").alias("items"), translate.request_summary(F.col("payload"))["first_id"].alias("first_id"))


def q29_pages_translated(spark, sf_dir):
    """Page mode with a translator that marks what it got, on the executors."""
    options = Options(engine="llm", llm=LlmOptions(max_workers=4))
    out = pipeline.translate_documents(line_blocks(spark, sf_dir), Mapped("T:{}".format), options, pause=0)
    return out.blocks.select("doc_id", "ordinal", "text", "segment_kind")


def q30_render_plan(spark, sf_dir):
    """Box, size and alignment of every block."""
    blocks = kinds(spark, sf_dir).withColumnRenamed("kind", "segment_kind")
    plan = layout.render_plan(blocks, page_rects(blocks)).drop("color")
    return plan.withColumns({c: F.col(c).cast("long") for c in ("page", "block_idx", "align")})


def _exclaim(text: str) -> str:
    return "<" + text.replace(".", "!") + ">"


def q31_segments_translated(spark, sf_dir):
    """Segment mode with a translator that ends sentences anew, so that answers are dealt back; equal requests are sent once."""
    options = Options(engine="google", google_max_workers=4, deduplicate=True)
    out = pipeline.translate_documents(line_blocks(spark, sf_dir), Mapped(_exclaim), options, pause=0)
    return out.blocks.select("doc_id", "ordinal", "text", "segment_kind")


def q32_packed_requests(spark, sf_dir):
    runs = segments.segments(line_blocks(spark, sf_dir))
    return translate.packed(runs).select("doc_id", "segment_id", F.col("pack").cast("long").alias("pack"))


def q33_segment_records(spark, sf_dir):
    return segments.debug_records(segments.segments(line_blocks(spark, sf_dir))).select("doc_id", "segment_id", "kind", F.to_json("block_refs").alias("block_refs"), "source_preview")


def q34_marked_split(spark, sf_dir):
    """Marked requests of segments, some with words before them and a repeated marker, some cut off, split again."""
    runs = segments.segments(line_blocks(spark, sf_dir))
    sent, n, last = segments.segment_payload(F.col("blocks")), F.col("segment_id") % 3, F.size("blocks") - 1
    changed = F.when(n == 1, F.regexp_replace(sent, F.concat(F.lit(r"\[\[block "), last.cast("string"), F.lit(r"\]\]")), F.lit("(gone)"))).when(
        n == 2, F.concat(F.lit("Sure:\n"), sent, F.lit("\n [[block 0]] \nagain\n"))).otherwise(sent)
    back = assign.split_marked(changed, F.size("blocks"))
    return runs.select("doc_id", "segment_id", F.coalesce(F.array_join(back, "|"), F.lit("-")).alias("back"))


def q35_wrapped_answers(spark, sf_dir):
    """Answers that are bare, fenced, in a sentence, or cut off, read as a model's."""
    sized = requests.requests(requests.page_items(line_blocks(spark, sf_dir)))
    kind = F.col("page") % 4
    wrapped = F.when(kind == 1, F.concat(F.lit("```json\n"), "payload", F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is: "), "payload", F.lit(" {done}"))).when(
        kind == 3, F.expr("left(payload, length(payload) - 1)")).otherwise(F.col("payload"))

    def run(parts):
        for part in parts:
            found = [model_json.parse_answer(x) for x in part["answer"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "page": part["page"], "items": [-1 if x is None else len(x) for x in found],
                                "texts": ["-" if x is None else "|".join(i["id"] + ":" + i["t"] for i in x) for x in found]})

    return sized.select("doc_id", F.col("page").cast("long").alias("page"), wrapped.alias("answer")).mapInPandas(run, "doc_id long, page long, items long, texts string")


def q36_answer_repair(spark, sf_dir):
    """Answers under other ids, put in their places where there are as many as items; items that got none."""
    pages = requests.page_items(line_blocks(spark, sf_dir))
    answers = F.transform("items", lambda i, n: F.struct(F.concat(F.lit("x"), n.cast("string")).alias("id"), F.concat(F.lit("a:"), i["t"]).alias("t")))
    fewer = F.when(F.col("page") % 3 == 0, F.slice(answers, 1, 2)).otherwise(answers)
    some = F.transform(F.filter("items", lambda i, n: n % 2 == 0), lambda i: F.struct(i["id"].alias("id"), F.when(F.length(i["t"]) % 5 == 0, " ").otherwise("ok").alias("t")))
    placed_ = merge.by_position(F.col("items"), fewer)
    return pages.select("doc_id", F.col("page").cast("long").alias("page"),
                        F.coalesce(F.array_join(F.transform(placed_, lambda x: F.concat(x["id"], F.lit("="), x["t"])), "|"), F.lit("-")).alias("placed"),
                        F.array_join(F.transform(merge.missing_items(F.col("items"), some), lambda i: i["id"]), ",").alias("missing"))


def _summaries(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "page_batch_failed").when(F.col("event_type") == "click", "ok_with_warnings").otherwise("ok")
    return table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(100)).alias("page"), F.pmod("user_id", F.lit(3)).alias("retry_count"),
                                                  F.pmod("event_id", F.lit(5)).alias("source_fallback_blocks"), status.alias("status"))


def q37_page_totals(spark, sf_dir):
    return metrics.page_totals(_summaries(spark, sf_dir))


def q38_rates(spark, sf_dir):
    """Tokens and blocks a second of each worker's calls."""
    rows = metrics.rates(q17_call_metrics(spark, sf_dir), 500, 40.0)
    return rows.select("worker", F.round("tokens_per_second", 6).alias("tokens_per_second"), "blocks_per_second")


def q39_blocks_as_json(spark, sf_dir):
    """Blocks of each document as an array of JSON, and read back."""
    rows = line_blocks(spark, sf_dir).withColumns({"bbox": F.array("x0", "y0", "x1", "y1"), "color": F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)),
                                                    "doc_id": F.col("doc_id").cast("string")})
    back = json_blocks.blocks_of(json_blocks.arrays_of(rows))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "ordinal", F.col("page").cast("long").alias("page"), F.col("block_idx").cast("long").alias("block_idx"),
                       "text", "size", "font", F.element_at("bbox", 4).alias("bottom"), F.element_at("color", 2).alias("green"), "x0", F.col("line_count").cast("long").alias("line_count"))


def _at_most_two(prompt: str, **_) -> str:
    items = json.loads(prompt[prompt.find('{"items":'):])["items"]
    if len(items) > 2:
        raise TimeoutError
    return json.dumps({"items": [{"id": i["id"], "t": "T:" + i["t"]} for i in items]})


class FewItems(Mapped):
    """A translator that runs out of time on more than two items."""

    def complete(self, prompt: str, **options) -> str:
        return _at_most_two(prompt)


def q40_page_ladder(spark, sf_dir):
    """What pages take with a translator that fails on more than two items: halves, quarters, and source texts where even these are too large."""
    options = Options(engine="llm", llm=LlmOptions(max_workers=4))
    found = translate.by_pages(line_blocks(spark, sf_dir), FewItems(str), options, pause=0)
    return found.summaries.select("doc_id", F.col("page").cast("long").alias("page"), "items", "api_calls", "retry_attempts", "source_fallback_blocks", "max_split_level", "status")


def q41_document_outcomes(spark, sf_dir):
    """What becomes of each document where pages have a limit."""
    options = Options(engine="llm", llm=LlmOptions(max_workers=4, page_max_chars=LIMIT * 2))
    found = translate.by_pages(line_blocks(spark, sf_dir), FewItems(str), options, pause=0)
    return found.outcomes.select("doc_id", "status", F.col("page").cast("long").alias("page"), "input_chars", "max_input_chars")


QUERIES = {k: f for k, f in sorted(globals().items()) if k[:1] == "q" and k[1:3].isdigit()}
