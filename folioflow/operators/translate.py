"""Translation of pages and of segments by a translator that runs on the executors.

Requests are built, and answers dealt back, as columns. Python runs only what talks to the translator: one call with its
retries for a segment or a block, and for a page the ladder of halving after failures. Requests are dealt to many small
tasks, so that a lost executor repeats few calls; how many calls run at once on a machine is limited by slots, which are locks on files there
that end with their process. Each stage of calls is materialised once.
"""

from __future__ import annotations

import contextlib
import os
import random
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.classify import block_kind
from folioflow.functions.config import Options, failure_text
from folioflow.functions.model_json import parse_answer
from folioflow.functions.text import for_translation, is_noise, normalize, sentence_chunks
from folioflow.operators import assign, merge, requests, segments
from folioflow.plans.staging import settled
from folioflow.sources.translators import is_timeout, tries
from folioflow.thresholds import DEFAULTS, Thresholds

PAUSE = 0.5
MAX_LEVEL = 2
#: Requests of a task, unless that takes more than so many tasks; answers that go to Spark at once; seconds between looks for a free slot.
TASK_REQUESTS, MOST_TASKS, ANSWERS, LOOK = 64, 20_000, 16, 0.02


@contextlib.contextmanager
def slot(run: str, limit: int):
    """One of ``limit`` places for a call on this machine; waits for one."""
    import fcntl

    folder = os.path.join(tempfile.gettempdir(), f"folioflow-slots-{run}")
    os.makedirs(folder, exist_ok=True)
    while True:
        for n in random.sample(range(limit), limit):
            file = os.open(os.path.join(folder, str(n)), os.O_CREAT | os.O_RDWR)
            try:
                fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                os.close(file)
                continue
            try:
                yield
            finally:
                os.close(file)
            return
        time.sleep(LOOK)


def dealt(requests: DataFrame, workers: int) -> DataFrame:
    """Requests in tasks of ``TASK_REQUESTS``, no fewer tasks than calls at once. ``requests`` is counted, so it should be materialised."""
    tasks = -(-requests.count() // TASK_REQUESTS)
    return requests.repartition(min(max(workers, tasks), MOST_TASKS))


# --- one request for several items -------------------------------------------------------------------------------


def prompt_of(items: list[dict]) -> str:
    import json

    return requests.PROMPT_HEAD + json.dumps({"items": [{"id": i["id"], "t": i["t"]} for i in items]}, ensure_ascii=False, separators=(",", ":"))


def ask_items(items: list[dict], complete: Callable[..., str], temperature: float = 0.2, pause: float = PAUSE) -> tuple[dict | None, dict]:
    """Texts by id, or none, and what happened.

    Three calls at most until something comes back; a timeout ends them at once and asks for a split. An answer that
    can't be read is sent back once to be repaired. Ids that differ from the asked ones are replaced by position if there
    are as many texts as items; else a split is asked for.
    """
    prompt, answer, timeout, calls = prompt_of(items), None, False, 0
    info = {"input_chars": sum(len(i["t"]) for i in items), "items": len(items), "force_split": False, "missing": 0, "extra": 0}
    for _ in range(3):
        calls += 1
        try:
            answer = complete(prompt, structured=True)
        except Exception as e:  # noqa: BLE001
            timeout = is_timeout(e)
            if timeout:
                break
            time.sleep(pause)
            continue
        if answer:
            break
    if not answer:
        return None, info | {"reason": "timeout" if timeout else "empty_response", "force_split": timeout, "calls": calls, "response_chars": 0}
    found = parse_answer(answer)
    if found is None:
        calls += 1
        try:
            found = parse_answer(complete(requests.REPAIR_HEAD.format(len(items)) + answer, structured=True, temperature=min(0.1, temperature)))
        except Exception:  # noqa: BLE001
            found = None
    if found is None:
        return None, info | {"reason": "invalid_json_response", "calls": calls, "response_chars": 0, "preview": answer[:400]}
    by_id: dict[str, str] = {}
    for x in found:
        by_id.setdefault(x["id"], x["t"])
    asked = {i["id"] for i in items}
    info |= {"missing": len(asked - by_id.keys()), "extra": len(by_id.keys() - asked), "calls": calls, "response_chars": len(answer), "reason": "ok"}
    if info["missing"] or info["extra"]:
        info["reason"] = "ok_with_warnings"
        if len(found) == len(items):
            by_id = {i["id"]: x["t"] for i, x in zip(items, found)}
        else:
            info["force_split"] = True
    return by_id, info


# --- a page, halved where it fails -------------------------------------------------------------------------------


def page_ladder(items: list[dict], ask: Callable[[list[dict]], tuple[dict | None, dict]], retries: int = 1, level: int = 0,
                keep_partial: bool = False) -> tuple[dict, dict]:
    """Texts by id of a page and its counts; what can't be translated keeps its source text.

    A chunk is tried ``retries`` times again, then halved, twice at most. ``keep_partial`` keeps what came back and goes
    on with the rest only. ``api_calls`` counts chunks, ``requests`` and ``completions`` what was really sent.
    """
    counts = {"retry_count": 0, "source_fallback_blocks": 0, "source_fallback_ids": [], "response_chars": 0, "max_split_level": level,
              "api_calls": 1, "requests": 0, "completions": 0}
    kept: dict = {}
    texts = None
    for attempt in range(max(1, retries + 1)):
        texts, info = ask(items)
        counts["requests"] += 1
        counts["completions"] += info.get("calls", 0)
        counts["response_chars"] += info.get("response_chars", 0)
        if info.get("force_split"):
            if keep_partial and texts:
                kept |= {i["id"]: texts[i["id"]] for i in items if (texts.get(i["id"]) or "").strip()}
            texts = None
            break
        if texts is not None:
            break
        if attempt < retries:
            counts["retry_count"] += 1
    if texts is not None:
        return {i["id"]: texts[i["id"]] for i in items}, counts
    left = [i for i in items if i["id"] not in kept]
    if left and level < MAX_LEVEL and len(items) > 1:
        half = max(1, len(left) // 2)
        for part in filter(None, (left[:half], left[half:])):
            more, sub = page_ladder(part, ask, retries, level + 1, keep_partial)
            kept |= more
            for k, v in sub.items():
                counts[k] = max(counts[k], v) if k == "max_split_level" else counts[k] + v
        return kept, counts
    counts["source_fallback_blocks"] += len(left)
    counts["source_fallback_ids"] = [i["id"] for i in left]
    return kept | {i["id"]: i["t"] for i in left}, counts


PAGE_RESULT = ("doc_id {doc}, page int, translated array<struct<id: string, t: string>>, status string, response_chars long, retry_attempts long, retry_count long, "
               "source_fallback_blocks long, source_fallback_ids array<string>, max_split_level long, api_calls long, requests long, completions long, "
               "calls array<struct<ok: boolean, elapsed: double, prompt_tokens: long, completion_tokens: long, total_tokens: long, prompt_chars: long, completion_chars: long>>")
CALL = ("ok", "elapsed", "prompt_tokens", "completion_tokens", "total_tokens", "prompt_chars", "completion_chars")


def translate_pages(pages: DataFrame, translator, options: Options, pause: float = PAUSE) -> DataFrame:
    """``pages`` (``doc_id, page, items``) with the texts of each page, its counts and the calls that the translator logged; a page never fails the job.

    Pages that are too large (``over``, if ``pages`` has it) aren't sent.
    """
    o, name = options, uuid.uuid4().hex
    columns = ["doc_id", "page", "translated", "status", "response_chars", "retry_attempts", "retry_count", "source_fallback_blocks",
               "source_fallback_ids", "max_split_level", "api_calls", "requests", "completions", "calls"]

    def one(doc, page, items):
        items = [{"id": i["id"], "t": i["t"]} for i in items]
        logged = getattr(translator, "log", None)
        before = len(logged) if logged is not None else 0

        def complete(prompt, **options):
            with slot(name, o.workers):
                return translator.complete(prompt, **options)

        try:
            texts, c = page_ladder(items, lambda x: ask_items(x, complete, o.llm.temperature, pause), o.llm.page_retries, 0, o.keep_partial)
            status = "ok_with_warnings" if c["source_fallback_blocks"] else "ok"
        except Exception as e:  # noqa: BLE001
            texts, c, status = {}, {}, f"page_batch_failed: {e}"
        calls = [{k: x.get(k) for k in CALL} for x in logged[before:]] if logged is not None else []
        if logged is not None:
            del logged[before:]  # what is told to Spark needn't be kept
        return (doc, page, [{"id": k, "t": v} for k, v in texts.items()], status, c.get("response_chars", 0), c.get("retry_count", 0) + 1,
                c.get("retry_count", 0), c.get("source_fallback_blocks", 0), c.get("source_fallback_ids", []), c.get("max_split_level", 0),
                c.get("api_calls", 0), c.get("requests", 0), c.get("completions", 0), calls)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            asked = list(zip(part["doc_id"], part["page"], part["items"]))
            for a in range(0, len(asked), ANSWERS):
                yield pd.DataFrame([one(*x) for x in asked[a : a + ANSWERS]], columns=columns)

    schema = PAGE_RESULT.format(doc=pages.schema["doc_id"].dataType.simpleString())
    todo = pages.where("NOT over") if "over" in pages.columns else pages
    return settled(dealt(todo.select("doc_id", "page", "items"), o.workers).mapInPandas(run, schema))


def call_log(results: DataFrame) -> DataFrame:
    """A row for each call of ``translate_pages``, for ``metrics.call_metrics``."""
    return results.select("doc_id", "page", F.posexplode("calls").alias("call", "c")).select("doc_id", "page", "call", "c.*")


def page_summaries(sizes: DataFrame, results: DataFrame, max_output_tokens: int) -> DataFrame:
    """What each page took: its request's size and the counts of its calls."""
    joined = sizes.join(results, ["doc_id", "page"])
    return joined.select(
        "doc_id", "page", F.col("n_items").alias("items"), "input_chars", "payload_chars", "prompt_chars", "estimated_prompt_tokens",
        F.lit(max_output_tokens).cast("long").alias("max_output_tokens"), (F.col("estimated_prompt_tokens") + max_output_tokens).alias("estimated_total_tokens"),
        "response_chars", "retry_attempts", "retry_count", "source_fallback_blocks", "max_split_level", "api_calls", "status")


class Pages(NamedTuple):
    """Blocks, page summaries, a status for each document, and the call log."""

    blocks: DataFrame
    summaries: DataFrame
    outcomes: DataFrame
    calls: DataFrame


def outcomes(sizes: DataFrame, results: DataFrame, limit: int) -> DataFrame:
    """``doc_id``, ``status`` (ok, ok_with_warnings, page_too_large, page_batch_failed), and of its first failed page ``page`` and ``input_chars``.

    A document with a page that is too large or failed has failed as a whole.
    """
    known = sizes.select("doc_id", "page", "input_chars", "over").join(results.select("doc_id", "page", "status"), ["doc_id", "page"], "left")
    state = F.when(F.col("over"), 0).when(F.col("status").isNull() | F.col("status").startswith("page_batch_failed"), 1).when(F.col("status") == "ok", 3).otherwise(2)
    worst = known.groupBy("doc_id").agg(F.min(F.struct(state.alias("state"), "page", "input_chars")).alias("w"))
    names = F.array(*map(F.lit, ("page_too_large", "page_batch_failed", "ok_with_warnings", "ok")))
    failed = F.col("w.state") < 2
    return worst.select("doc_id", F.element_at(names, F.col("w.state") + 1).alias("status"), F.when(failed, F.col("w.page")).alias("page"),
                        F.when(failed, F.col("w.input_chars")).alias("input_chars"), F.lit(limit).cast("long").alias("max_input_chars"))


FAILED = ("page_too_large", "page_batch_failed")


def by_pages(blocks: DataFrame, translator, options: Options, t: Thresholds = DEFAULTS, pause: float = PAUSE) -> Pages:
    """Blocks translated page by page, and what became of each document.

    No page of a document with a page over the limit is sent; a document with such a page, or one that could not be translated, keeps its text, and its
    status says so; the others go on. It is an error if there is nothing to translate, and if every document fails.
    """
    limit = max(t.least_input_chars, options.llm.page_max_chars)
    sized = requests.requests(requests.page_items(blocks, t), t).drop("payload").withColumn("over", F.col("input_chars") > limit)
    sizes = settled(sized)
    large = sizes.where("over").select("doc_id").distinct()
    results = translate_pages(sizes.join(large, "doc_id", "left_anti"), translator, options, pause)
    found = settled(outcomes(sizes, results, limit))
    total = found.agg(F.count("*").alias("n"), F.count_if(F.col("status").isin(*FAILED)).alias("failed"),
                      F.min(F.when(F.col("status").isin(*FAILED), F.struct("doc_id", "status", "page", "input_chars"))).alias("first")).first()
    if not total["n"]:
        raise RuntimeError(failure_text("no_items"))
    if total["failed"] and (options.on_page_failure == "raise" or options.on_page_failure == "keep" and total["failed"] == total["n"]):
        raise RuntimeError(failure_text(total["first"]["status"], total["first"]["page"], total["first"]["input_chars"], limit))
    good = results.join(found.where(~F.col("status").isin(*FAILED)).select("doc_id"), "doc_id", "left_semi")
    texts = good.select("doc_id", "page", F.explode("translated").alias("x")).select(
        "doc_id", "page", F.regexp_extract("x.id", r"_b(-?\d+)\z", 1).cast("int").alias("block_idx"), F.col("x.t").alias("translated"))
    merged = merge.merge_results(blocks, texts, block_kind(F.col("text"), F.col("size") if "size" in blocks.columns else F.lit(None).cast("double"), t))
    return Pages(merged, page_summaries(sizes, results, options.llm.max_tokens), found, call_log(results))


# --- segments and single blocks ----------------------------------------------------------------------------------


def send(rows: DataFrame, request: str, answer: str, translator, options: Options, keep_markers: Column | None = None, pause: float = PAUSE) -> DataFrame:
    """``rows`` with the translator's answer to each request (null: none came); equal requests are sent once if asked."""
    head, name = requests.TRANSLATE_HEAD, uuid.uuid4().hex

    def limited(call, text):
        with slot(name, options.workers):
            return call(text)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text, markers in zip(part["_request"], part["_markers"]):
                text = (text or "").strip()
                if not text:
                    out.append(text)
                elif options.engine == "llm":
                    prompt = head + (requests.MARKER_RULE if markers else "") + "\n" + text
                    out.append(tries(lambda p=prompt: limited(translator.complete, p), pause=pause)[0])
                else:
                    out.append(tries(lambda x=text: limited(translator.translate, x), pause=pause)[0])
                if getattr(translator, "log", None):
                    translator.log.clear()
            yield pd.DataFrame({"_key": part["_key"], answer: pd.Series(out, dtype=object)})

    marked = rows.withColumns({"_markers": keep_markers if keep_markers is not None else F.lit(False), "_request": F.col(request)})
    key = F.sha2(F.concat_ws(" ", F.col("_markers").cast("string"), F.col("_request")), 256) if options.deduplicate else F.expr("uuid()")
    marked = marked.withColumn("_key", key)
    if not options.deduplicate:
        marked = settled(marked)  # the keys are random
    todo = marked.where(F.col("_request").isNotNull()).select("_key", "_request", "_markers")
    todo = settled(todo.dropDuplicates(["_key"])) if options.deduplicate else todo
    answers = settled(dealt(todo, options.workers).mapInPandas(run, f"_key string, `{answer}` string"))
    return marked.join(answers, "_key", "left").drop("_key", "_request", "_markers")


def translate_blocks(rows: DataFrame, translator, options: Options, pause: float = PAUSE) -> DataFrame:
    """Block by block: noise as it is, others flattened and sent; without an answer the text stays."""
    asked = rows.withColumn("_ask", F.when(~is_noise(F.col("text")), for_translation(F.col("text"), False)))
    sent = send(asked, "_ask", "_answer", translator, options, pause=pause)
    text = F.when(F.coalesce("_answer", F.lit("")) != "", F.col("_answer")).otherwise(F.col("text"))
    return sent.withColumns({"original_text": F.col("text"), "text": text}).drop("_ask", "_answer")


def by_segments(blocks: DataFrame, translator, options: Options, t: Thresholds = DEFAULTS, marker: str = "[[block {}]]", pause: float = PAUSE) -> tuple[DataFrame, DataFrame]:
    """Translated blocks and a record for each segment.

    Paragraphs of several blocks go as one text whose sentences are dealt to the blocks; with the llm engine other kinds go as
    marked blocks. Where the answer can't be dealt, and for all else, blocks go one by one.
    """
    llm = options.engine == "llm"
    runs = segments.segments(blocks, t)
    several = (F.col("kind") == "paragraph") & (F.size("blocks") > 1)
    sendable = (F.col("kind") != "paragraph") & F.lit(llm) & (F.lit(options.send_noise) | (F.col("kind") != "noise"))
    joined = F.array_join(F.transform("blocks", lambda b: for_translation(b["text"], True)), "\n\n")
    runs = runs.withColumn("_ask", F.when(several, joined).when(sendable, segments.segment_payload(F.col("blocks"), marker)))
    sent = send(runs, "_ask", "_answer", translator, options, sendable, pause)
    width = lambda b: F.coalesce(b["width"], b["x1"] - b["x0"]) if "width" in blocks.columns else b["x1"] - b["x0"]
    lines = lambda b: b["line_count"] if "line_count" in blocks.columns else F.lit(1)
    room = F.transform("blocks", lambda b: assign.capacity(b["text"], width(b), b["size"], lines(b), t))
    answered = F.coalesce("_answer", F.lit("")) != ""
    dealt = F.when(answered & several, assign.deal_chunks(sentence_chunks(F.col("_answer")), room)).when(
        answered & sendable, assign.split_marked(F.col("_answer"), F.size("blocks"), marker))
    sent = settled(sent.withColumn("_texts", dealt))
    note = (F.when(several, F.when(~answered, "paragraph_translate_failed").when(F.col("_texts").isNull(), "paragraph_reassign_failed").otherwise("paragraph_reassigned"))
            .when(F.col("kind") == "paragraph", "single_paragraph")
            .when(F.lit(not llm), "structured_requires_llm").when(F.col("_texts").isNull(), "structured_split_failed").otherwise("structured_split_ok"))
    fallback = F.col("_texts").isNull() & (note != "single_paragraph")
    strategy = F.when(fallback, "block_fallback").when(F.col("kind") == "paragraph", "paragraph_reflow").otherwise("structured")
    records = segments.debug_records(sent, strategy, F.when(fallback, F.concat(note, F.lit("|fallback"))).otherwise(note))
    cells = sent.select("doc_id", F.col("kind").alias("segment_kind"), F.posexplode("blocks").alias("_i", "b"), "_texts")
    cells = cells.select("doc_id", "segment_kind", "b.*", F.try_element_at("_texts", F.col("_i") + 1).alias("_text"), F.col("_texts").isNotNull().alias("_dealt")).drop("reason")
    done = cells.where("_dealt").withColumns({"original_text": F.col("text"), "text": F.col("_text")}).drop("_text", "_dealt")
    rest = translate_blocks(cells.where("NOT _dealt").drop("_text", "_dealt"), translator, options, pause)
    return done.unionByName(rest), records


def packed(runs: DataFrame, max_items: int = 12, max_chars: int = 4500) -> DataFrame:
    """Runs of one block of a heading, list or table of contents, packed into requests of limited size.

    ``pack`` numbers a document's requests: a new one begins after ``max_chars`` or ``max_items``, by running sums, so no
    request depends on how the one before went.
    """
    from pyspark.sql import Window

    single = (F.size("blocks") == 1) & F.col("kind").isin("toc", "heading", "list")
    rows = runs.where(single).withColumn("chars", F.length(for_translation(F.col("blocks")[0]["text"], False)))
    w = Window.partitionBy("doc_id").orderBy("segment_id")
    before = F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_c": F.floor(F.coalesce(before, F.lit(0)) / max_chars), "_i": F.floor((F.row_number().over(w) - 1) / max_items)})
    fresh = (F.coalesce(F.lag("_c").over(w) != F.col("_c"), F.lit(True)) | (F.lag("_i").over(w) != F.col("_i"))).cast("int")
    return rows.withColumn("_new", fresh).withColumn("pack", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_c", "_i", "_new")


def request_summary(payload: Column) -> Column:
    """How many items a request has, and their ids."""
    ids = F.transform(F.variant_get(F.parse_json(payload), "$.items", "array<variant>"), lambda v: F.try_variant_get(v, "$.id", "string"))
    return F.struct(F.size(ids).alias("items"), F.try_element_at(ids, F.lit(1)).alias("first_id"), F.try_element_at(ids, F.lit(-1)).alias("last_id"), ids.alias("ids"))


def polish(rows: DataFrame, text: str, translator, options: Options, pause: float = PAUSE) -> DataFrame:
    """A second pass over translated text; without an answer it stays."""
    asked = rows.withColumn("_ask", F.concat(F.lit(requests.POLISH_HEAD), normalize(F.col(text))))
    sent = send(asked, "_ask", "_answer", translator, options, pause=pause)
    return sent.withColumn(text, F.coalesce("_answer", text)).drop("_ask", "_answer")
