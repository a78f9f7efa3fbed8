"""The request machine, the ladder and both modes against scripted translators."""

import http.server
import json
import subprocess
import sys
import threading
import time

import pytest

from folioflow.functions import model_json as J
from folioflow.functions.config import LlmOptions, Options
from folioflow.operators import translate as T
from folioflow.plans import pipeline
from folioflow.sources import translators as S
from tests.conftest import ROOT

ITEMS = [{"id": i, "t": f"s{i}"} for i in "abc"]
answer = lambda *ids: json.dumps({"items": [{"id": i, "t": f"T{i}"} for i in ids]})
VALID = answer("a", "b", "c")


@pytest.mark.parametrize("script,texts,reason,split,calls", [
    ([TimeoutError()], None, "timeout", True, 1),
    (["", "", ""], None, "empty_response", False, 3),
    ([OSError("refused")] * 3, None, "empty_response", False, 3),
    (["oops", "oops"], None, "invalid_json_response", False, 2),
    (["oops", VALID], "Ta Tb Tc", "ok", False, 2),
    (["```json\n" + VALID + "\n```"], "Ta Tb Tc", "ok", False, 1),
    (['{"items":[]}'], "", "ok_with_warnings", True, 1),
    ([answer("x", "y", "z")], "Tx Ty Tz", "ok_with_warnings", False, 1),
    ([answer("a", "b")], "Ta Tb", "ok_with_warnings", True, 1),
    ([answer("a", "b", "c", "d")], "Ta Tb Tc Td", "ok_with_warnings", True, 1),
    ([answer("a", "a", "b")], "Ta Ta Tb", "ok_with_warnings", False, 1),
    ([VALID.replace('"Tb"', '" "')], "Ta Tc", "ok_with_warnings", True, 1),
    ([VALID.replace('"Tb"', "5")], "Ta Tc", "ok_with_warnings", True, 1),
])
def test_request(script, texts, reason, split, calls):
    translator = S.Script(script)
    got, info = T.ask_items(ITEMS, translator.complete, pause=0)
    assert (None if got is None else " ".join(got.values())) == texts
    assert (info["reason"], info["force_split"], len(translator.calls), info["calls"]) == (reason, split, calls, calls)


@pytest.mark.parametrize("n,script,asks,retries,api,level,fallback", [
    (4, [TimeoutError()], 7, 0, 7, 2, 4), (4, [""], 14, 7, 7, 2, 4), (1, [TimeoutError()], 1, 0, 1, 0, 1)])
def test_ladder(n, script, asks, retries, api, level, fallback):
    items = [{"id": str(i), "t": f"s{i}"} for i in range(n)]
    translator = S.Script(script)
    texts, c = T.page_ladder(items, lambda x: T.ask_items(x, translator.complete, pause=0))
    assert texts == {i["id"]: i["t"] for i in items}
    assert (c["requests"], c["retry_count"], c["api_calls"], c["max_split_level"], c["source_fallback_blocks"]) == (asks, retries, api, level, fallback)
    assert c["completions"] == len(translator.calls)


def test_ladder_keeps_partial():
    def complete(prompt, **_):
        ids = [i["id"] for i in json.loads(prompt[prompt.find('{"items":'):])["items"]]
        return answer(*ids[: max(1, len(ids) // 2)])

    items = [{"id": i, "t": f"s{i}"} for i in "abcd"]
    texts, c = T.page_ladder(items, lambda x: T.ask_items(x, complete, pause=0), keep_partial=True)
    assert texts == {i: f"T{i}" for i in "abcd"} and c["source_fallback_blocks"] == 0


def test_model_json(spark):
    assert J.first_object('x {"a": "}\\"{"} y') == '{"a": "}\\"{"}' and J.first_object("{") is None and J.first_object("none") is None
    assert J.parse_answer("[1]") is None and J.parse_answer('{"items":{}}') is None and J.parse_answer(None) is None
    assert J.parse_answer('{"items":[{"id":" a ","t":" b "},{"id":1,"t":"x"},{"id":"c","t":""},7]}') == [{"id": "a", "t": "b"}]
    texts = ['{"items":[{"id":" a ","t":" b "},{"id":1,"t":"x"},{"id":"c","t":""},7]}', "oops"]
    from pyspark.sql import functions as F
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", J.native_items(F.col("t")).alias("x")).orderBy("i").collect()
    assert [(p.id, p.t) for p in got[0].x] == [("a", "b")] and not got[1].x
    assert J.content_text([{"text": "a"}, "b", {"value": "c", "text": ""}, 5, {"text": 1, "content": "d"}]) == "acd"
    assert J.content_text({"text": "", "value": "v"}) == "v" and J.content_text(None) == J.content_text(5) == ""
    assert J.choice_text({"message": {"content": ""}, "text": "t"}) == ("t", "choice.text") and J.choice_text(None) == ("", "none")
    assert J.choice_text({"message": {"content": [{"text": "a"}], "text": "b"}}) == ("a", "message.content") and J.choice_text({"text": ["t"], "message": {"text": {"text": "x"}}}) == ("", "none")
    assert J.choice_text({"message": {"reasoning_content": " r "}, "text": "t"}) == (" r ", "message.reasoning_content")
    assert [J.whole_number(x) for x in ("12", 3.7, None, "x", [1], True, 10**30, float("inf"))] == [12, 3, None, None, None, 1, None, None]
    assert J.error_detail('{"error":{"message":" m ","code":" ","type":"t"}}') == "m | t" and J.error_detail('{"error":{},"detail":" d "}') == "d" and J.error_detail(None) == ""
    assert J.error_detail('{"error":{"message":"m","code":5}}') == "m | 5" and J.error_detail("a\n b") == "a b" and J.error_detail('{"detail":"d"}') == "d"


def test_timeouts():
    assert S.is_timeout(S.TranslatorError("x", 504)) and S.is_timeout(TimeoutError()) and S.is_timeout(OSError("operation timed out"))
    assert not S.is_timeout(S.TranslatorError("x", 500)) and not S.is_timeout(ValueError("no"))


def test_tries():
    script = S.Script([OSError(), "", " x "])
    assert S.tries(lambda: script.complete("p"), pause=0) == ("x", 3)
    assert S.tries(lambda: "", pause=0) == (None, 3)


BLOCK = "doc_id int, page int, block_idx int, text string, x0 double, y0 double, x1 double, y1 double, size double, font string, width double, line_count int"


@pytest.fixture()
def blocks(spark):
    texts = ["First line here", "second line here", "7", "“Quoted one. goes on", "“quoted two! and then", "- item"]
    return spark.createDataFrame([(1, 0, i, t, 10.0, 24.0 * i, 210.0, 24.0 * i + 20, 11.0, "F", 200.0, 2) for i, t in enumerate(texts)], BLOCK)


def texts(df):
    return [r.text for r in df.orderBy("block_idx").collect()]


def test_page_mode(blocks):
    out, pages, outcomes, _ = T.by_pages(blocks, S.Mapped(str.upper), Options(engine="llm"), pause=0)
    assert [(r.doc_id, r.status, r.page) for r in outcomes.collect()] == [(1, "ok", None)]
    assert texts(out) == ["FIRST LINE HERE", "SECOND LINE HERE", "7", "“QUOTED ONE. GOES ON", "“QUOTED TWO! AND THEN", "- ITEM"]
    row = pages.first()
    assert (row["items"], row.retry_count, row.status, row.api_calls) == (5, 0, "ok", 1)


class Logged(S.Mapped):
    """A translator that keeps a log like the server's client."""

    def complete(self, prompt, **options):
        self.log = getattr(self, "log", [])
        self.log.append({"ok": True, "elapsed": 0.5, "prompt_chars": len(prompt), "completion_chars": 8, "prompt_tokens": 3})
        return super().complete(prompt, **options)


def test_call_log(blocks):
    from folioflow.operators import metrics

    logged = Logged(str.upper)
    logged.log = []
    calls = T.by_pages(blocks, logged, Options(engine="llm"), pause=0).calls
    row = metrics.call_metrics(calls).first()
    assert (row.requests_total, row.prompt_tokens, row.completion_tokens, row.successful_elapsed) == (1, 3, 2, 0.5)


def test_page_mode_errors(blocks):
    with pytest.raises(RuntimeError, match="nothing to translate"):
        T.by_pages(blocks.where("block_idx = 2"), S.Mapped(str.upper), Options(engine="llm"), pause=0)
    big = blocks.selectExpr("* EXCEPT (text)", "repeat('word ', 500) AS text")
    with pytest.raises(RuntimeError, match="over the limit"):
        T.by_pages(big, S.Mapped(str.upper), Options(engine="llm", llm=LlmOptions(page_max_chars=1000)), pause=0)


@pytest.mark.parametrize("dedup", [False, True])
def test_google_segments(blocks, dedup):
    out, records = T.by_segments(blocks, S.Mapped(str.upper), Options(deduplicate=dedup), pause=0)
    assert texts(out)[:3] == ["FIRST LINE HERE", "SECOND LINE HERE", "7"] and texts(out)[5] == "- ITEM"
    assert {r.result for r in records.collect()} >= {"structured_requires_llm|fallback"}


def test_llm_segments(blocks):
    def change(prompt):
        return prompt.split("\n\n", 1)[1].upper().replace("[[BLOCK", "[[block") if "[[block" in prompt else prompt.rsplit("\n\n", 1)[1].upper()

    out, records = T.by_segments(blocks, S.Mapped(change), Options(engine="llm"), pause=0)
    assert texts(out)[:2] == ["FIRST LINE HERE", "SECOND LINE HERE"]
    assert {r.kind: r.result for r in records.collect()}["toc"] == "structured_split_ok"


def test_failing_translator_keeps_text(blocks):
    result = pipeline.translate_documents(blocks, S.Script([OSError("down")]), Options(), pause=0)
    assert texts(result.blocks) == texts(blocks) and result.translated == 0


def test_pipeline_and_plan(spark, blocks):
    pages = spark.createDataFrame([(1, 0, 0.0, 0.0, 600.0, 800.0)], "doc_id int, page int, page_x0 double, page_y0 double, page_x1 double, page_y1 double")
    result, plan = pipeline.run(blocks, pages, S.Mapped(str.upper), Options(engine="llm"), pause=0)
    assert result.translated == 5
    rows = plan.orderBy("block_idx").collect()
    assert len(rows) == 6 and all(r.font_size > 0 for r in rows)
    stats = pipeline.translate_documents(blocks, None, Options(engine="llm", llm=LlmOptions(page_stats_only=True)))
    assert stats.blocks is None and stats.records.count() == 1


def test_pages_fall_back_to_segments(blocks):
    big = blocks.selectExpr("* EXCEPT (text)", "concat(text, repeat(' word', 300)) AS text")
    options = Options(engine="llm", on_page_failure="segment", llm=LlmOptions(page_max_chars=1000))
    assert pipeline.translate_documents(big, S.Mapped(lambda p: "x"), options, pause=0).translated > 0


def several(blocks):
    """Document 2 has a page that is too large, 3 one that the translator fails on, 4 is like 1."""
    more = blocks.selectExpr("* EXCEPT (doc_id, text)", "2 AS doc_id", "concat(text, repeat(' word', 300)) AS text")
    more = more.unionByName(blocks.selectExpr("* EXCEPT (doc_id, page)", "2 AS doc_id", "1 AS page"))
    bad = blocks.selectExpr("* EXCEPT (doc_id, text)", "3 AS doc_id", "concat(text, ' BOOM') AS text")
    return blocks.unionByName(more).unionByName(bad).unionByName(blocks.selectExpr("* EXCEPT (doc_id)", "4 AS doc_id"))


class Picky(S.Mapped):
    def complete(self, prompt, **options):
        if "BOOM" in prompt:
            raise SystemError("no")
        return super().complete(prompt, **options)

    def translate(self, text, **options):
        return "by segment"


def test_documents_fail_alone(blocks, monkeypatch):
    rows = several(blocks)

    def failing(items, ask, retries=1, level=0, keep_partial=False):
        if any("BOOM" in i["t"] for i in items):
            raise ValueError("broken")
        return {i["id"]: i["t"].upper() for i in items}, {"source_fallback_blocks": 0}

    monkeypatch.setattr(T, "page_ladder", failing)
    options = Options(engine="llm", llm=LlmOptions(page_max_chars=1000))
    out, summaries, outcomes, _ = T.by_pages(rows, S.Mapped(str.upper), options, pause=0)
    assert {r.doc_id: (r.status, r.page) for r in outcomes.collect()} == {1: ("ok", None), 2: ("page_too_large", 0), 3: ("page_batch_failed", 0), 4: ("ok", None)}
    for doc in (1, 4):
        assert texts(out.where(f"doc_id = {doc}"))[0] == "FIRST LINE HERE"
    kept = out.where("doc_id IN (2, 3)").collect()
    assert len(kept) == 18 and all(r.text == r.original_text for r in kept)
    with pytest.raises(RuntimeError, match="over the limit"):
        T.by_pages(rows, S.Mapped(str.upper), Options(engine="llm", on_page_failure="raise", llm=options.llm), pause=0)
    result = pipeline.translate_documents(rows, Picky(lambda x: "by segment"), Options(engine="llm", on_page_failure="segment", llm=options.llm), pause=0)
    by_doc = {d: [r.text for r in result.blocks.where(f"doc_id = {d}").orderBy("page", "block_idx").collect()] for d in (1, 2, 4)}
    assert by_doc[1][0] == "FIRST LINE HERE" and "by segment" in by_doc[2] and len(by_doc[2]) == 12 and by_doc[1] == by_doc[4]


def test_failing_calls_keep_the_page(blocks):
    """Calls that fail leave a page's text; that is a warning, not a failed document."""
    outcomes = T.by_pages(several(blocks).where("doc_id != 2"), Picky(str.upper), Options(engine="llm"), pause=0).outcomes
    assert {r.doc_id: r.status for r in outcomes.collect()} == {1: "ok", 3: "ok_with_warnings", 4: "ok"}


def test_slots(tmp_path):
    import threading
    import uuid

    run, now, most, lock = uuid.uuid4().hex, [0], [0], threading.Lock()

    def call():
        with T.slot(run, 3):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.02)
            with lock:
                now[0] -= 1

    threads = [threading.Thread(target=call) for _ in range(12)]
    [t.start() for t in threads]
    [t.join(20) for t in threads]
    assert most[0] == 3 and now[0] == 0


def test_a_lost_worker_repeats_its_own_calls_only(tmp_path):
    code = f"""
import os, sys
from pyspark.sql import SparkSession
from folioflow.functions.config import LlmOptions, Options
from folioflow.operators import translate as T
from folioflow.sources.translators import Mapped
T.TASK_REQUESTS = 4

class Fragile(Mapped):
    def complete(self, prompt, **options):
        which = prompt.split('"t":"', 1)[1].split('"')[0]
        with open("{tmp_path}/calls", "a") as f:
            f.write(which + "\\n")
        if which == "page text 17" and not os.path.exists("{tmp_path}/died"):
            open("{tmp_path}/died", "w").close()
            os._exit(1)
        return super().complete(prompt, **options)

spark = (SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/c").getOrCreate())
rows = spark.range(40).selectExpr("1 AS doc_id", "CAST(id AS INT) AS page", "0 AS block_idx", "concat('page text ', id) AS text", "11.0D AS size")
out = T.by_pages(rows, Fragile(str.upper), Options(engine="llm", llm=LlmOptions(max_workers=2)), pause=0)
print("texts", out.blocks.where("text = upper(original_text)").count())
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=ROOT)
    assert "texts 40" in done.stdout, done.stderr[-2000:]
    calls = (tmp_path / "calls").read_text().split("\n")[:-1]
    again = {c for c in calls if calls.count(c) > 1}
    assert len(set(calls)) == 40 and "page text 17" in again and len(again) <= 4 and (tmp_path / "died").exists()


class Server(http.server.BaseHTTPRequestHandler):
    """A chat server that knows no answer forms, and the web endpoint."""

    seen: list = []

    def answer(self, status, body):
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append((self.path, body))
        if "response_format" in body:
            return self.answer(422, {"error": {"message": "no forms"}})
        if "late" in body["messages"][0]["content"]:
            return self.answer(504, {"detail": "too late"})
        self.answer(200, {"choices": [{"message": {"content": [{"text": "An"}, "x", {"text": "swer"}]}}], "usage": {"prompt_tokens": "7", "completion_tokens": "many"}})

    def do_GET(self):
        self.seen.append((self.path, None))
        self.answer(200, [[["Guten ", "x"], ["Tag", "y"], None]])

    def log_message(self, *_):
        pass


@pytest.fixture()
def server():
    Server.seen = []
    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def test_clients(server):
    client = S.LlmClient(LlmOptions(base_url=server + "/v1/", model="m", timeout=5, repetition_penalty=None))
    assert client.complete("p", structured=True) == "Answer"
    (path, first), (_, second) = Server.seen
    assert path == "/v1/chat/completions" and first["response_format"] == J.ANSWER_FORM and "response_format" not in second
    assert second["messages"] == [{"role": "user", "content": "p"}] and second["enable_thinking"] is False and "repetition_penalty" not in second
    log = client.log[0]
    assert (log["ok"], log["prompt_tokens"], log["completion_tokens"], log["total_tokens"], log["completion_chars"]) == (True, 7, None, None, 6)
    with pytest.raises(S.TranslatorError, match="too late") as e:
        client.complete("late")
    assert S.is_timeout(e.value) and client.log[1]["ok"] is False
    google = S.GoogleClient(5.0, "de", server + "/t")
    assert google.translate("a b") == "Guten Tag" and "q=a+b" in Server.seen[-1][0] and "tl=de" in Server.seen[-1][0]


def test_polish(spark):
    rows = spark.createDataFrame([(1, "some  text"), (2, "keep")], "doc_id int, text string")
    out = T.polish(rows, "text", S.Mapped(lambda p: "" if "keep" in p else p.rsplit("\n", 1)[1].upper()), Options(engine="google"), pause=0)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "SOME TEXT", 2: "keep"}
