"""One file through the pipeline, with an injected parser and writer."""

import json
import sys
import types

import pytest

from folioflow.functions.config import LlmOptions, Options
from folioflow.plans import files
from folioflow.sources import pdf
from folioflow.sources.translators import Mapped


def parse(content):
    for page in range(2):
        span = {"text": f"Some text of page {page}", "font": "F", "size": 9.0, "color": 0}
        yield {"page": page, "block_no": 0, "type": 0, "bbox": [50.0, 50.0, 200.0, 80.0], "lines": [{"bbox": [50.0, 50.0, 200.0, 80.0], "spans": [span]}]}


def work(spark, tmp_path, options, name="a.pdf"):
    source = tmp_path / name
    source.write_bytes(b"%PDF-")
    seen = []
    summary = files.translate_file(spark, str(source), Mapped(str.upper), options, parse=parse, write=lambda c, plan: seen.extend(plan) or b"made",
                                   page_sizes=lambda c: [(i, 0.0, 0.0, 600.0, 800.0) for i in range(2)])
    return summary, seen


def test_missing_source(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.translate_file(spark, str(tmp_path / "no.pdf"), None, Options())


@pytest.mark.parametrize("keep", [False, True])
def test_working_files(spark, tmp_path, keep):
    summary, plan = work(spark, tmp_path, Options(keep_debug=keep))
    assert summary.output.endswith("a_G.pdf") and open(summary.output, "rb").read() == b"made"
    assert (summary.extracted, summary.translated) == (2, 2) and set(summary.seconds) == {"extract", "translate", "generate"}
    assert [r["set_text"] for r in plan] == ["SOME TEXT OF PAGE 0", "SOME TEXT OF PAGE 1"] and plan[0]["bbox"] == [50.0, 50.0, 200.0, 80.0]
    assert [p.exists() for p in files.working_files(str(tmp_path / "a.pdf"))] == [keep] * 3


@pytest.mark.parametrize("options,fields", [
    (Options(keep_debug=True), {"segment_debug", "engine", "workers", "llm_translate_mode", "llm_target_pages"}),
    (Options(keep_debug=True, engine="llm", llm=LlmOptions(translate_mode="segment")), {"segment_debug", "engine", "workers", "llm_translate_mode", "llm_target_pages", "llm"}),
    (Options(keep_debug=True, engine="llm"), {"segment_debug", "engine", "workers", "llm_translate_mode", "llm_target_pages", "llm", "llm_page"}),
    (Options(keep_debug=True, engine="llm", llm=LlmOptions(page_stats_only=True)), {"segment_debug", "engine", "workers", "llm_translate_mode", "llm_target_pages", "llm_page_stats_only", "llm_page_stats"}),
])
def test_debug_records(spark, tmp_path, options, fields):
    work(spark, tmp_path, options)
    assert (tmp_path / "a_extracted_text.json").exists()
    found = json.loads((tmp_path / "a_segment_debug.json").read_text())
    assert found.keys() == fields
    rows = found.get("llm_page_stats") or found.get("llm_page", {}).get("page_summaries") or found["segment_debug"]
    assert rows and all(isinstance(r, dict) for r in rows)
    assert found.get("llm_page", {}).get("status", "ok") == "ok" and "api_key" not in json.dumps(found)


def test_debug_record_of_a_failure(spark, tmp_path):
    long = {"text": "word " * 400, "font": "F", "size": 9.0, "color": 0}
    block = {"page": 0, "block_no": 0, "type": 0, "bbox": [0.0, 0.0, 9.0, 9.0], "lines": [{"bbox": [0.0, 0.0, 9.0, 9.0], "spans": [long]}]}
    (tmp_path / "a.pdf").write_bytes(b"%PDF-")
    options = Options(engine="llm", keep_debug=True, llm=LlmOptions(page_max_chars=1000))
    with pytest.raises(RuntimeError, match="over the limit"):
        files.translate_file(spark, str(tmp_path / "a.pdf"), Mapped(str.upper), options, parse=lambda c: iter([block]))
    found = json.loads((tmp_path / "a_segment_debug.json").read_text())
    assert found["failure"]["stage"] == "page_mode" and "over the limit" in found["failure"]["message"] and not (tmp_path / "a_LLM.pdf").exists()


def test_writing_pages(monkeypatch, tmp_path):
    """What the PDF library is asked to do, page by page."""
    asked = []

    class FakePage:
        def __init__(self, n):
            self.n = n

        def __getattr__(self, name):
            return lambda *a, **k: asked.append((self.n, name, a, k))

    class FakeFile:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def __iter__(self):
            return iter([FakePage(0), FakePage(1)])

        def tobytes(self, **_):
            return b"made"

    fake = types.SimpleNamespace(open=lambda **k: FakeFile(), Rect=lambda *a: a)
    monkeypatch.setitem(sys.modules, "fitz", fake)
    row = {"bbox": (1, 2, 3, 4), "set_x0": 1, "set_y0": 2, "set_x1": 9, "set_y1": 8, "set_text": "t", "font_size": 7.0, "color": None, "align": 3}
    assert pdf.write_pdf(b"%PDF-", [{"page": 1, **row}, {"page": 1, **row, "set_text": "u"}, {"page": 7, **row}]) == b"made"
    assert [(n, name) for n, name, *_ in asked] == [(0, "apply_redactions"), (1, "add_redact_annot"), (1, "add_redact_annot"), (1, "apply_redactions"), (1, "insert_textbox"), (1, "insert_textbox")]
    assert asked[-1][2] == ((1, 2, 9, 8), "u") and asked[-1][3] == {"fontname": "cjk", "fontsize": 7.0, "color": (0, 0, 0), "align": 3}
    font = tmp_path / "f.ttc"
    font.write_bytes(b"")
    assert pdf.font_of(str(font)) == {"fontname": "given", "fontfile": str(font)} and pdf.font_of(str(font) + "x") == pdf.font_of(None) == {"fontname": "cjk"}


def test_writing_documents(spark):
    plan = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "doc_id string, page int, set_text string")
    source = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("c", b"3")], "doc_id string, content binary")
    out = pdf.write_documents(plan, source, lambda c, rows: bytes(c) + "".join(sorted(r["set_text"] for r in rows)).encode())
    assert {r.doc_id: bytes(r.content) for r in out.collect()} == {"a": b"1xy", "b": b"2z", "c": b"3"}


def test_statistics_only(spark, tmp_path):
    summary, _ = work(spark, tmp_path, Options(engine="llm", llm=LlmOptions(page_stats_only=True)))
    assert summary.output is None and summary.stats.count() == 2 and not (tmp_path / "a_LLM.pdf").exists()


def test_options():
    args = files.parser({"FOLIOFLOW_LLM_MODEL": "m", "FOLIOFLOW_LLM_DISABLE_THINKING": "off", "FOLIOFLOW_DEBUG": "1"}).parse_args(
        ["a.pdf", "--engine", "llm", "--llm-timeout", "0", "--llm-translate-mode", "segment", "--llm-target-pages", "1-2"])
    o = files.options_of(args)
    assert (o.engine, o.keep_debug, o.llm.model, o.llm.timeout, o.llm.disable_thinking, o.llm.translate_mode, o.llm.target_pages) == ("llm", True, "m", None, False, "segment", "1-2")
