"""Segments, requests, layout and assignment on small rows with known results."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import config
from folioflow.functions.geometry import is_body
from folioflow.operators import assign, layout, merge, metrics, paragraphs, requests, segments
from folioflow.plans import queries

BLOCK = "doc_id int, page int, block_idx int, text string, x0 double, y0 double, x1 double, y1 double, size double, font string"


def blocks(spark, rows):
    return spark.createDataFrame(rows, BLOCK)


def reasons(spark, rows):
    return [r.reason for r in segments.with_reasons(blocks(spark, rows)).orderBy("doc_id", "page", "block_idx").collect()]


def test_merge_reasons(spark):
    long = "é" + "x" * 90
    two = lambda a, b, p=0, gap=4, f="F", x=10.0: [(1, 0, 0, a, 10.0, 0.0, 90.0, 20.0, 11.0, "F"), (1, p, 1, b, x, 20.0 + gap, 90.0, 40.0 + gap, 11.0, f)]
    assert reasons(spark, two("“this goes on and " + "x" * 120, "“And next " + "y" * 120)) == [None, "mid_sentence"]
    assert reasons(spark, two("a b", "c d", p=1)) == [None, "cross_page"]
    assert reasons(spark, two("12", "c d")) == [None, "noise"]
    assert reasons(spark, two("a b", "c d", x=31.0)) == [None, "column_change"]
    assert reasons(spark, two("a b", "c d", gap=25)) == [None, "large_gap"]
    assert reasons(spark, two("a b", "c d", gap=-3)) == [None, "large_gap"]
    assert reasons(spark, two("a b", "c d")) == [None, "toc_short_lines"]
    assert reasons(spark, two("a" * 90, "c d", f="G")) == [None, "toc_break"]
    assert reasons(spark, two("- a", "- b")) == [None, "list_continuation"]
    assert reasons(spark, two("- a", "- b", f="G")) == [None, "default_break"]
    assert reasons(spark, two("- a", "“x")) == [None, "kind_change"]
    assert reasons(spark, two("ÄB", "ÖC")) == [None, "heading"]
    assert reasons(spark, two(long + ".", "the " + "ö" * 130)) == [None, "continuation_start"]
    assert reasons(spark, two("“a.", "“b.")) == [None, "short_paragraph_lines"]
    assert reasons(spark, two(long + ".", "“B" + "x" * 90)) == [None, "default_break"]


def test_segments_and_payload(spark):
    rows = [(1, 0, i, t, 10.0, 24.0 * i, 90.0, 24.0 * i + 20, 11.0, "F") for i, t in enumerate(["a b", "c-\nd", "7", "e f"])]
    got = segments.segments(blocks(spark, rows)).orderBy("segment_id")
    assert [(r.kind, [b.text for b in r.blocks], r.merge_reasons) for r in got.collect()] == [
        ("toc", ["a b", "c-\nd"], ["toc_short_lines"]), ("noise", ["7"], []), ("toc", ["e f"], [])]
    assert got.select(segments.segment_payload(F.col("blocks")).alias("p")).first().p == "[[block 0]]\na b\n[[block 1]]\ncd"


def test_requests(spark):
    rows = [(1, 0, 1, "b “x”\t", 0.0, 0.0, 1.0, 1.0, 9.0, "F"), (1, 0, 0, "a\n\nc", 0.0, 0.0, 1.0, 1.0, 9.0, "F"), (1, 0, 2, "9", 0.0, 0.0, 1.0, 1.0, 9.0, "F")]
    row = requests.requests(requests.page_items(blocks(spark, rows))).first()
    assert row.payload == '{"items":[{"id":"p0_b0","t":"a\\n\\nc"},{"id":"p0_b1","t":"b “x”"}]}'
    assert (row.n_items, row.input_chars, row.payload_chars) == (2, 9, len(row.payload))
    stats = requests.page_stats(blocks(spark, rows), max_input_chars=9).first()
    assert not stats.over_input_char_limit and requests.page_stats(blocks(spark, rows), max_input_chars=8).first().over_input_char_limit
    with pytest.raises(RuntimeError):
        requests.select_pages(blocks(spark, rows), [5])


def line(text, x0=None):
    return {"bbox": None if x0 is None else [float(x0), 0.0, 50.0, 10.0], "spans": None if text is None else [{"text": text, "font": "F", "size": 9.0, "color": 0}] if text != "[]" else []}


def groups_of(spark, lines):
    schema = "lines array<struct<bbox: array<double>, spans: array<struct<text: string, font: string, size: double, color: int>>>>"
    found = spark.createDataFrame([(lines,)], schema).select(paragraphs.paragraph_groups().alias("g")).first().g
    return [["".join(s.text for s in x.spans) for x in g] for g in found]


def plain_groups(lines):
    done, now, least = [], [], None
    for text, x in lines:
        if text == "[]":
            continue
        if not text.strip():
            if now:
                done.append(now)
            now, least = [], None
            continue
        if now and (x - now[-1][1] >= 20 or x - least >= 20) and now[-1][0].strip()[-1] in ".!?:;。！？" and text.strip() not in ("•", "-", "*", "・"):
            done.append(now)
            now, least = [], None
        now.append((text, x))
        least = x if least is None else min(least, x)
    return [[t for t, _ in g] for g in done + [now] * bool(now)]


def test_paragraph_groups(spark):
    assert groups_of(spark, [line("First sentence.", 10), line("Indented next paragraph", 40)]) == [["First sentence."], ["Indented next paragraph"]]
    assert groups_of(spark, [line("•", 10), line("Indented list item", 40)]) == [["•", "Indented list item"]]
    assert groups_of(spark, [line(" ", 1), line("[]", 1), line("a"), line("", 1), line("b", 3)]) == [["a"], ["b"]]
    assert groups_of(spark, []) == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a.", "b", " ", "[]", "•", "c! "]), st.integers(0, 60)), max_size=12))
def test_paragraph_groups_like_python(spark, lines):
    assert groups_of(spark, [line(t, x) for t, x in lines]) == plain_groups(lines)


def test_capacity_and_dealing(spark):
    one = spark.range(1)
    got = one.select(assign.capacity(F.lit("Hello   world"), F.lit(200.0), F.lit(10.0), F.lit(2)).alias("a"), assign.capacity(F.lit("ab"), F.lit(5.0), F.lit(10.0), F.lit(1)).alias("b")).first()
    assert (round(got.a, 6), got.b) == (46.6, 8.0)
    cases = [(list("abcde"), [10, 10], ["a b", "c d e"]), (list("abcde"), [30, 10], ["a b c", "d e"]), (list("abc"), [100, 1, 1], ["a", "b", "c"]),
             (list("abcd"), [1, 1, 8], ["a", "b", "c d"]), (["x、 y"], [1, 1], ["x、", "y"]), (["x"], [1, 1], None), ([], [1], None)]
    rows = spark.createDataFrame([(i, c, [float(x) for x in k]) for i, (c, k, _) in enumerate(cases)], "i int, c array<string>, k array<double>")
    assert [r.d for r in rows.select("i", assign.deal_chunks(F.col("c"), F.col("k")).alias("d")).orderBy("i").collect()] == [w for *_, w in cases]


def test_split_marked(spark):
    m = "[[block {}]]".format
    texts = [f"junk\n{m(0)}\na\n{m(1)}\nb", f"{m(0)}\na", f"{m(0)}\n\n{m(1)}\nb", f"{m(0)}\na\n{m(1)}\nb\n{m(2)}\nc", f"{m(0)}\nz\n {m(0)} \na\nq\n{m(1)}\nb", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", assign.split_marked(F.col("t"), F.lit(2)).alias("s")).orderBy("i")
    assert [r.s for r in rows.collect()] == [["a", "b"], None, None, None, ["a\nq", "b"], None]


def test_body_and_columns(spark):
    text = "x" * 60
    rows = [(1, 0, i, text, x, 0.0, x + w, 10.0, s, "F") for i, (x, w, s) in enumerate([(40.0, 220.0, 12.0), (44.0, 225.0, 10.0), (320.0, 210.0, 9.0)])]
    frame = blocks(spark, rows).withColumns({"segment_kind": F.lit("paragraph"), "line_count": F.lit(3), "width": F.col("x1") - F.col("x0"), "page_x0": F.lit(0.0),
                                             "page_y0": F.lit(0.0), "page_x1": F.lit(600.0), "page_y1": F.lit(800.0)})
    groups = layout.column_groups(frame)
    assert sorted((r.block_idx, r.col_group) for r in groups.collect()) == [(0, 0), (1, 0), (2, 1)]
    sized = layout.column_sizes(frame.join(groups, [*layout.PAGE, "block_idx"]), [*layout.PAGE, "col_group"])
    assert [r.target_size for r in sized.orderBy("block_idx").collect()] == [10.5, 10.5, 9.0]
    body = lambda n, lines, w: spark.range(1).select(is_body(F.lit("paragraph"), F.lit("x" * n), F.lit(lines), F.lit(w), F.lit(11.0), F.lit(600.0), F.lit(800.0)).alias("b")).first().b
    assert body(67, 3, 220.0) and not body(10, 1, 120.0) and not body(67, 1, 220.0) and not body(67, 3, 100.0)


def plain_columns(cells):
    groups = []
    for x, i, w in sorted(cells):
        for g in groups:
            if abs(x - g[0][0]) <= 36 and abs(w - g[0][2]) / max(w, g[0][2]) <= 0.35:
                g.append((x, i, w))
                break
        else:
            groups.append([(x, i, w)])
    return {i: n for n, g in enumerate(groups) for _, i, _ in g}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(120, 400)), min_size=1, max_size=8))
def test_columns_like_python(spark, boxes):
    rows = [(1, 0, i, "x" * 60, float(x), 0.0, float(x + w), 10.0, 9.0, "F") for i, (x, w) in enumerate(boxes)]
    frame = blocks(spark, rows).withColumns({"segment_kind": F.lit("paragraph"), "line_count": F.lit(3), "width": F.col("x1") - F.col("x0"), "page_x0": F.lit(0.0),
                                             "page_y0": F.lit(0.0), "page_x1": F.lit(600.0), "page_y1": F.lit(800.0)})
    assert {r.block_idx: r.col_group for r in layout.column_groups(frame).collect()} == plain_columns([(float(x), i, float(w)) for i, (x, w) in enumerate(boxes)])


def test_best_size_fits():
    for size in (2.0, 3.0, 8.0, 14.0):
        best = layout.best_size("word " * 30, 200.0, 60.0, size, layout.width_model)
        assert best == size if size <= 3 else layout.width_model("word " * 30, 200.0, 60.0, best)
    assert 9.9 <= layout.best_size("a", 500.0, 500.0, 10.0, layout.width_model) <= 10.5 + layout.DEFAULTS.fit_delta


def test_merge_and_counts(spark):
    rows = blocks(spark, [(1, 0, 0, "a b", 0.0, 0.0, 1.0, 1.0, 9.0, "F"), (1, 0, 1, "5", 0.0, 0.0, 1.0, 1.0, 9.0, "F"), (1, 0, 2, "c d", 0.0, 0.0, 1.0, 1.0, 9.0, "F")])
    results = spark.createDataFrame([(1, 0, 0, "old", 1), (1, 0, 0, "new", 2), (1, 0, 1, "five", 1), (1, 0, 2, "", 1)], "doc_id int, page int, block_idx int, translated string, v int")
    out = merge.merge_results(rows, results, F.lit("toc"), order="v").orderBy("block_idx")
    assert [(r.text, r.original_text) for r in out.collect()] == [("new", "a b"), ("5", "5"), ("c d", "c d")]
    assert merge.translated_count(out).first().translated == 1


def test_call_metrics(spark):
    calls = spark.createDataFrame([(True, 1.5, None, 10, None, 9, 0), (True, -1.0, 3, None, 99, 0, 8), (False, 7.0, 5, 5, 5, 5, 5)],
                                  "ok boolean, elapsed double, prompt_tokens long, completion_tokens long, total_tokens long, prompt_chars long, completion_chars long")
    row = metrics.rates(metrics.call_metrics(calls), 4, 2.0).first()
    assert (row.requests_total, row.requests_ok, row.requests_failed, row.prompt_tokens, row.completion_tokens, row.total_tokens) == (3, 2, 1, 6, 12, 112)
    assert (row.successful_elapsed, row.tokens_per_second, row.blocks_per_second) == (1.5, 8.0, 2.0)


def test_config(tmp_path):
    assert config.parse_pages("0,2-4, 8-7, x, -1") == [0, 2, 3, 4, 7, 8]
    assert config.parse_pages("") is None and config.parse_pages("abc, -") is None and config.parse_pages(None) is None
    path = tmp_path / "settings"
    path.write_text("# c\nexport A='1'\nB=\"x y\"\nC=plain\nbad\n")
    env = {"C": "plain"}
    assert config.load_settings(path, env) == 2 and env == {"A": "1", "B": "x y", "C": "plain"}
    assert config.switch("Z", "C", False, env) and not config.switch("Z", "Y", False, env) and not config.switch("N", environ={"N": " Off "}, default=True)
    assert config.output_path("/a/b.pdf", "google") == "/a/b_G.pdf" and config.output_path("b.pdf", "llm") == "b_LLM.pdf"
    assert [config.elapsed_text(x) for x in (12.34, 123.2, -1)] == ["12.3s", "2m03.2s", "0.0s"]
    assert config.request_label({"chars": 5, "page": 0, "zz": 1, "level": None}) == "req chars=5 page=0 zz=1"


def test_empty_tables(spark):
    none = blocks(spark, [])
    assert segments.segments(none).count() == 0
    assert requests.page_stats(none).count() == 0
    assert queries.QUERIES
