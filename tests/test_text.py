"""Golden rows and an independent definition of the text functions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.functions.classify import block_kind


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", make(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


WHITE = [c for c in map(chr, range(0x110000)) if c.isspace()]


def test_white_space_is_what_python_strips(spark):
    assert len(WHITE) == 29
    assert column(spark, [f"{c}a{c}{c}b{c}" for c in WHITE], X.normalize) == ["a b"] * 29
    assert column(spark, [f"{c}a{c}" for c in WHITE], X.strip) == ["a"] * 29
    others = ["​", "﻿", "᠎", "_"]
    assert column(spark, [f"{c}a" for c in others], X.strip) == [f"{c}a" for c in others]


@pytest.mark.parametrize("keep,rows", [
    (True, {"impor-\ntant line\r\nsecond\n\nthird": "important line second\n\nthird", "impor-\r\ntant": "impor- tant", "a\n\n b": "a\n\n b",
            "\n\nx\n\n": "\n\nx\n\n", "a-\nb-\nc": "ab- c", "a\n \n \nb": "a\n\nb", "a\rb": "a b"}),
    (False, {"impor-\r\ntant": "impor- tant", "a\n\n b": "a b", "\n\nx\n\n": "x", "a-\nb-\nc": "ab- c", "a\n \n \nb": "a b"}),
])
def test_for_translation(spark, keep, rows):
    assert column(spark, list(rows), lambda c: X.for_translation(c, keep)) == list(rows.values())


def test_kinds(spark):
    eleven = {"12": "noise", "１２": "noise", "": "noise", "A": "noise", "Hello world.": "toc", "Table of Contents" + "x" * 200: "toc", "éa\tb": "toc",
              "- item one": "list", "• item one": "list", "-item": "paragraph", "1. short": "toc", "1. " + "word " * 30: "list", "Überblick": "paragraph",
              "ÜBERBLICK": "heading", "(ABC)": "heading", "日本語": "heading", '"quoted" start': "paragraph", "W" + "ord " * 40: "paragraph"}
    assert column(spark, list(eleven), lambda c: block_kind(c, F.lit(11.0))) == list(eleven.values())
    assert column(spark, ["Überblick", "Über-blick", None], lambda c: block_kind(c, F.lit(20.0))) == ["heading", "paragraph", "noise"]


def test_render_text(spark):
    kinded = lambda k: lambda c: X.render_text(c, F.lit(k))
    assert column(spark, ["1. one 2. two", "• a\n• b", "(1) x (2) y", "3.14 is", None], kinded("list")) == ["1. one\n2. two", "• a\n• b", "(1) x\n(2) y", "3.14 is", ""]
    assert column(spark, ["日本 語", "a\nb", "50 %", "日本 50 本"], kinded("paragraph")) == ["日本語", "a b", "50%", "日本50本"]
    assert column(spark, ["」\nx\n\n y  z", "text」", '"'], kinded("toc")) == ["x\ny z", "text", '"']


def test_sentence_chunks(spark):
    assert column(spark, ["一。 二！ 三", "a! b", "no end", "x。y"], X.sentence_chunks) == [["一。", "二！", "三"], ["a!", "b"], ["no end"], ["x。y"]]


def test_split_lines(spark):
    texts = ["a\nb", "a\r\nb\n", "\n", "", "a\x0bb\x1cc\x85d e"]
    assert column(spark, texts, X.split_lines) == [t.splitlines() for t in texts]


def flowed(text, keep):
    text = re.sub(r"([A-Za-z])-\n([A-Za-z])", r"\1\2", text).replace("\r\n", "\n")
    if not keep:
        return " ".join(text.split())
    parts = re.split(r"\n\s*\n+", text)
    return "\n\n".join(" ".join(("|" + p + "|").split())[1:-1] for p in parts)


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab-\n\r \t.é1"), max_size=12), min_size=30, max_size=60))
def test_flattened_like_python(spark, values):
    assert column(spark, values, lambda c: X.for_translation(c, False)) == [flowed(v, False) for v in values]
    assert column(spark, values, X.split_lines) == [v.splitlines() for v in values]
    assert column(spark, values, X.is_noise) == [len(v.strip()) <= 1 or bool(re.fullmatch(r"\d+", v.strip())) for v in values]
