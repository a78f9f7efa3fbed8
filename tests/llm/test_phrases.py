import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from folioflow.llm import phrases, queries
from tests.llm.common import documents, save


def brute(rows, window):
    """Kept words of each (id, text), by all window sequences."""
    first = {}
    cut = lambda t: (t or "").encode().split()
    for d, t in rows:
        w = cut(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = {}
    for d, t in rows:
        w = cut(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d, t] = [x for x, g in zip(w, gone) if not g]
    return out


def kept(spark, rows, window, phrase):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = phrases.repeats(frame, window=window, phrase=phrase)
    make = lambda text, words: (text.encode().split() if words is None else words,)
    out = phrases.edit(frame, found, make, [T.StructField("kept", T.ArrayType(T.BinaryType()))], window=window).collect()
    assert len(out) == len(rows)
    return {(r.doc_id, r.text): [bytes(x) for x in r.kept] for r in out}


@pytest.mark.parametrize("seed", range(5))
def test_like_brute_force(spark, seed, monkeypatch):
    if seed == 4:
        monkeypatch.setattr(phrases, "AUTOMATON", 5)  # many shards
    rand = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3 if seed == 0 else 200)]
    passages = [rand.choices(vocabulary, k=rand.randrange(5, 30)) for _ in range(6)]
    rows = []
    for _ in range(60):
        words = []
        for _ in range(rand.randrange(5)):
            words += rand.choice(passages) if rand.random() < 0.6 else rand.choices(vocabulary, k=rand.randrange(12))
            if rand.random() < 0.3 and words:
                words[rand.randrange(len(words))] = "edit"
        rows.append((rand.randrange(80), " ".join(words)))
    rows += rows[:4] + [(None, rows[0][1]), (90, rows[1][1]), (91, None), (92, ""), (93, rows[2][1].replace(" ", "\n\t"))]
    assert kept(spark, rows, 8, 3) == brute(rows, 8)


def test_anchors_are_shared():
    rand = np.random.default_rng(1)
    passage = rand.integers(0, 1 << 62, 60).astype(np.uint64)
    a, b = (np.concatenate((rand.integers(0, 1 << 62, n).astype(np.uint64), passage, rand.integers(0, 1 << 62, 40).astype(np.uint64))) for n in (13, 70))
    assert len(np.intersect1d(phrases.anchors(a)[1], phrases.anchors(b)[1])) >= 1
    assert len(phrases.anchors(a[:49])[0]) == 0 and len(phrases.anchors(a[:50])[0]) == 1


def test_covered():
    kept = lambda text, starts, window: b"".join(w for w, g in zip(*phrases.covered(text, starts, window)) if not g)
    assert kept("a b c d e f", [1], 3) == b"aef" and kept("a b a b c a b", [0], 2) == b"c"
    assert kept("a b", None, 5) == b"" and kept("", None, 2) == b""


def test_hard_rows(spark, tmp_path):
    long = " ".join(map(str, range(70)))
    texts = [None, "", long, long, "x " + long, "word " * 120, "word " * 60, "漢字 " * 55, long.replace(" ", "\x0b"), long.replace(" ", "\xa0")]
    rows = list(enumerate(texts))
    want = brute(rows, 50)
    for r in queries.op9_substring_dedup(spark, save(documents(spark, texts), tmp_path)).collect():
        words = want[r.doc_id, texts[r.doc_id]]
        n = len((texts[r.doc_id] or "").encode().split())
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest())
    assert queries.op9_substring_dedup(spark, save(documents(spark).limit(0), tmp_path / "none")).count() == 0


def test_other_columns_stay(spark):
    long = " ".join(map(str, range(60)))
    frame = spark.createDataFrame([(1, long, 5, "a"), (2, long, 6, "b"), (3, "own", 7, "c")], "doc_id long, text string, starts int, tag string")
    out = phrases.edit(frame, phrases.repeats(frame), lambda t, w: (t if w is None else b" ".join(w).decode(),), [T.StructField("text", T.StringType())])
    assert sorted((r.doc_id, r.starts, r.tag, r.text) for r in out.collect()) == [(1, 5, "a", long), (2, 6, "b", ""), (3, 7, "c", "own")]
