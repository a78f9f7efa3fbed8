import random

import numpy as np
import pytest

import corpus_pipeline
from folioflow.llm import near as N
from folioflow.llm import simhash as S


def plain(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def linked(rows):
    """Smallest id of each row's component, by comparing all pairs."""
    sets = [plain(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root):
        least[r] = min(least.get(r, d), d)
    return [least[r] for r in root]


def corpus(seed):
    """Groups of near copies of several distances, all texts with one common passage, and some short ones."""
    rand = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    texts = ["", None, "one two", "One  two", "one two three"]
    for g in range(6):
        base = [f"w{rand.randrange(5000)}" for _ in range(rand.choice([30, 90, 200]))] + common
        for _ in range(25):
            words = base.copy()
            for _ in range(rand.randrange(8)):
                words[rand.randrange(len(words))] = f"x{rand.randrange(10**6)}"
            texts.append(" ".join(words[: len(words) - rand.randrange(12)]))
    ids = rand.sample(range(1000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("bucket,block", [(64, 512), (2, 8)])
def test_links_like_all_pairs(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(N.links, "__defaults__", (bucket, block))
    rows = corpus(bucket)
    kept = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(linked(rows)))


def test_two_balls_in_one_bucket(spark, monkeypatch):
    """Texts near the pivot, texts near these only, and another group, all behind one kept shingle."""
    monkeypatch.setattr(N.links, "__defaults__", (2, 4))
    base = [f"w{i}" for i in range(60)]
    change = lambda words, *at: [f"y{i}" if i in at else w for i, w in enumerate(words)]
    rows = [" ".join(change(base, 40)), " ".join(change(base, 40, 46)), " ".join(change(base, 46)), " ".join(change(base, 46, 52)), " ".join(change(base, 20, 46, 52, 30)),
            " ".join(["z"] * 5 + base[:5]), " ".join(["z"] * 5 + base[:5] + ["end"])]
    rows = list(enumerate(rows * 2)) + [(100 + i, " ".join(change(base, 40 + i))) for i in range(15)]
    kept = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(linked(rows)))


def test_order_of_shingles_changes_no_result(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(N, "SAMPLE", 1)
    assert len(N.frequent(spark.createDataFrame(rows, "doc_id long, text string"), "text")[0])
    kept = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(linked(rows)))


def test_prefix():
    assert [N.kept(n) for n in (1, 2, 4, 5, 6, 10, 11)] == [1, 1, 1, 2, 2, 3, 3]
    assert N.prefix(np.arange(10), np.array([0, 1]), np.array([9, 3])).tolist() == [2, 3, 4]


def test_stage_removes_near_copies(spark, sf_dir):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base), " ".join(base[:50] + ["other"] + base[51:]), " ".join(base[:20] + ["x"] + base[21:60] + ["y"] + base[61:])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").select("doc_id").orderBy("doc_id").collect()] == [0]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, sf_dir).collect()} == set(linked(rows))


def test_fingerprints_link_before_shingles(spark, monkeypatch):
    """Without the completion by shingles, what stays linked is what the stage's SimHash fingerprints found."""
    rand = random.Random(7)
    rows = []
    for g in range(5):
        base = [f"w{rand.randrange(10**6)}" for _ in range(200)]
        rows += [(10 * g, " ".join(base)), (10 * g + 1, " ".join(base[:100] + ["other"] + base[101:])), (10 * g + 2, " ".join(base[1:190]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(N, "links", lambda nodes, *rest: spark.createDataFrame([], "a long, b long"))
    kept = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(linked(rows))) == [0, 10, 20, 30, 40]


@pytest.mark.parametrize("bucket,block", [(64, 512), (2, 8)])
def test_shingles_find_what_fingerprints_leave(spark, monkeypatch, bucket, block):
    """No fingerprint finds anything, or each finds some: the groups are the same."""
    monkeypatch.setattr(N.links, "__defaults__", (bucket, block))
    rows = corpus(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(set(linked(rows)))
    for radius in (-1, 5):
        monkeypatch.setattr(N, "candidates", lambda prints: S.candidates(prints, radius))
        assert sorted(r.doc_id for r in N.keep_one(docs).collect()) == want
