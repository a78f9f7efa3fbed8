import hashlib
import random

import numpy as np
import pytest

from folioflow.llm import fingerprints as P
from folioflow.llm import queries
from folioflow.llm.common import BASES
from tests.llm.common import documents, save


M = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain(text):
    """Phrases one by one, each hashed letter by letter, the least hash of each bin."""
    seen, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            start = end
    least = {}
    for phrase in seen:
        h = mixed(sum(mixed(ord(c) + 1) * pow(BASES[0], i, M + 1) for i, c in enumerate(phrase)) & M)
        least[h >> 58] = min(h, least.get(h >> 58, M))
    return np.array([1 + least[i] % 65535 if i in least else 0 for i in range(64)])


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        text, follower = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        edit = text[: len(text) - k] + follower[:k]
        a, b, c = plain(text), plain(edit), plain(follower)
        out.append((d, len(text), hashlib.sha256(edit.encode()).hexdigest(), P.shown(a), P.shown(b), P.likeness(a, b), P.likeness(a, c)))
    return out


def got(frame):
    return [tuple(r) for r in P.with_next(frame, P.compare, P.FIELDS).collect()]


@pytest.mark.parametrize("n,ids", [(1, 1), (2, 9), (40, 1000), (300, 100_000), (60, 20)])
def test_like_brute_force(spark, n, ids):
    rand = random.Random(n)
    words = ["ab", "abc", "ü", "漢字", "🙂", " ", "xyz "]
    rows = [(rand.randrange(ids), rand.choice([None, "", "x"]) if rand.random() < 0.1 else "".join(rand.choices(words, k=rand.randrange(60)))) for _ in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(got(frame), key=repr) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("n", [1, 2, 50])
def test_ids_of_text_and_days(spark, n):
    rand = random.Random(n)
    rows = [(None if rand.random() < 0.1 else rand.choice(["a", "B", "ü", "🙂"]) * rand.randrange(1, 9), "".join(rand.choices("ab c", k=rand.randrange(40)))) for _ in range(n)]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    places = {r: i for i, r in enumerate(dict.fromkeys(want))}
    like = brute([(places[r], r[1]) for r in rows])
    name = {i: r[0] for r, i in places.items()}
    found = got(spark.createDataFrame(rows, "doc_id string, text string").repartition(3))
    assert sorted(found, key=repr) == sorted(((name[x[0]], *x[1:]) for x in like), key=repr)
    day = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("date_add(DATE'2020-01-01', length(doc_id)) AS doc_id", "text")
    assert len(got(day)) == n


def test_null_ids_come_first(spark):
    rows = [(None, "abc"), (2, "def ghi"), (1, "jkl mno pqr")]
    assert sorted(got(spark.createDataFrame(rows, "doc_id long, text string")), key=repr) == sorted(brute(rows), key=repr)
    alone = [(None, "only this"), (None, "and that")]
    assert sorted(got(spark.createDataFrame(alone, "doc_id long, text string")), key=repr) == sorted(brute(alone), key=repr)


def test_empty_table(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []


def test_likeness():
    a, b = plain("some text that is long enough to have phrases"), plain("")
    assert P.likeness(a, a) == 1 and P.likeness(b, b) == 1 and P.likeness(a, b) == 0
    assert P.shown(a) == P.shown(plain("some text that is long enough to have phrases")) and len(P.shown(a)) == 4 * P.BINS


def test_query(spark, sf_dir, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = [tuple(r) for r in queries.op5_lz_fingerprint(spark, sf_dir).collect()]
    assert sorted(found) == sorted(brute(rows))
    assert sum(r[5] > r[6] for r in found) >= 0.98 * len(found)
    hard = documents(spark)
    assert sorted(tuple(r) for r in queries.op5_lz_fingerprint(spark, save(hard, tmp_path)).collect()) == sorted(brute([(r.doc_id, r.text) for r in hard.collect()]))
