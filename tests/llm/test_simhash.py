import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioflow.llm import components, queries
from folioflow.llm import simhash as S
from tests.llm.common import TEXTS, documents, save

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, ids):
    """Smallest id of each row's component, by comparing all pairs."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint():
    rand = random.Random(5)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = " ".join(rand.choices(["The", "ä", "Éx", "B\x85b", "q"], k=n))
        assert S.fingerprint(text) == plain(text)
    assert [S.fingerprint(t or "") for t in TEXTS] == [plain(t) for t in TEXTS]


@pytest.mark.parametrize("bucket", [1, 4, 64])
def test_components_like_all_pairs(spark, bucket):
    rand = random.Random(bucket)
    prints = []
    for _ in range(12):
        base = rand.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rand.randrange(5)):
                x ^= 1 << rand.randrange(64)
            prints.append(x)
    prints += prints[:30]
    ids = list(range(len(prints)))
    rand.shuffle(ids)
    distinct = spark.createDataFrame([(signed(x),) for x in set(prints)], "fp long")
    edges = S.links(distinct, bucket)
    assert all((r.a ^ r.b).bit_count() <= 2 if (r.a ^ r.b) >= 0 else ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in edges.collect())
    roots = {r.node: r.root for r in components.components(edges, "a", "b").collect()}
    want = linked(prints, [signed(x) for x in prints])
    assert [roots.get(signed(x), signed(x)) for x in prints] == want
    got = {r.doc_id: r.component_id for r in S.groups(spark.createDataFrame([(d, signed(x)) for d, x in zip(ids, prints)], "doc_id long, fp long")).collect()}
    assert [got[d] for d in ids] == linked(prints, ids)


def test_components(spark):
    rand = random.Random(1)
    chain = [(i, i + 1) for i in range(60)] + [(100 + rand.randrange(40), 100 + rand.randrange(40)) for _ in range(50)] + [(200, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(chain + [(None, 5)], "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[200 + i] == 200 for i in range(50))
    near = {i: {i} for i in range(100, 140)}
    for a, b in chain[60:110]:
        joined = near[a] | near[b]
        for x in joined:
            near[x] = joined
    assert all(got[i] == min(s) for i, s in near.items() if len(s) > 1)
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_query(spark, sf_dir, tmp_path):
    for folder in (sf_dir, save(documents(spark), tmp_path)):
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        prints = [plain(t) for _, t in rows]
        want = sorted(zip([d for d, _ in rows], [f"{x:016x}" for x in prints], linked(prints, [d for d, _ in rows])))
        assert sorted(tuple(r) for r in queries.op7_simhash(spark, folder).collect()) == want
    assert queries.op7_simhash(spark, save(documents(spark).limit(0), tmp_path / "none")).count() == 0


def test_keep_one(spark):
    rows = [(3, "same text of many words here"), (1, "same text of many words here"), (1, "same text of many words here"), (2, "other text of many words there"),
            (2, "other text of many words there"), (4, "alone"), (None, "alone"), (5, None), (6, "")]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("own")))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, rows[0][1]), (2, rows[3][1]), (4, "alone"), (5, None)]
    assert kept.columns == ["doc_id", "text", "fp"]


def test_wide():
    rand = np.random.default_rng(3)
    for n, bits in ((1, 16), (2, 16), (254, 17), (255, 30), (256, 19), (9000, 21)):
        hashes = rand.integers(-(1 << 63), 1 << 63, n, np.int64)
        words = [hashes.view(np.uint64)] + [S.mix64(hashes.view(np.uint64) + np.uint64(j * S.BASES[0] & (1 << 64) - 1)) for j in range(1, 1 + -(-S.SEGMENTS * bits // 64))]
        plain = [2 * int((w >> np.uint64(b) & np.uint64(1)).sum()) > n for w in words for b in range(64)]
        word, marks = S.wide(hashes, bits)
        assert word == signed(sum(1 << b for b in range(64) if plain[b]))
        assert marks.tolist() == [sum(1 << b for b in range(bits) if plain[64 + i * bits + b]) for i in range(S.SEGMENTS)]
    assert [S.segment_bits(n) for n in (0, 1000, 1 << 17, 1 << 24, 1 << 40)] == [16, 16, 19, 26, 30]


@pytest.mark.parametrize("following", [1, 3, 40])
def test_candidates(spark, following):
    rand = random.Random(following)
    rows = []
    for g in range(4):
        word, marks = rand.getrandbits(64), [rand.randrange(1 << 16) for _ in range(S.SEGMENTS)]
        for _ in range(12):
            x = word
            for _ in range(rand.randrange(16)):
                x ^= 1 << rand.randrange(64)
            rows.append((signed(rand.getrandbits(64)), signed(x), [m if rand.random() < 0.2 else rand.randrange(1 << 16) for m in marks]))
    rows.append((5, rows[0][1], rows[0][2]))
    got = sorted(tuple(r) for r in S.candidates(spark.createDataFrame(rows, "fp long, print long, marks array<int>"), 20, following).collect())
    want = set()
    for p in range(S.SEGMENTS):
        for mark in {r[2][p] for r in rows}:
            members = sorted((x, a) for a, x, marks in rows if marks[p] == mark)
            for i, (x, a) in enumerate(members):
                want |= {(min(a, b), max(a, b)) for y, b in members[i + 1 : i + 1 + following] if ((x ^ y) & (1 << 64) - 1).bit_count() <= 20}
    assert got == sorted(want) and len(want) > 30
