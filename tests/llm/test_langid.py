import subprocess
import sys
import zlib

import numpy as np

from folioflow.llm import langid, queries
from tests.llm.common import TEXTS, documents, save

ENGLISH = "the quick brown fox jumps over the lazy dog and then they were walking through the house with another thing"
GERMAN = "der schnelle braune Fuchs springt über den faulen Hund und dann gingen sie durch das Haus mit einem anderen Ding"


def plain_vector(text, dimensions=langid.DIMENSIONS):
    """The definition, letter by letter."""
    clean = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    vectors = {c: langid.letter_vectors(np.array([ord(c)]), dimensions)[0].astype(int) for c in set(clean + " ")}
    clean = f" {clean} " if clean else ""
    return sum((np.roll(vectors[a], 2) * np.roll(vectors[b], 1) * vectors[c] for a, b, c in zip(clean, clean[1:], clean[2:])), np.zeros(dimensions, int))


def test_bundles_like_the_definition():
    texts = [ENGLISH, GERMAN, "", "a", "Ünï çødé 漢字漢", "a1b2  c!"]
    for text, row, n in zip(texts, *langid.bundles(texts, langid.DIMENSIONS)):
        assert np.array_equal(row.astype(int), plain_vector(text))
        assert n == max(0, len(" ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())) if text else 0)
    many = ["".join(chr(0x4E00 + (i * 37 + j) % 3000) for j in range(60)) for i in range(60)]
    assert np.array_equal(langid.bundles(many, 64)[0][7].astype(int), plain_vector(many[7], 64))


def test_runs_and_slices_add_up(monkeypatch):
    texts = [ENGLISH * 3, "x", "", GERMAN, "".join(chr(0x4E00 + i * 7919 % 4000) for i in range(900))]
    whole = langid.bundles(texts, 128)
    for run, size in ((1, 1), (7, 3), (50, 16), (5000, 2)):
        monkeypatch.setattr(langid, "RUN", run)
        monkeypatch.setattr(langid, "SLICE", size)
        assert all(np.array_equal(a, b) for a, b in zip(whole, langid.bundles(texts, 128)))


def test_memory_of_varied_letters():
    """20 MB of varied ideographs in one text."""
    code = """
import random, resource
from folioflow.llm import langid
rng = random.Random(1)
text = "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(1 << 18)) * 26
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert len(text.encode()) > 20_000_000 and langid.bundles([text], langid.DIMENSIONS)[1][0] == len(text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=600)
    assert int(done.stdout.split()[-1]) < 500


def test_prototypes_and_choice_like_plain(spark):
    """Prototypes, cosines and choices from the plain vectors of single texts."""
    known = [(ENGLISH, "en"), (ENGLISH[:40] * 2, "en"), (GERMAN, "de"), ("le chien et la maison", "fr"), (GERMAN[30:], "de"), ("", "fr")]
    frame = spark.createDataFrame(known, "text string, lang string")
    prototypes = langid.learn(frame)
    plain = {}
    for text, lang in known:
        n = len(" ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()))
        weighed = np.rint(plain_vector(text) * (langid.WEIGHT / max(1, n)))
        plain[lang] = plain.get(lang, 0) + weighed
    assert set(prototypes) == set(plain) and all(np.array_equal(prototypes[k], plain[k]) for k in plain)
    asked = ["the house", "das Haus", "la maison", "zzz", GERMAN + ENGLISH, "Über"]
    rows = {r.text: r for r in langid.predict(spark.createDataFrame([(x,) for x in asked], "text string"), prototypes).collect()}
    for text in asked:
        v = plain_vector(text)
        cosine = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in plain.items()}
        best = max(sorted(cosine), key=cosine.get)
        assert rows[text].lang_pred == best and abs(rows[text].score - max(0, cosine[best])) < 1e-6


def test_very_long_text_teaches(spark):
    known = spark.createDataFrame([("ab " * 1_500_000, "x"), ("cd", "y")], "text string, lang string")
    prototypes = langid.learn(known)
    assert all(np.linalg.norm(v) > 0 for v in prototypes.values())


def test_learn_and_predict(spark):
    known = spark.createDataFrame([(ENGLISH, "en"), (GERMAN, "de"), (None, "en"), ("zzz", None)], "text string, lang string")
    prototypes = langid.learn(known)
    assert sorted(prototypes) == ["de", "en"]
    again = langid.learn(known.repartition(3))
    assert all(np.array_equal(prototypes[k], again[k]) for k in prototypes)
    asked = spark.createDataFrame([("they jumped over the dog",), ("durch das Haus gingen",), ("123 !",), (None,), ("",)], "text string")
    rows = langid.predict(asked, prototypes).collect()
    assert [r.lang_pred for r in rows] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in rows) and rows[2].score == 0
    assert {r.lang_pred for r in langid.predict(asked, {}).collect()} == {"und"}
    assert langid.learn(known.limit(0)) == {}


def test_accepted(spark):
    rows = [(0, ENGLISH, "en"), (1, GERMAN, "de"), (2, "12 34", "en"), (3, None, None), (4, "ok", None), (5, "абвгд жзикл мнопр стуфх " * 20, None), (6, "абвгд жзикл мнопр стуфх " * 4, None)]
    kept = langid.accepted(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 4] and kept.columns == ["doc_id", "text", "lang"]


def test_hard_rows(spark, tmp_path):
    rows = queries.op2_language_id(spark, save(documents(spark), tmp_path)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        letters = any(map(str.isalpha, TEXTS[r.doc_id] or ""))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and (r.lang_pred == "und") == (not letters)


def test_held_out_accuracy(spark, sf_dir):
    found = queries.op2_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
