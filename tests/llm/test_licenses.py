import random
import re

from folioflow.llm import licenses as L
from folioflow.llm import queries
from tests.llm.common import documents, save

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(spark, folder, texts):
    rows = queries.op6_license_scan(spark, folder).collect()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    return {r.doc_id: r for r in rows}


def test_statements(spark, tmp_path):
    texts = ["Licensed under CC BY-NC 4.0.", "CC by cc BY, cc-by; cc  by", "This work is licensed under the GNU General Public License, version 3.", "ALL rights   reserved! all rights reserved",
             "Released under the MIT License.", "SPDX-License-Identifier: Apache-2.0", "Copyright (c) 2019 X. Permission is hereby granted, free of charge, to any person obtaining a copy",
             "accby bycc by", "see http://www.apache.org/licenses/LICENSE-2.0", "", None, "Éall rights reserved", "general public\x00license", "all rights reserved " * 400]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = check(spark, save(frame, tmp_path), texts)
    labels = {i: r.labels for i, r in rows.items()}
    assert labels[0] == "cc-by,cc-by-nc" and labels[2] == "gpl,gpl-3.0" and labels[3] == "all-rights-reserved,reserved" and labels[4] == "mit"
    assert labels[5] == "spdx:apache-2-0" and labels[6] == "copyright-year,mit-text" and labels[7] == "" and labels[8] == "url-apache-2.0"
    assert rows[10].score == 0 and rows[13].n_base == 400 and rows[13].last_word == 1197


def test_hard_rows_and_documents(spark, sf_dir, tmp_path):
    check(spark, sf_dir, {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()})
    hard = documents(spark)
    check(spark, save(hard, tmp_path), {r.doc_id: r.text for r in hard.collect()})
    assert queries.op6_license_scan(spark, save(hard.limit(0), tmp_path / "none")).count() == 0


def test_suppression(spark):
    rules = [L.Rule("big", "alpha licen", "alpha license two", 1, 0.9), L.Rule("small", "licen", "license", 2, 0.5), L.Rule("same", "licen", "license two", 1, 0.7),
             L.Rule("over", "licen", "two licens[a-z]+", 1, 0.6), L.Rule("strong", "licen", "license", 0, 1.0)]
    frame = spark.createDataFrame([("alpha license two licensing license",)], "text string")
    found = L.scan(frame, signatures=rules).first().detections
    assert [(d.start, d.end, d.label) for d in found] == [(0, 3, "big"), (1, 2, "strong"), (2, 4, "over"), (4, 5, "strong")]


def plain_detections(text, signatures):
    """All matches of all rules, each compared with every other."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    line = " " + " ".join(words) + " "
    found = set()
    for r in signatures:
        for m in re.finditer(f"(?<= )(?:{r.expression})(?= )", line):
            a, b = line[: m.start()].count(" ") - 1, line[: m.end()].count(" ")
            found.add((a, b, r.priority, r.label, r.confidence))

    def goes(x):
        for y in found:
            if y != x and y[0] <= x[0] and y[1] >= x[1]:
                wider = (y[0], y[1]) != (x[0], x[1])
                if y[2] < x[2] or y[2] == x[2] and (wider or y[3:] < x[3:]):
                    return True
        return False

    return sorted((a, b, label, p, c) for a, b, p, label, c in found if not goes((a, b, p, label, c)))


def test_detections_like_plain(spark, sf_dir):
    """Every rule's samples, mixed into each other, and all documents of a table."""
    rng = random.Random(7)
    made = L.rules()
    parts = [rng.choice(samples(re._parser.parse(r.expression))) for r in made]
    mixed = [" and ".join(rng.sample(parts, 4)) + "." for _ in range(250)] + [p.title() for p in parts]
    mixed += [" ".join(w for p in rng.sample(parts, 3) for w in p.split()[: rng.randrange(1, 9)]) for _ in range(150)]
    for frame in (spark.createDataFrame([(x,) for x in mixed], "text string"), spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")):
        rows = L.scan(frame).collect()
        some = 0
        for r in rows:
            got = sorted((d.start, d.end, d.label, d.priority, d.confidence) for d in r.detections)
            assert got == plain_detections(r.text, made), r.text
            some += bool(got)
        assert some > 5


def test_only_ascii_letters_change_case(spark):
    r = L.scan(spark.createDataFrame([("\u212AEY \u0130 All Rights Reserved",)], "text string")).first()  # the Kelvin sign's lower case is an ASCII letter
    assert r.n_words == 5 and [b.start for b in r.base] == [2]


def test_clashing_columns(spark):
    r = L.scan(spark.createDataFrame([("CC BY", 7, "x", "y")], "text string, n_words int, base string, detections string")).first()
    assert r.n_words == 2 and r.base[0].label == "cc-by"


def test_rules():
    made = L.rules()
    assert len(made) > 350 and all(0 <= r.priority < L.LEVELS and 0 < r.confidence <= 1 for r in made)
    assert not any(re.fullmatch(r.expression, "") for r in made)


def samples(parsed):
    """Texts that an expression matches: every alternative, and parts that may repeat once more than they must."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [chr(x) if str(o) == "LITERAL" else chr(x[0]) if str(o) == "RANGE" else "7" for o, x in arg]
        elif name == "BRANCH":
            more = [x for part in arg[1] for x in samples(part)]
        elif name == "SUBPATTERN":
            more = samples(arg[3])
        elif name == "ANY":
            more = ["x"]
        else:
            assert name in ("MAX_REPEAT", "MIN_REPEAT"), name
            once = samples(arg[2])
            more = [x * n for n in {arg[0], min(arg[1], arg[0] + 1)} for x in once]
        out = [a + b for a in out for b in more]
    return out


def test_keyword_stands_in_every_match():
    names = [(k, x) for _, k, x in L.NAMES + L.SENTENCES] + [(k, x) for _, k, x, *_ in L.OTHERS]
    for keyword, expression in names:
        made = samples(re._parser.parse(expression))
        assert any(s in f" {keyword} " for s in L.STEMS) and all(re.fullmatch(expression, x) and keyword in x for x in made), (keyword, expression)


def test_alternatives_without_the_label_in_them(spark):
    texts = ["Released under the Expat License.", "See the Responsible AI License for details"]
    found = L.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [{d.label for d in r.detections} & {"mit", "openrail"} for r in found] == [{"mit"}, {"openrail"}]


def test_no_python(spark, sf_dir):
    plan = queries.op6_license_scan(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))
