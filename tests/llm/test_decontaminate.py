import random
import re
from collections import defaultdict

from folioflow.llm import decontaminate as D
from folioflow.llm import queries
from tests.llm.common import documents, save

ITEM = "Alice buys 12 apples at 3 dollars each and then gives Bob 5 of them before she walks 7 km to the market"


def found(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in D.matches(docs, items, **options).collect()}


def test_kinds_of_match(spark):
    changed = ITEM.replace("Alice", "Mary").replace("Bob", "Tom").replace("12", "40").replace(" 5 ", " 9 ").replace("km", "miles")
    mixed = changed.replace("Tom", "Mary")  # two names become one
    docs = [(1, f"Some words before. {ITEM} and words after."), (2, f"x y z {changed} end"), (3, "Nothing of the kind is in this text at all, not at all."),
            (4, f"x {mixed} end"), (5, ITEM.upper()), (6, ITEM.replace(" ", " , ")), (7, None), (None, ITEM), (8, ""), (1, "another text of the same id")]
    got = found(spark, docs, [(9, ITEM), (None, ITEM), (10, None)])
    assert {k for k, r in got.items() if r.verbatim} == {(1, 9), (5, 9), (6, 9)}
    assert (2, 9) in got and not got[2, 9].verbatim and got[1, 9].first_word == 3
    assert (3, 9) not in got and (4, 9) not in got and all(k[0] is not None for k in got)


def test_share_of_windows(spark):
    words = [f"w{chr(97 + i)}q" for i in range(24)]
    cut = lambda n: " ".join(words[:n])
    got = found(spark, [(n, "pre " + cut(n) + " post") for n in (24, 20, 19, 12)], [(0, cut(24))])
    assert {k[0]: r.n_found for k, r in got.items()} == {24: 20, 20: 16}
    assert got[20, 0].similarity == 0.8


def test_repeated_numbers_must_agree(spark):
    item = "first take 4 red balls and then add 4 blue balls to the old box"
    docs = [(1, item.replace("4", "6")), (2, item.replace("4 red", "6 red")), (3, item.replace("4 red", "6 red") + " . " + item)]
    assert {k[0] for k in found(spark, docs, [(0, item)])} == {1, 3}


def test_a_changed_value_leaves_verbatim_windows(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(60)]
    item = " ".join(["take 4 red", *words[:30], "and 4 blue for Ann", *words[30:], "with Bob too"])
    docs = [(1, item.replace("4 red", "6 red")), (2, item.replace("Ann", "Bob")), (3, " ".join(words[i] for i in range(0, 60, 2)))]
    got = found(spark, docs, [(0, item)])
    total = len(item.split()) - 4
    assert {k[0]: (r.verbatim, r.n_found) for k, r in got.items()} == {1: (True, total - 2), 2: (True, total - 5)}


def test_short_items(spark):
    docs = [(1, "two words"), (2, "here are two words too"), (3, "Two words!"), (4, "two other words"), (5, "words two"), (6, "we pay 7 euros there"), (7, "two")]
    got = found(spark, docs, [(0, "two words"), (1, ""), (2, "?!"), (3, "pay 5 euros there"), (4, "Two"), (5, ITEM)])
    assert set(got) == {(1, 0), (2, 0), (3, 0), (6, 3), *((d, 4) for d in (1, 2, 3, 4, 5, 7))}
    assert {k: r.first_word for k, r in got.items()}[2, 0] == 2 and not got[6, 3].verbatim and got[6, 3].n_windows == 1


def test_numbers_alone_match_as_they_are(spark):
    assert set(found(spark, [(1, "1 2 3 4 5 6 7"), (2, "9 8 7 6 5 4 3")], [(0, "1 2 3 4 5 6 7")])) == {(1, 0)}


def test_reading_words():
    assert D.read("5kg,") == [("5", D.NUMBER), ("kg", D.UNIT)] and D.read("$3.50") == [("3.50", D.NUMBER), ("$", D.UNIT)] and D.read("***") == []
    assert D.read("(Berlin)") == [("berlin", D.NAME)] and D.read("km.") == [("km", D.UNIT)] and D.read("B2B") == [("b2b", D.NAME)]


def test_empty_tables(spark):
    assert not found(spark, [], [(0, ITEM)]) and not found(spark, [(1, ITEM)], []) and not found(spark, [], [])
    docs = documents(spark)
    assert D.clean(docs, spark.createDataFrame([], "item_id long, text string")).count() == docs.count()


def test_clean(spark):
    docs = spark.createDataFrame([(1, ITEM), (2, "clean text"), (None, ITEM), (1, ITEM)], "doc_id long, text string")
    left = D.clean(docs, spark.createDataFrame([(0, ITEM)], "item_id long, text string"))
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 2]


def test_one_of_two_equal_slots(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(60)]
    for slot, other in (("Bob", "Tom"), ("12", "13")):
        item = words[:10] + [slot] + words[11:45] + [slot] + words[46:]
        changed = item[:45] + [other] + item[46:]
        got = found(spark, [(1, " ".join(changed))], [(0, " ".join(item))])
        assert got[1, 0].verbatim and got[1, 0].n_found == 51 and abs(got[1, 0].similarity - 51 / 56) < 1e-9


def plain_readings(text, sizes):
    """(place, size, what stands there, slots) of each window: as it is, with numbers and units, and with names too taken out."""
    tokens = [list(t) for w in text.split() for t in D.read(w)]
    for i, t in enumerate(tokens):
        if t[1] == D.UNIT and (i == 0 or tokens[i - 1][1] != D.NUMBER):
            t[1] = D.PLAIN
    out = set()
    for size in sizes or [min(5, len(tokens))]:
        for i in range(len(tokens) - size + 1 if size else 0):
            part = tokens[i : i + size]
            out.add((i, size, tuple(v for v, _ in part), ()))
            for kinds, needed in (((D.NUMBER, D.UNIT), (D.NUMBER, D.UNIT)), ((D.NUMBER, D.UNIT, D.NAME), (D.NAME,))):
                if any(k in needed for _, k in part) and sum(k not in kinds for _, k in part) >= 2:
                    out.add((i, size, tuple(("slot", k) if k in kinds else v for v, k in part), tuple((k, v) for v, k in part if k in kinds)))
    return out


def plain_matches(docs, items):
    """All windows of all items against all windows of all documents."""
    out = {}
    read = {b: plain_readings(t, None) for b, t in items}
    sizes = {w[1] for ws in read.values() for w in ws}
    for d, t in docs:
        here = plain_readings(t, sizes)
        for b, ws in read.items():
            lines = defaultdict(set)
            for p, z, what, slots in ws:
                for q, y, other, values in here:
                    if z == y and what == other and len(slots) == len(values):
                        lines[q - p].add((p, slots, values))
            places, same = set(), set()
            for met in lines.values():
                pairs = {x for _, s, v in met for x in zip(s, v)}
                torn = {s for s, v in pairs if any(s == s2 and v != v2 for s2, v2 in pairs)}
                fused = {v for s, v in pairs if s[0] == D.NAME and any(v == v2 and s != s2 and s2[0] == D.NAME for s2, v2 in pairs)}
                places |= {p for p, s, v in met if not torn & set(s) and not fused & set(v)}
                same |= {p for p, s, _ in met if not s}
            total = len({p for p, *_ in ws})
            if total and len(places) >= 0.8 * total:
                out[d, b] = (len(places), len(same) >= 0.8 * total)
    return out


def test_templates_like_plain(spark):
    rng = random.Random(3)
    words = ["red", "blue", "old", "box", "take", "put", "Ann", "Bob", "Tom", "4", "6", "12", "kg", "km", "5kg", "$7"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((0, 2, 3, 6, 9, 12))))) for i in range(60)]
    docs = []
    for i in range(300):
        parts = rng.choice(items)[1].split()
        swap = {w: rng.choice(words) for w in rng.sample(words, 3)}
        parts = [swap.get(w, w) if rng.random() < 0.7 else w for w in parts]
        docs.append((i, " ".join([rng.choice(words) for _ in range(rng.randrange(4))] + parts + [rng.choice(words) for _ in range(rng.randrange(4))])))
    got = {k: (r.n_found, r.verbatim) for k, r in found(spark, docs, items).items()}
    want = plain_matches(docs, items)
    assert got == want and len(want) > 100 and any(not v for _, v in want.values())


def words_of(text):
    return [x for x in (re.sub(r"^[\W_]+|[\W_]+$", "", w).lower() for w in text.split()) if x]


def brute(docs, items):
    """Verbatim matches: shares of equal five-word windows."""
    grams, total = defaultdict(set), {}
    for b, t in items:
        w = words_of(t)
        total[b] = len(w) - 4
        for i in range(len(w) - 4):
            grams[tuple(w[i : i + 5])].add((b, i))
    out = {}
    for d, t in docs:
        w, seen = words_of(t), defaultdict(set)
        for k in range(len(w) - 4):
            for b, i in grams.get(tuple(w[k : k + 5]), ()):
                seen[b].add(i)
        out |= {(d, b): len(s) for b, s in seen.items() if len(s) >= 0.8 * total[b]}
    return out


def test_query(spark, sf_dir, tmp_path):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = queries.op4_decontamination(spark, sf_dir).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert {(r.doc_id, r.item_id): r.n_found for r in rows if r.verbatim} == want
    save(documents(spark), tmp_path)
    save(spark.createDataFrame([(0, ITEM, 1)], "item_id long, text string, doc_id int").drop("doc_id"), tmp_path, "benchmark")
    assert queries.op4_decontamination(spark, str(tmp_path)).count() == 0
