import random
import subprocess
import sys
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioflow.llm import queries, sharding
from tests.conftest import ROOT
from tests.llm.common import TEXTS, documents, save


def check(rows, n, sizes):
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    assert sorted(r["size"] for r in rows) == sorted(sizes)
    total, largest = sum(sizes), max(sizes)
    before = None
    for s in range(n):
        own = sorted(shards[s], key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / n) <= largest
        for r in own:  # contiguous in the order of ids
            assert before is None or r["doc_id"] >= before
            before = r["doc_id"]


@pytest.mark.parametrize("seed", range(3))
def test_random_sizes(spark, seed):
    rand = random.Random(seed)
    rows = [(rand.randrange(400) if seed else i, rand.choice([1, 5, 50, 3000])) for i in range(1500)]
    out = sharding.contiguous_shards(spark.createDataFrame(rows, "doc_id long, n long").repartition(5), 7, F.col("n"), ["doc_id", "n"])
    check(out.collect(), 7, [n for _, n in rows])


def test_repeated_row_fills_several_shards(spark):
    rows = [(5, 10)] * 600 + [(i, 10) for i in range(1000, 1300)]
    out = sharding.contiguous_shards(spark.createDataFrame(rows, "doc_id long, n long"), 9, F.col("n"), ["doc_id", "n"]).collect()
    check(out, 9, [10] * 900)
    assert len({r["shard"] for r in out if r["doc_id"] == 5}) == 6


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(1, 4), (2, 4)], "doc_id long, n long")
    out = sharding.contiguous_shards(frame, 16, F.col("n"), ["doc_id"]).collect()
    assert len({r["shard"] for r in out}) == 2 and all(r["slot"] == 0 for r in out)
    assert sharding.contiguous_shards(frame.limit(0), 16, F.col("n"), ["doc_id"]).count() == 0
    assert sharding.contiguous_shards(frame, 4, F.lit(0), ["doc_id"]).count() == 2
    with pytest.raises(ValueError):
        sharding.contiguous_shards(frame, 0, F.col("n"), ["doc_id"])


def test_query(spark, tmp_path):
    rows = queries.op1_sharding(spark, save(documents(spark), tmp_path)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        raw = (TEXTS[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)


def test_equal_texts_stand_together(spark, tmp_path):
    rand = random.Random(2)
    texts = [f"text {rand.randrange(80)} " * 9 for _ in range(900)] + ["the same of a third"] * 450
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = queries.op1_sharding(spark, save(frame.repartition(3), tmp_path)).collect()
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r["shard"])
    assert sum(len(x) > 1 for t, x in where.items() if "third" not in t) <= 15
    totals = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(16)]
    assert max(totals) - min(totals) <= 2 * max(r["size"] for r in rows)


@pytest.mark.parametrize("name", ["op1_sharding", "op6_license_scan"])
def test_no_python_on_the_main_path(spark, sf_dir, name, tmp_path):
    """With no Python to start, the query runs: all plans, those cut off by checkpoints too."""
    code = f"""
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate())
spark.sparkContext.pythonExec = "/nowhere/python"
print("rows", entry.queries()["{name}"](spark, "{sf_dir}").toArrow().num_rows)
try:
    spark.range(3).mapInArrow(lambda x: x, "id long").count()
    print("python ran")
except Exception:
    print("no python")
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=ROOT)
    assert "rows 200" in done.stdout and "no python" in done.stdout and "python ran" not in done.stdout, done.stderr[-2000:]
