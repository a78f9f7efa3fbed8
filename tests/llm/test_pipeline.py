import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import test_decontaminate as D
from tests.llm import test_near as N
from tests.llm import test_phrases as P
from tests.llm.common import documents, save
from tests.llm.test_tokens import ORACLE


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "substring_dedup", "decontamination", "byte_bpe"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()


def test_like_brute_force(spark, sf_dir):
    """All documents here are in a learned language, and parameters in leaked passages are those of the item. Near copies are those whose sets of
    five-word shingles have a Jaccard similarity of 0.8 at least."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = [(d, t) for (d, t), least in zip(docs, N.linked(docs)) if d == least]
    left = P.brute(docs, 50)
    docs = [(d, t if len(left[d, t]) == len(t.split()) else b" ".join(left[d, t]).decode()) for d, t in docs]
    docs = [(d, t) for d, t in docs if t]
    leaked = {d for d, _ in D.brute(docs, items)}
    want = {d: (t, ORACLE.encode_ordinary(t)) for d, t in docs if d not in leaked}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: (r.text, r.ids) for r in rows} == want and len(rows) == len(want)
    assert all(r.n_chars == len(r.text) and r.n_tokens == len(r.ids) for r in rows)


def test_each_stage_takes_hard_rows(spark, tmp_path):
    items = spark.createDataFrame([(0, "the same text of some words"), (1, None)], "item_id long, text string")
    folder = save(items, tmp_path, "benchmark")
    hard = documents(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for frame in (hard, hard.limit(0)):
            out = stage(spark, frame, folder)
            out.write.parquet(f"{tmp_path}/{i}{frame is hard}")
            if i < 4:
                assert out.columns == corpus_pipeline.COLUMNS
    kept = lambda i: {r.doc_id for r in spark.read.parquet(f"{tmp_path}/{i}True").collect()}
    assert kept(0) == {3, 4, 5, 6, 8, 9} and kept(1) == {0, 3, 5, 6, 7, 8, 9} and kept(3) == {0, 1, 2, 5, 6, 7, 8, 9}


