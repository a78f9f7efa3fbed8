import pytest

from folioflow.operators import paragraphs
from folioflow.sources import blocks as B
from folioflow.sources import pdf
from folioflow.streaming import arrivals


def test_blocks_round_trip(spark, tmp_path):
    rows = [(0, 0, [0.0, 0.0, 1.0, 1.0], "日本", 9.0, [0.0, 0.0, 0.0], "F", 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1, 0)]
    frame = spark.createDataFrame(rows, B.BLOCK)
    path = str(tmp_path / "a.json")
    B.export_array(frame, path, "block_idx")
    assert "日本" in open(path, encoding="utf-8").read() and B.count_items(path) == 1 and B.count_items(path + "x") is None
    back = B.read_blocks(spark, path).first()
    assert (back.text, back.ordinal, back.bbox) == ("日本", 0, [0.0, 0.0, 1.0, 1.0])
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(Exception):
        B.read_blocks(spark, str(tmp_path / "bad.json")).collect()


def test_raw_blocks(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF-")
    with pytest.raises(FileNotFoundError):
        pdf.read_raw(spark, str(tmp_path / "missing.pdf"))

    def parse(content):
        span = lambda t: {"text": t, "font": "F", "size": 9.0, "color": 0x0000FF}
        yield {"page": 0, "block_no": 0, "type": 0, "bbox": [0.0, 0.0, 9.0, 9.0], "lines": [
            {"bbox": [1.0, 2.0, 3.0, 4.0], "spans": [span("Hello "), span("you.")]}, {"bbox": [30.0, 5.0, 40.0, 9.0], "spans": [span("Next")]}]}
        yield {"page": 0, "block_no": 1, "type": 1, "bbox": [0.0, 0.0, 9.0, 9.0], "lines": []}
        yield {"page": 0, "block_no": 2, "type": 0, "bbox": [0.0, 0.0, 9.0, 9.0], "lines": [{"bbox": [], "spans": [span(" ")]}, {"bbox": [], "spans": [span("x")]}]}

    got = paragraphs.extract_blocks(pdf.read_raw(spark, str(tmp_path / "x.pdf"), parse)).orderBy("block_idx").collect()
    assert [(r.block_idx, r.text, r.bbox, r.color, r.line_count) for r in got] == [
        (0, "Hello you.", [1.0, 2.0, 3.0, 4.0], [0.0, 0.0, 1.0], 1), (1, "Next", [30.0, 5.0, 40.0, 9.0], [0.0, 0.0, 1.0], 1), (2, "x", [0.0, 0.0, 9.0, 9.0], [0.0, 0.0, 1.0], 1)]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"doc_id":"d","ordinal":0,"page":0,"block_idx":0,"text":"some text","size":9.0,"font":"F"}\n')
    query = arrivals.stats_stream(arrivals.arriving_blocks(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first()["items"] == 1
