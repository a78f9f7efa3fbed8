import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from folioflow.llm import queries, warc
from tests.llm.common import save


def pages(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}", h, "own") for i, h in rows], "page_id long, url string, html string, digest string")


def brute(rows):
    first = {}
    for i, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            first[h] = max(first.get(h, i), i)
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        again = h in first and first[h] != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return out


BIG = "ü" * 600
ROWS = [(1, BIG), (2, BIG), (9, BIG), (3, "small"), (4, "small"), (5, None), (6, ""), (7, "<p>\r\n\r\nWARC/1.1\r\n" * 100), (8, "y" * 200_000), (9, BIG), (None, BIG), (10, "z" * 999), (11, "z" * 999), (12, "z" * 1000)]


def test_query(spark, tmp_path):
    found = queries.op8_warc(spark, save(pages(spark, ROWS).repartition(3), tmp_path, "pages"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(ROWS), key=repr)
    assert queries.op8_warc(spark, save(pages(spark, []), tmp_path / "none", "pages")).count() == 0


def test_payloads_come_back(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(warc.captures(pages(spark, ROWS)), path)
    rows = {(r.record_id, r.record_type): r for r in warc.read(spark, path).collect()}
    assert bytes(rows["<urn:page:7>", "response"].payload).decode() == ROWS[7][1] and rows["<urn:page:1>", "revisit"].payload is None
    assert rows["<urn:page:1>", "revisit"].refers_to == "<urn:page:9>" and rows["<urn:page:3>", "response"].target_uri == "http://x/3"
    assert not list((tmp_path / "archive").glob("_unfinished*"))


def test_predicates_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(warc.captures(pages(spark, ROWS)), path)
    found = warc.read(spark, path).where("record_type = 'revisit' AND target_uri LIKE 'http://x/1%' AND refers_to IS NOT NULL")
    assert [r.target_uri for r in found.collect()] == ["http://x/1"]
    reader = warc.WarcReader(path, None, True)
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_length",), 3), StringStartsWith(("target_uri",), "h"), EqualTo(("payload",), b"")]))
    assert [type(x).__name__ for x in left] == ["GreaterThan", "EqualTo"] and len(reader.tests) == 2


def test_unwanted_payloads_are_not_decoded(spark, tmp_path, monkeypatch):
    path = tmp_path / "archive"
    path.mkdir()
    good = warc.record({"record_type": "response", "record_id": "<a>", "payload": b"text"})
    broken = warc.record({"record_type": "resource", "record_id": "<b>", "payload": b"text" * 50}).replace(b"\x1f\x8b", b"\x00\x00")
    (path / "x.warc").write_bytes(broken + good)
    rows = warc.read(spark, str(path)).where("record_type = 'response'").collect()
    assert [bytes(r.payload) for r in rows] == [b"text"]
    assert warc.read(spark, str(path), payload=False).count() == 2


def test_blocks_of_unwanted_records_are_not_asked_for(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo
    from pyspark.sql.types import StructType

    kinds = ["response", "resource", "response", "metadata"]
    made = [warc.record({"record_type": k, "record_id": f"<{i}>", "payload": b"text%d" % i}, i % 2 == 0) for i, k in enumerate(kinds)]
    (tmp_path / "x.warc").write_bytes(b"".join(made))
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    read, real = [], warc.payload_of
    monkeypatch.setattr(warc, "payload_of", lambda block, kind: read.append(block) or real(block, kind))
    reader = warc.WarcReader(str(tmp_path), StructType.fromDDL("record_id string, payload binary"), True)
    list(reader.pushFilters([EqualTo(("record_type",), "response")]))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["record_id"], r["payload"]) for r in rows] == [("<0>", b"text0"), ("<2>", b"text2")] * 2 and len(read) == 4


def test_folders_and_gzip(spark, tmp_path):
    make = lambda i: warc.record({"record_type": "response", "record_id": f"<{i}>", "payload": b"p%d" % i * 3000}, False)
    (tmp_path / "deep/er").mkdir(parents=True)
    (tmp_path / "_work").mkdir()
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(make(1)) + gzip.compress(make(2)))
    (tmp_path / "deep/er/b.warc").write_bytes(make(3))
    (tmp_path / "deep/c.warc.gz").write_bytes(gzip.compress(make(4) + make(5)))
    (tmp_path / "_work/d.warc").write_bytes(make(6)[:50])
    (tmp_path / ".e.crc").write_bytes(b"x")
    (tmp_path / "deep/f.warc").write_bytes(b"")
    got = {(r.record_id, bytes(r.payload)) for r in warc.read(spark, str(tmp_path)).collect()}
    assert got == {(f"<{i}>", b"p%d" % i * 3000) for i in range(1, 6)}
    assert [r.record_id for r in warc.read(spark, str(tmp_path / "a.warc.gz")).where("record_id = '<2>'").collect()] == ["<2>"]
    assert warc.read(spark, str(tmp_path / "deep/er/b.warc"), payload=False).count() == 1
    (tmp_path / "deep/notes.txt").write_text("x")
    with pytest.raises(Exception, match="no WARC file"):
        warc.read(spark, str(tmp_path)).count()
    assert spark.read.format("warc").option("other", "skip").load(str(tmp_path)).count() == 5
    with pytest.raises(Exception, match="nowhere"):
        warc.read(spark, str(tmp_path / "nowhere")).count()
    (tmp_path / "g").mkdir()
    for broken, words in ((gzip.compress(make(1))[:-40], "ended|cut off"), (gzip.compress(make(1)[:-3000]), "cut off"), (gzip.compress(b"WARC/1.0\r\nA: b\r\n\r\n"), "without a length")):
        (tmp_path / "g/x.warc.gz").write_bytes(broken)
        with pytest.raises(Exception, match=words):
            warc.read(spark, str(tmp_path / "g")).collect()
    (tmp_path / "g/x.warc.gz").unlink()
    (tmp_path / "g/x.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\n\r\n")
    with pytest.raises(Exception, match="without a length"):
        warc.read(spark, str(tmp_path / "g")).collect()


def test_gzip_archives_come_back(spark, tmp_path):
    path = str(tmp_path / "z")
    warc.register(spark)
    warc.captures(pages(spark, ROWS)).write.format("warc").mode("append").option("gzip", "true").save(path)
    files = list((tmp_path / "z").iterdir())
    assert files and all(f.name.endswith(".warc.gz") for f in files)
    rows = {(r.record_id, r.record_type): r for r in warc.read(spark, path).collect()}
    assert len(rows) == len(set(ROWS)) and bytes(rows["<urn:page:7>", "response"].payload).decode() == ROWS[7][1]


@pytest.mark.parametrize("fields,body,payload", [
    ("Transfer-Encoding: chunked", b"4\r\nwiki\r\n6;x=y\r\npedia.\r\n0\r\n\r\n", b"wikipedia."),
    ("Transfer-Encoding: chunked", b"not in chunks", b"not in chunks"), ("Transfer-Encoding: chunked", b"F\r\nshort", b"F\r\nshort"),
    ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", b"%x\r\n%b\r\n0\r\n\r\n" % (len(gzip.compress(b"hi", mtime=0)), gzip.compress(b"hi", mtime=0)), b"hi"),
    ("Content-Encoding: gzip", b"plain", b"plain"), ("Content-Encoding: deflate", zlib.compress(b"hi"), b"hi"), ("Content-Encoding: deflate", zlib.compress(b"hi")[2:-4], b"hi"),
    ("Content-Encoding: br", b"raw", b"raw"),
])
def test_codings(fields, body, payload):
    assert warc.payload_of(f"HTTP/1.1 200 OK\r\n{fields}\r\n\r\n".encode() + body, "application/http") == payload


def test_foreign_records(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nplain body"
    head = f"WARC/1.0\r\nwarc-type: response\r\nWARC-Target-URI: http://a\r\n b\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 5\r\n\r\nx: y\n\r\n\r\n"
    long = b"WARC/1.0\r\nWARC-Type: metadata\r\nX: " + b"v" * 200_000 + b"\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.warc").write_bytes(info + head + block + b"\r\n\r\n" + long)
    rows = warc.read(spark, str(tmp_path / "f")).collect()
    assert [(r.record_type, bytes(r.payload)) for r in rows] == [("warcinfo", b"x: y\n"), ("response", b"plain body"), ("metadata", b"")]
    assert rows[1].target_uri == "http://a b"
    (tmp_path / "f/a.warc").write_bytes((head + block)[:-3])
    with pytest.raises(Exception, match="cut off"):
        warc.read(spark, str(tmp_path / "f")).collect()


def test_header_values_stay_on_their_line():
    made = warc.record({"record_type": "response", "target_uri": "http://a\r\nWARC-Type: x", "payload": b""})
    assert b"WARC-Target-URI: http://a%0D%0AWARC-Type: x\r\n" in made
    body = made.split(b"\r\n\r\n", 2)[2]
    assert zlib.decompress(body[:-4], 47) == b""


def test_column_helper(spark):
    assert spark.createDataFrame([("<urn:page:5>",), ("<urn:page:>",), (None,)], "u string").select(warc.page_of("u").alias("p")).agg(F.sum("p")).first()[0] == 5
