"""WARC archives as a Spark data source.

Writing: every task writes files of its own below a folder for unfinished work, and only the files of tasks that
Spark has accepted are moved into the archive folder, several at once, so that repeated and lost attempts leave nothing behind.
A payload is stored as the gzip-coded body of an HTTP response, records follow each other uncompressed; with the option
``gzip`` each record is a gzip member of a ``.warc.gz`` file instead.

Reading: a file, or all files below a folder at any depth (names that begin with a dot or an underscore aside) whose names end in ``.warc`` or
``.warc.gz``. Other names are an error, or passed over with the option ``other`` set to skip. Files are packed into partitions by size. The headers of
a record are parsed first; predicates on the record's type and on other header columns are pushed down (this needs
``spark.sql.python.filterPushdown.enabled``, which ``register`` sets for the session) and decided on them. The block of an unwanted record is skipped by
its length, in a gzip file by reading over it; with the option ``payload`` set to false no block is read. Folders may lie in any file system that
pyarrow opens by its URI.

Defined results: a null payload is written as an empty one (for a revisit: none); line ends in header values are
percent-encoded; header lines may be continued; header names are matched without regard to case; chunks of an HTTP body are joined and its
gzip or deflate coding is undone, while a body that isn't coded as its header says stays as it is; a record
cut off at the end of a file, one without a length and a missing path are errors; an empty folder, empty files and an empty table give no rows.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull,
                                    IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage)
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow.llm.common import bitmap, cut, split, spread_join

FORMAT = "warc"
SCHEMA = ("record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
          "payload_length long, content_type string, payload binary")
#: Columns that come from a header of the record.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
           "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "WARC-Payload-Length",
           "content_type": "Content-Type"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: A file is closed after so many bytes; partitions are packed up to as many; rows go to Spark in batches of so many.
FILE_BYTES, SPLIT_BYTES, BATCH_BYTES, BATCH_ROWS = 128 << 20, 64 << 20, 4 << 20, 2000
#: Files that are moved at once; bytes of a block that are passed over at once.
MOVES, STEP = 16, 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


@dataclass
class Files(InputPartition):
    files: list

    def __init__(self, files):
        super().__init__(files)
        self.files = files


def safe(value) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict, packed: bool = True) -> bytes:
    """A record; ``packed``: with a gzip-coded body."""
    head = {HEADERS[k]: row.get(k) for k in HEADERS if k != "content_type"}
    head["WARC-Date"] = head["WARC-Date"] or DATE
    http, body = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n", b""
    if row["record_type"] == "revisit":
        head["WARC-Profile"] = REVISIT_PROFILE
    else:
        body = row.get("payload") or b""
        if packed:
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            body = packer.compress(body) + packer.flush()
            http += "Content-Encoding: gzip\r\n"
        http += f"Content-Length: {len(body)}\r\n"
    block = (http + "\r\n").encode() + body
    lines = "".join(f"{k}: {safe(v)}\r\n" for k, v in head.items() if v is not None)
    start = f"WARC/1.1\r\n{lines}Content-Type: {safe(row.get('content_type') or 'application/http; msgtype=response')}\r\nContent-Length: {len(block)}\r\n\r\n"
    return start.encode() + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, gzip: bool = False):
        self.path, self.work, self.gzip = path, f"{path.rstrip('/')}/_unfinished-{uuid.uuid4().hex}", gzip

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, work = opened(self.work)
        system.create_dir(work, recursive=True)
        done, out, size = Written([]), None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                if out is None:
                    done.files.append(name := f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                    out, size = system.open_output_stream(f"{work}/{name}", compression=None), 0
                made = record({n: batch.column(n)[i].as_py() for n in batch.schema.names}, not self.gzip)
                out.write(made := gzip.compress(made, 6, mtime=0) if self.gzip else made)
                size += len(made)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return done

    def commit(self, messages):
        system, path = opened(self.path)
        _, work = opened(self.work)
        system.create_dir(path, recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda name: system.move(f"{work}/{name}", f"{path.rstrip('/')}/{name}"), (f for m in messages if m for f in m.files)))
        self.abort(messages)

    def abort(self, messages):
        system, work = opened(self.work)
        if system.get_file_info(work).type != fs.FileType.NotFound:
            system.delete_dir(work)


def header_lines(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    name = None
    for line in data.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def joined_chunks(body: bytes) -> bytes:
    """The chunks of an HTTP body; the body as it is if it isn't in chunks."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return body
        length = int(size, 16)
        if not length:
            return b"".join(out)
        if end + 2 + length > len(body):
            return body
        out.append(body[end + 2 : end + 2 + length])
        at = end + 2 + length + 2


def payload_of(block: bytes, kind: str) -> bytes:
    """The entity body of an HTTP message, without its transfer and content coding; other blocks as they are."""
    if not kind.lower().startswith("application/http"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    fields = header_lines(head.partition(b"\r\n")[2])
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = joined_chunks(body)
    coding = fields.get("content-encoding", "").lower()
    for bits in (47, -15) if coding in ("gzip", "x-gzip", "deflate") else ():
        try:
            return zlib.decompress(body, bits)
        except zlib.error:
            continue
    return body


def holds(test, value) -> bool:
    """Whether a pushed predicate is true of a header's value."""
    match test:
        case IsNull():
            return value is None
        case IsNotNull():
            return value is not None
        case EqualNullSafe():
            return value == test.value
    if value is None:
        return False
    match test:
        case EqualTo():
            return value == test.value
        case In():
            return value in test.value
        case StringStartsWith():
            return value.startswith(test.value)
        case StringEndsWith():
            return value.endswith(test.value)
        case StringContains():
            return test.value in value
    raise TypeError(test)


def length_of(head: dict, where: str) -> int:
    length = head.get("content-length", "")
    if not length.isdigit():
        raise ValueError(f"a record without a length at {where}")
    return int(length)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema, payload: bool, skip: bool = False):
        self.path, self.fields, self.payload, self.skip = path, schema, payload, skip
        self.tests: list = []

    def pushFilters(self, filters):
        for f in filters:
            known = isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains))
            if known and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append(f)
            else:
                yield f

    def partitions(self):
        system, path = opened(self.path)
        there = system.get_file_info(path)
        if there.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if there.is_file:
            files = [there]
        else:
            below = len(path.rstrip("/")) + 1
            files = [x for x in system.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and not re.search(r"(?:^|/)[._]", x.path[below:])]
        wrong = [x.path for x in files if not x.base_name.endswith((".warc", ".warc.gz"))]
        if wrong and not self.skip:
            raise ValueError(f"no WARC file: {wrong[0]}")
        found = [x for x in files if x.path not in set(wrong) and x.size]
        packs: list[list] = []
        room = 0
        for x in sorted(found, key=lambda x: x.path):
            if not packs or x.size > room:
                packs.append([])
                room = SPLIT_BYTES
            packs[-1].append(x.path)
            room -= x.size
        return [Files(p) for p in packs] or [Files([])]

    def read(self, partition):
        system, _ = opened(self.path)
        names = [f.name for f in self.fields]
        target = to_arrow_schema(self.fields)
        rows: list[tuple] = []
        size = 0
        for path in partition.files:
            packed = path.endswith(".gz")
            with system.open_input_stream(path, compression=None) if packed else system.open_input_file(path) as raw:
                for head, block in self.members(raw) if packed else self.records(raw, raw.size()):
                    values = {c: head.get(h.lower()) for c, h in HEADERS.items()}
                    number = values["payload_length"]
                    values["payload_length"] = int(number) if number and number.isdigit() else None
                    if not all(holds(t, values[t.attribute[0]]) for t in self.tests):
                        continue
                    values["payload"] = None
                    if self.payload and values["record_type"] != "revisit" and "payload" in names:
                        values["payload"] = payload_of(block(), values["content_type"] or "")
                        size += len(values["payload"])
                    rows.append(tuple(values[n] for n in names))
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    @staticmethod
    def records(raw, whole: int):
        """Headers of every record, and a function that reads its block; no block is read otherwise, beyond what a header read brought."""
        start, buffer, base = 0, b"", 0
        while start < whole:
            want = 1 << 12
            while True:
                if start < base or start + want > base + len(buffer) and base + len(buffer) < whole:
                    base, buffer = start, raw.read_at(min(max(want, 1 << 16), whole - start), start)
                end = buffer.find(b"\r\n\r\n", start - base)
                if end >= 0:
                    break
                if start + want >= whole:
                    if not buffer[start - base :].strip():
                        return
                    raise ValueError(f"a record's header is cut off at byte {start}")
                want *= 2
            text = buffer[start - base : end]
            line, _, rest = text.partition(b"\r\n")
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at byte {start}")
            head = header_lines(rest)
            at, length = base + end + 4, length_of(head, f"byte {start}")
            if at + length > whole:
                raise ValueError(f"a record's block is cut off at byte {at}")
            yield head, lambda at=at, length=length: raw.read_at(length, at)
            start = at + length + 4

    @staticmethod
    def members(raw) -> Iterator[tuple[dict, Callable[[], bytes]]]:
        """The same for a gzip file, which is read once from front to back."""
        with gzip.GzipFile(fileobj=raw) as file:
            number = 0
            while line := file.readline():
                if not line.strip():
                    continue
                number += 1
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record at place {number}")
                lines = []
                while (line := file.readline()).strip():
                    lines.append(line)
                if not line:
                    raise ValueError(f"the header of record {number} is cut off")
                head = header_lines(b"".join(lines))
                left = length_of(head, f"place {number}")

                def block(size: int) -> bytes:
                    nonlocal left
                    data = file.read(size)
                    if len(data) < size:
                        raise ValueError(f"the block of record {number} is cut off")
                    left -= size
                    return data

                yield head, lambda size=left: block(size)
                while left:
                    block(min(left, STEP))


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], schema, self.options.get("payload", "true").lower() != "false", self.options.get("other", "").lower() == "skip")

    def writer(self, schema, overwrite):
        if overwrite:
            system, path = opened(self.options["path"])
            if system.get_file_info(path).type != fs.FileType.NotFound:
                system.delete_dir_contents(path)
        return WarcWriter(self.options["path"], self.options.get("gzip", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """A record for each page: of equal payloads of ``least`` bytes or more only that of the largest page_id is stored.

    Rows with the largest page_id of their payload are all responses, also if they repeat; null page_ids count as
    the smallest. Only payloads that may have an equal one are shuffled (a bitmap tells), and of very many equal ones none.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_length": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    groups = rows.where(F.col("payload_length") >= least).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    groups = cut(groups.where("n > 1"))
    maybe, single = split(rows, "digest", bitmap(groups, "digest"))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    both = spread_join(maybe, groups, "digest", "n", "left").select(*single.columns, F.when(again, F.col("first")).alias("first")).unionByName(
        single.withColumn("first", F.lit(None).cast(rows.schema["id"].dataType)))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("first").isNotNull()
    return both.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("id").alias("record_id"), "target_uri",
        F.lit(None).cast("string").alias("date"), F.when(revisit, urn("first")).alias("refers_to"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"), "payload_length", F.lit(None).cast("string").alias("content_type"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def write(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format(FORMAT).mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("payload", str(payload).lower()).load(path)


def page_of(column: str):
    """The page id in a record's URN."""
    return F.expr(f"try_cast(regexp_extract({column}, '^<urn:page:(.*)>$', 1) AS BIGINT)")
