"""WARC archives: a writer, and a Python data source that reads them with pushed-down predicates."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith)

from tessera.llm import files
from tessera.llm.storage import new_dir, stage

LEAST_PAYLOAD = 100  # bytes from which equal payloads are stored once
FILE_BYTES = 256 << 20
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FROM = datetime(2000, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
# A gzip member may carry subfields in its header. This one tells the member's length, so that a reader can pass it
# over without inflating it; readers that don't know it ignore it.
_FIELD = b"TL"


def member(data: bytes) -> bytes:
    """data as one gzip member, with its length in the header."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    length = 10 + 2 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + (8).to_bytes(2, "little") + _FIELD + (4).to_bytes(2, "little") + length.to_bytes(4, "little")
    return head + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def _clean(value: str) -> str:
    """A header's value can't hold line breaks or lone surrogates."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_FROM}",
        f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to:
        head[3:3] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each page (page_id, url, html); returns (path, bytes, records) of the files that count: an
    attempt of a task that failed or was outrun may leave others in the folder.

    Of pages with equal payloads of at least LEAST_PAYLOAD bytes, those with the smallest page_id are responses and
    the others revisit it; null page_ids are smallest only among themselves. A null html is an empty payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    first = rows.filter(F.col("size") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    marked = rows.join(first.select("digest", "first"), "digest", "left")
    refers = F.when((F.col("size") >= LEAST_PAYLOAD) & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first").cast("string"))
    marked = marked.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "size", "digest", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, done = None, {"path": [], "bytes": [], "records": []}

        def close() -> None:
            if out is not None:
                done["bytes"].append(out.tell())
                out.close()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or out.tell() > FILE_BYTES:
                    close()
                    path, out = files.create(folder, ".warc.gz")
                    done["path"].append(path)
                    done["records"].append(0)
                out.write(member(record(*row)))
                done["records"][-1] += 1
        close()
        if out is not None:
            yield pa.RecordBatch.from_pydict(done, pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return stage(marked.mapInArrow(write, "path string, bytes long, records long"), "archives")


COLUMNS = {  # column: header, in lower case
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest", "content_type": "content-type", "date": "warc-date"}
_ARROW = pa.schema([*((c, pa.string()) for c in COLUMNS), ("http_length", pa.int64()), ("payload", pa.binary())])


class _Stream:
    """Bytes of a WARC file, plain or gzipped, with as little inflated and read as the caller wants."""

    def __init__(self, source):
        self.source, self.size = source, source.size()
        self.zipped = bytes(source.read_at(min(2, self.size), 0)) == b"\x1f\x8b"
        self.at = 0  # of what hasn't been fetched yet
        self.ready = b""
        self.start_member()

    def start_member(self) -> None:
        self.inflate, self.next_member = (zlib.decompressobj(31), None) if self.zipped else (None, None)
        if self.zipped and self.at < self.size:
            head = bytes(self.source.read_at(min(20, self.size - self.at), self.at))
            if len(head) == 20 and head[3] == 4 and head[12:14] == _FIELD:
                self.next_member = self.at + int.from_bytes(head[16:20], "little")

    def more(self) -> bool:
        while True:
            if self.inflate is not None and self.inflate.eof:
                self.at -= len(self.inflate.unused_data)
                self.start_member()
            if self.at >= self.size:
                return False
            limit = (self.next_member or self.size) - self.at
            data = bytes(self.source.read_at(min(READ_BYTES if self.next_member is None else min(limit, READ_BYTES), self.size - self.at), self.at))
            self.at += len(data)
            got = data if self.inflate is None else self.inflate.decompress(data)
            if got:
                self.ready += got
                return True

    def until(self, mark: bytes, limit: int | None = None) -> bytes | None:
        """What stands before mark, which is passed over; None where the next bytes, at most limit, don't hold it."""
        found = self.ready.find(mark)
        while found < 0 and (limit is None or len(self.ready) < limit):
            seen = max(0, len(self.ready) - len(mark))
            if not self.more():
                return None
            found = self.ready.find(mark, seen)
        if found < 0 or limit is not None and found + len(mark) > limit:
            return None
        out, self.ready = self.ready[:found], self.ready[found + len(mark):]
        return out

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            if not self.ready and not self.more():
                raise EOFError("a record ends early")
            parts.append(self.ready[:left])
            self.ready = self.ready[len(parts[-1]):]
            left -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        """Pass over the block of a record: by seeking where lengths are known, else by inflating and forgetting."""
        if self.next_member is not None:
            self.at, self.ready = self.next_member, b""
            self.start_member()
            return
        held = min(n, len(self.ready))
        self.ready, n = self.ready[held:], n - held
        if self.inflate is None:
            self.at = min(self.size, self.at + n)
            return
        while n:
            if not self.more():
                raise EOFError("a record ends early")
            held = min(n, len(self.ready))
            self.ready, n = self.ready[held:], n - held


def records(source, tests: dict[str, list], with_payload: bool) -> Iterator[tuple[dict[str, str], int | None, bytes | None]]:
    """(headers, HTTP content length, payload) of the records whose headers pass all tests.

    A header is parsed first; the block of a record that fails is passed over.
    """
    stream = _Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        if not head.strip():  # the end of the record before
            continue
        lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers.get("content-length", 0))
        if not all(test(headers.get(COLUMNS[c])) for c, some in tests.items() for test in some):
            stream.skip(length)
            continue
        if "http" not in headers.get("content-type", ""):
            if with_payload:
                yield headers, None, stream.take(length)
            else:
                stream.skip(length)
                yield headers, None, None
            continue
        http = stream.until(b"\r\n\r\n", length)
        if http is None:  # the block has no HTTP header
            yield headers, None, stream.take(length) if with_payload else stream.skip(length)
            continue
        said = [x.partition(":")[2] for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:")]
        rest = length - len(http) - 4
        payload = stream.take(rest) if with_payload else stream.skip(rest)
        yield headers, int(said[0]) if said else None, payload


def _equals(value, x):
    return x == value


def _among(values, x):
    return x in values


def _starts(value, x):
    return x is not None and x.startswith(value)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.manifest, self.with_payload = options.get("path"), options.get("manifest"), options.get("payload", "true").lower() == "true"
        self.split_bytes = int(options.get("splitBytes", 128 << 20))
        self.tests: dict[str, list] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for x in filters:
            column = x.attribute[0] if len(getattr(x, "attribute", ())) == 1 else None
            test = None
            if column in COLUMNS:
                if isinstance(x, EqualTo):
                    test = partial(_equals, x.value)
                elif isinstance(x, In):
                    test = partial(_among, frozenset(x.value))
                elif isinstance(x, StringStartsWith):
                    test = partial(_starts, x.value)
                elif isinstance(x, IsNotNull):
                    test = _present
            if test is None:
                yield x
            else:
                self.tests.setdefault(column, []).append(test)

    def partitions(self) -> list[InputPartition]:
        """Whole files, small ones together up to splitBytes."""
        groups, size = [], 0
        for path, n in files.read_manifest(self.manifest) if self.manifest else files.listed(self.path, (".warc", ".warc.gz")):
            if not groups or size + n > self.split_bytes:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        rows, size = {c: [] for c in _ARROW.names}, 0
        for path in partition.paths:
            with files.open_input(path) as source:
                for headers, length, payload in records(source, self.tests, self.with_payload):
                    for c, h in COLUMNS.items():
                        rows[c].append(headers.get(h))
                    rows["http_length"].append(length)
                    rows["payload"].append(payload)
                    size += 500 + len(payload or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pydict(rows, _ARROW)
                        rows, size = {c: [] for c in _ARROW.names}, 0
        yield pa.RecordBatch.from_pydict(rows, _ARROW)


def _present(x):
    return x is not None


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder): a row for each record of its .warc and .warc.gz files.

    Options: payload (true; false leaves the payload null and its bytes undecoded), splitBytes of a partition,
    manifest (a file that lists the archives to read, in place of a folder).
    Predicates on the columns of headers (=, in, starts with, is not null) are tested on headers alone.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in COLUMNS) + ", http_length long, payload binary"

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archived(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row of pages, from archives written
    in a new shared folder and read back. Payloads are read of responses only; a revisit's size and digest are in its
    headers. Rows come as they went in: repeated ones each, null page_ids as null. Other columns are ignored."""
    return read_back(write_archives(pages, folder := new_dir(pages.sparkSession, "warc")), folder)


def read_back(written: DataFrame, folder: str) -> DataFrame:
    """The records of the files that write_archives tells of, and of no other file in the folder."""
    spark = written.sparkSession
    register(spark)
    manifest = files.write_manifest(folder, written.select("path", "bytes").toLocalIterator())  # a row for each file

    def number(column: str):
        return F.expr(f"try_cast(nullif(regexp_extract({column}, '<urn:page:(-?[0-9]*)>', 1), '') as bigint)")

    source = spark.read.format("warc").option("splitBytes", str(32 << 20)).option("manifest", manifest)
    full = source.option("payload", "true").load().filter("record_type = 'response'").select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = source.option("payload", "false").load().filter("record_type = 'revisit'").select(
        number("record_id").alias("page_id"), F.col("http_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"))
    return full.union(again)
