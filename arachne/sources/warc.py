"""Records of web archives: parsing, and a Spark data source that reads whole files.

    spark.dataSource.register(WarcDataSource)
    spark.read.format("warc").load("data/*.warc.gz")

Options: content=false leaves payloads out, headers=false the map of headers. Each file is one partition, as it need not be compressed by record. With
pushdown=true, which needs spark.sql.python.filterPushdown.enabled, equality on rec_type or mimetype is tested before rows
are made. Paths are files, folders or patterns on local disks and on s3, gs, abfs and hdfs; `binary_records` reads any others.
"""

from __future__ import annotations

import gzip
import io
import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from arachne.sources.files import expand, filesystem

SCHEMA = "path string, rec_no int, rec_type string, url string, mimetype string, date string, length bigint, headers map<string,string>, content binary"
#: Bytes read, and uncompressed, at once.
CHUNK = 1 << 16
#: Rows of a batch that goes to Spark, and the bytes of payloads that end one, so that a task's memory doesn't grow with its records.
BATCH_ROWS, BATCH_PAYLOAD = 10_000, 4_000_000


def parse_headers(block: bytes) -> tuple[str, dict[str, str]]:
    """Version line and headers of the bytes before a record's first empty line; a line without a colon continues the last."""
    first, _, rest = block.decode("utf-8", "replace").partition("\r\n")
    headers: dict[str, str] = {}
    last = None
    for line in rest.split("\r\n"):
        name, colon, value = line.partition(":")
        if line[:1] in " \t" and last:
            headers[last] += " " + line.strip()
        elif colon:
            last = name.strip()
            headers[last] = value.strip()
    return first, headers


def header(headers: dict[str, str], name: str) -> str | None:
    return next((v for k, v in headers.items() if k.lower() == name.lower()), None)


def content_length(headers: dict[str, str]) -> int:
    """0 if absent or not a number."""
    value = header(headers, "Content-Length") or ""
    return int(value) if value.isascii() and value.isdigit() and len(value) < 16 else 0


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, content) of each record of an uncompressed stream. Text before a record's version line is passed over; a
    record that the stream cuts short ends with it."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        block = [line]
        while (line := stream.readline()) not in (b"", b"\r\n", b"\n"):
            block.append(line.rstrip(b"\r\n") + b"\r\n")
        _, headers = parse_headers(b"".join(block).rstrip(b"\r\n"))
        yield headers, stream.read(content_length(headers))


class _Members(io.RawIOBase):
    """The uncompressed bytes of gzip members one after another, many small ones a call, where GzipFile gives one with a dozen calls of its own.
    Zeros between members are passed over. What is no member, or is cut short, is an error after all bytes before it."""

    def __init__(self, raw):
        self.raw, self.waiting, self.member, self.error = raw, b"", None, None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        at = 0
        while at < len(into) and not self.error:
            if not self.waiting:
                self.waiting = self.raw.read(CHUNK)
                if not self.waiting:
                    if self.member:
                        self.error = EOFError("a gzip member ends early")
                    break
            if not self.member:
                self.waiting = self.waiting.lstrip(b"\0")
                if not self.waiting:
                    continue
                self.member = zlib.decompressobj(31)
            try:
                data = self.member.decompress(self.waiting, len(into) - at)
            except zlib.error as e:
                self.error = gzip.BadGzipFile(str(e))
                break
            into[at : at + len(data)] = data
            at += len(data)
            if self.member.eof:
                self.waiting, self.member = self.member.unused_data, None
            else:
                self.waiting = self.member.unconsumed_tail
        if self.error and not at:
            raise self.error
        return at

    def close(self) -> None:
        if not self.closed:
            self.raw.close()
        super().close()


def open_stream(raw):
    """A buffered stream of the uncompressed bytes; gzip, of many members too, is known by its first bytes."""
    raw = io.BufferedReader(raw, CHUNK)
    return io.BufferedReader(_Members(raw), CHUNK) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


class _Arrow(io.RawIOBase):
    """A file of Arrow's as Python's streams want it."""

    def __init__(self, handle):
        self.handle = handle

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        data = self.handle.read(len(into))
        into[: len(data)] = data
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.handle.close()
        super().close()


def open_archive(uri: str):
    fs, path = filesystem(uri)
    return open_stream(_Arrow(fs.open_input_stream(path, compression=None)))


def record_row(path: str, n: int, headers: dict[str, str], content: bytes | None) -> tuple:
    named: dict[str, str] = {}
    for k, v in headers.items():
        named.setdefault(k.lower(), v)
    return path, n, *map(named.get, ("warc-type", "warc-target-uri", "content-type", "warc-date")), content_length(headers), headers, content


_KINDS = [pa.string(), pa.int32(), *[pa.string()] * 4, pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
_NAMES = ["path", "rec_no", "rec_type", "url", "mimetype", "date", "length", "headers", "content"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    *columns, headers, content = zip(*rows, strict=True)
    if headers[0] is None:
        maps = pa.nulls(len(rows), _KINDS[-2])
    else:
        ends = pa.array([0, *itertools.accumulate(map(len, headers))], pa.int32())
        maps = pa.MapArray.from_arrays(ends, *(pa.array(list(itertools.chain.from_iterable(x)), pa.string()) for x in (headers, (h.values() for h in headers))))
    arrays = [*(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=False)), maps, pa.array(content, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, _NAMES)


def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of BATCH_ROWS rows at most, that end with the row that takes their payloads to BATCH_PAYLOAD bytes. All rows have headers, or none."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1] or b"")
        if size >= BATCH_PAYLOAD or len(held) >= BATCH_ROWS:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _WarcReader(DataSourceReader):
    def __init__(self, paths: list[str], content: bool, headers: bool = True):
        self.paths, self.content, self.headers, self.only = paths, content, headers, {}

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        return batched(self._rows(partition.path))

    def _rows(self, path):
        with open_archive(path) as stream:
            for n, (headers, content) in enumerate(records(stream)):
                row = record_row(path, n, headers, content if self.content else None)
                if self.only.get("rec_type", row[2]) == row[2] and self.only.get("mimetype", row[4]) == row[4]:
                    yield row if self.headers else (*row[:-2], None, row[-1])


class _FilteringReader(_WarcReader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("rec_type",), ("mimetype",)):
                self.only[f.attribute[0]] = f.value
            else:
                yield f


class WarcDataSource(DataSource):
    """Files by comma-separated paths or patterns, in any store that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        paths = [q for p in self.options["path"].split(",") for q in expand(p.strip())]
        kind = _FilteringReader if self.options.get("pushdown", "false").lower() == "true" else _WarcReader
        return kind(paths, *(self.options.get(o, "true").lower() != "false" for o in ("content", "headers")))


def binary_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same rows from any store that Spark reads, by its own reader of whole files: of 2 GB each at most."""

    def read(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                stream = open_stream(io.BytesIO(memoryview(content.as_buffer())))
                yield from batched(record_row(path, n, headers, body) for n, (headers, body) in enumerate(records(stream)))

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(read, SCHEMA)
