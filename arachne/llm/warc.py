"""WARC archives: a writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. A reading task scans its byte range for the gzip magic and takes a place for a
member if what follows decompresses to a record's version line and headers, with a type and a length; it owns the members that start in
its range and reads on beyond it to finish the last. So one archive can be read by many tasks without an index. A task holds one record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arachne.llm.shared import cut, shared_dir, small_batches
from arachne.sources.files import filesystem
from arachne.sources.warc import content_length, header, parse_headers, records

MAGIC = b"\x1f\x8b\x08"
_PAGE = "urn:page:"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record(kind: str, name: str, url: str | None, digest: str, payload: bytes | None, size: int, refers: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_PAGE}{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <{_PAGE}{refers}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def plan_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, payload, size, digest, refers): refers is the least id with the same payload where that is another row's.

    Payloads below min_bytes refer to nothing. Null html counts as empty. Rows with the least id of their payload, repeated ones
    too, refer to nothing. A null id refers to the least id of its payload if there is one.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("bigint"), "digest": F.sha1("payload")})
    firsts = rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1 and least is not null").select("digest", "least")
    other = F.col("least").isNotNull() & ~F.col("least").eqNullSafe(F.col("id"))
    return rows.join(firsts, "digest", "left").withColumn("refers", F.when(other, F.col("least"))).drop("least")


def write_archives(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(path, size) of the archives: one of each task with rows. Only what a task that succeeded wrote is listed; another
    attempt writes another file."""

    def written(batches):
        out, sink, path = 0, None, None
        fs, root = filesystem(folder)
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    path = f"{root}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    sink = fs.open_output_stream(path, compression=None)
                refers = r["refers"]
                member = _record("response" if refers is None else "revisit", "" if r["id"] is None else str(r["id"]), r["url"], base32(r["digest"]), r["payload"] if refers is None else None, r["size"], None if refers is None else str(refers), date)
                sink.write(member)
                out += len(member)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([out], pa.int64())], ["path", "size"])

    listed = cut(rows.select("id", "url", "payload", "size", "digest", "refers").mapInArrow(written, "path string, size bigint"))
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    return listed.select(F.concat(F.lit("" if scheme == "file://" else scheme), "path").alias("path"), "size")


class _Source:
    """Bytes of a file from a place on, read as they are needed and dropped as they are passed."""

    def __init__(self, handle, start: int, step: int = 1 << 18):
        self.handle, self.base, self.data, self.step = handle, start, bytearray(), step
        handle.seek(start)

    def upto(self, end: int) -> bool:
        """Whether bytes up to place `end` are there."""
        while self.base + len(self.data) < end:
            more = self.handle.read(max(self.step, end - self.base - len(self.data)))
            if not more:
                return False
            self.data += more
        return True

    def piece(self, place: int, most: int) -> bytes:
        """`most` bytes at most from a place on, none at the end."""
        self.upto(place + 1)
        return bytes(self.data[place - self.base : place - self.base + most])

    def drop(self, place: int) -> None:
        del self.data[: place - self.base]
        self.base = place

    def back(self, place: int) -> None:
        """Read on from a place that may have been dropped."""
        if place >= self.base:
            self.drop(place)
        else:
            self.base, self.data = place, bytearray()
            self.handle.seek(place)


#: Bytes of a record's headers, at most, before and after decompression.
_HEAD = 1 << 16


def _starts_record(source: _Source, place: int) -> bool:
    """Whether the member at a place begins with a whole header block of a record."""
    d, head, at = zlib.decompressobj(31), b"", place
    try:
        while b"\r\n\r\n" not in head and len(head) < _HEAD and at < place + _HEAD and not d.eof:
            piece = d.unconsumed_tail or source.piece(at, 1 << 10)
            if not piece:
                break
            at += 0 if d.unconsumed_tail else len(piece)
            head += d.decompress(piece, 1 << 12)
            if not b"WARC/".startswith(head[:5]):
                return False
    except zlib.error:
        return False
    block, ended, _ = head.partition(b"\r\n\r\n")
    version, headers = parse_headers(block)
    return bool(ended) and version.startswith("WARC/") and header(headers, "WARC-Type") is not None and (header(headers, "Content-Length") or "").strip().isdigit()


def _member(source: _Source, place: int) -> tuple[bytes, int] | None:
    """The decompressed member at a place and the place after it; None if it is damaged or cut short."""
    d, out, at = zlib.decompressobj(31), [], place
    try:
        while not d.eof:
            piece = source.piece(at, source.step)
            if not piece:
                return None
            out.append(d.decompress(piece))
            at += len(piece)
            source.drop(at)
        return b"".join(out), at - len(d.unused_data)
    except zlib.error:
        return None


def split_records(handle, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, headers, content) of the records whose member starts in [start, end). A damaged member is passed over."""
    source, at = _Source(handle, start), start
    while at < end:
        source.upto(min(end, at + source.step) + len(MAGIC) - 1)
        found = source.data.find(MAGIC, at - source.base, end - source.base + len(MAGIC) - 1)
        if found < 0:
            at = max(at + 1, source.base + len(source.data) - len(MAGIC) + 1)
            if not source.upto(at + len(MAGIC)):
                return
            source.drop(at)
            continue
        place = source.base + found
        source.drop(place)
        whole = _member(source, place) if _starts_record(source, place) else None
        if whole is None:
            at = place + 1
            source.back(at)
            continue
        for headers, content in records(io.BytesIO(whole[0])):
            yield place, headers, content
        at = whole[1]
        if at < end:
            source.back(at)


def read_archives(files: DataFrame, split: int = 128 << 20, task_bytes: int = 512 << 20) -> DataFrame:
    """(path, offset, rec_type, record_id, url, date, refers_to, payload_digest, http_length, payload) of all records in
    files of (path, size), which all executors reach. payload: the content after the HTTP headers; without these, all.

    A range has `split` bytes. There are enough tasks to keep all cores busy, and beyond that one for each `task_bytes`.
    """
    spark = files.sparkSession
    small_batches(spark)
    ranges = files.filter("size > 0").select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split).cast("bigint"))).alias("start"))
    many, volume = ranges.count(), files.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, min(many, max(4 * spark.sparkContext.defaultParallelism, -(-volume // task_bytes))))

    def read(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                fs, name = filesystem(path)
                rows, held = [], 0
                with fs.open_input_file(name) as handle:
                    for place, headers, content in split_records(handle, start, start + split):
                        head, found, body = content.partition(b"\r\n\r\n")
                        http = parse_headers(head)[1] if found and head.startswith(b"HTTP/") else None
                        rows.append((path, place, *(header(headers, n) for n in ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "WARC-Refers-To", "WARC-Payload-Digest")), None if http is None else content_length(http), content if http is None else body))
                        held += len(content)
                        if held >= 4_000_000 or len(rows) >= 1000:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.repartition(tasks, "path", "start").mapInArrow(read, "path string, offset bigint, rec_type string, record_id string, url string, date string, refers_to string, payload_digest string, http_length bigint, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["path", "offset", "rec_type", "record_id", "url", "date", "refers_to", "payload_digest", "http_length", "payload"]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def archived_pages(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) for each row, from archives that are written and read
    back. A response's figures come from its payload, a revisit's from its headers. Nulls are as in plan_records; other columns are ignored.
    No rows: none."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    kind = pages.schema[id_col].dataType.simpleString()
    back = read_archives(write_archives(plan_records(pages, min_bytes, id_col, url_col, html_col), folder))

    def figures(batches):
        for b in batches:
            digests, sizes = [], []
            for t, d, n, p in zip(*(b.column(c).to_pylist() for c in ("rec_type", "payload_digest", "http_length", "payload")), strict=True):
                if t == "response":
                    digests.append(base32(hashlib.sha1(p).hexdigest()))
                    sizes.append(len(p))
                    if d != f"sha1:{digests[-1]}":
                        raise ValueError(f"a payload doesn't have its record's digest {d}")
                else:
                    digests.append((d or "").removeprefix("sha1:"))
                    sizes.append(n)
            yield pa.RecordBatch.from_arrays([b.column("record_id"), b.column("rec_type"), b.column("refers_to"), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], ["record_id", "record_type", "refers", "payload_digest", "payload_bytes"])

    rows = back.select("record_id", "rec_type", "refers_to", "payload_digest", "http_length", "payload").mapInArrow(figures, "record_id string, record_type string, refers string, payload_digest string, payload_bytes bigint")
    name = lambda c: F.nullif(F.regexp_extract(c, f"^<{_PAGE}(.*)>$", 1), F.lit("")).cast(kind)
    return rows.select(name("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", name("refers").alias("refers_to"))
