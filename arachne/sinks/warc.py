"""Web archives from rows, a gzip member for each record."""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arachne.shared import cut, small_batches
from arachne.sources.files import filesystem


def gzip_record(headers: list[tuple[str, str | None]], content: bytes) -> bytes:
    """A record as a gzip member of its own. Headers without a value are left out; control characters and spaces in a value's URL must be
    escaped before."""
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(content)}"]
    record = "\r\n".join(lines).encode() + b"\r\n\r\n" + content + b"\r\n\r\n"
    bits = min(15, max(9, len(record).bit_length()))  # a window that holds the record: to set up one of 32 KB takes longer than a small record
    c = zlib.compressobj(6, zlib.DEFLATED, 16 + bits, bits - 7)
    return c.compress(record) + c.flush()


def escaped_url(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def write_warc(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", suffix: str = ".warc.gz", most: int = 32 << 20) -> DataFrame:
    """(path, size) of the archives of each task that has rows: (rec_type, url, mimetype, content). One ends with the record that takes it to `most` bytes,
    as a reader takes an archive as a whole. Only what a successful attempt wrote
    is listed. A null content is empty; a null mimetype leaves its header out."""
    small_batches(rows.sparkSession)

    def written(batches):
        out, sink, path = 0, None, None
        fs, root = filesystem(folder)
        for b in batches:
            for kind, url, mimetype, content in zip(*(b.column(c).to_pylist() for c in ("rec_type", "url", "mimetype", "content")), strict=True):
                if sink is None:
                    fs.create_dir(root, recursive=True)
                    path = f"{root}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{suffix}"
                    sink = fs.open_output_stream(path, compression=None)
                member = gzip_record([("WARC-Type", kind or "resource"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Target-URI", escaped_url(url)), ("Content-Type", mimetype)], content or b"")
                sink.write(member)
                out += len(member)
                if out >= most:
                    sink.close()
                    yield named(path, out)
                    out, sink = 0, None
        if sink is not None:
            sink.close()
            yield named(path, out)

    def named(path, size):
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], ["path", "size"])

    listed = cut(rows.select("rec_type", "url", "mimetype", F.col("content").cast("binary").alias("content")).mapInArrow(written, "path string, size bigint"))
    scheme, colon, _ = folder.partition("://")
    return listed.select(F.concat(F.lit(f"{scheme}://" if colon and scheme not in ("file", "dbfs") else ""), "path").alias("path"), "size")
