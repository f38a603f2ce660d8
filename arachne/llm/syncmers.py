"""Document fingerprints of closed syncmers.

A k-mer of code points is chosen if the least hash among its inner s-mers is that of its first or its last one. Whether it is
chosen depends on its own characters alone, so a passage keeps its anchors wherever it stands. A text of 2k - s - 1 code points or
more has at least one; where a shorter one has none, its k-mer of least hash is its anchor. The fingerprint is the
list of all anchors with their positions: 5 bytes each, as base64. Two fingerprints are as alike as the share of anchors that match in one
alignment: of the common anchors' offsets the most frequent one counts.
"""

from __future__ import annotations

import base64
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arachne.llm.hashing import U, mix, powers
from arachne.llm.shared import small_batches

K, S = 20, 6
#: Code points of a text that are hashed at once.
STEP = 1 << 18


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values, by doubling."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _kmers(points: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers, and the places of those that are syncmers."""
    n = len(points)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + U(1)) * up[:n], out=sums[1:])
    small = mix((sums[s:] - sums[: n + 1 - s]) * down[: n + 1 - s])
    low = _least(small, k - s + 1)
    chosen = np.flatnonzero((small[: len(low)] == low) | (small[k - s :] == low))
    return mix((sums[k:] - sums[: n + 1 - k]) * down[: n + 1 - k]), chosen


def anchors(text: str, k: int = K, s: int = S) -> np.ndarray:
    """Rows of (hash, position), by position, as 32-bit numbers. A text shorter than k has itself as its only anchor, one
    without a syncmer its k-mer of least hash, an empty one none. A long text is hashed in overlapping pieces."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = len(points)
    if not n:
        return np.zeros((0, 2), np.uint32)
    if n < k:
        return _rows(_kmers(points, n, n)[0], np.zeros(1, np.int64))
    found, least = [], None
    for a in range(0, n - k + 1, STEP):
        h, chosen = _kmers(points[a : a + STEP + k - 1], k, s)
        if len(chosen):
            found.append(_rows(h[chosen], chosen + a))
        elif not found:
            at = int(h.argmin())
            least = min(least or (h[at], a + at), (h[at], a + at))
    return np.concatenate(found) if found else _rows(np.array([least[0]]), np.array([least[1]]))


def _rows(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.stack([hashes >> U(32), places.astype(np.uint64)], axis=1).astype(np.uint32)


def fingerprint(a: np.ndarray) -> str:
    """Base64 of all anchors: the bytes of a distance between neighbours, 1 or 4; the hashes; the distances, the first one from the text's
    beginning. Numbers are little-endian. Nothing for no anchors."""
    if not len(a):
        return ""
    apart = np.diff(a[:, 1].astype(np.int64), prepend=0)
    kind = "<u1" if apart.max() < 256 else "<u4"
    return base64.b64encode(bytes([np.dtype(kind).itemsize]) + a[:, 0].astype("<u4").tobytes() + apart.astype(kind).tobytes()).decode()


def read_fingerprint(text: str) -> np.ndarray:
    data = base64.b64decode(text)
    if not data:
        return np.zeros((0, 2), np.uint32)
    n = (len(data) - 1) // (4 + data[0])
    places = np.cumsum(np.frombuffer(data[1 + 4 * n :], f"<u{data[0]}").astype(np.int64))
    return np.stack([np.frombuffer(data[1 : 1 + 4 * n], "<u4"), places.astype(np.uint32)], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the anchors that match in the best alignment over all anchors of both: 1 for equal fingerprints (two empty
    ones too), 0 for those without a common anchor. Repeated hashes match by their first position."""
    if not len(a) and not len(b):
        return 1.0
    if a.shape == b.shape and (a == b).all():
        return 1.0
    x, i = np.unique(a[:, 0], return_index=True)
    y, j = np.unique(b[:, 0], return_index=True)
    _, p, q = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(p):
        return 0.0
    shift = a[i[p], 1].astype(np.int64) - b[j[q], 1].astype(np.int64)
    _, n = np.unique(shift, return_counts=True)
    return float(min(1.0, 2 * n.max() / (len(x) + len(y))))


def edited(text: str, other: str) -> str:
    """The last third of text's code points replaced by as many of the first of other, or all of them."""
    m = len(text) // 3
    return text[: len(text) - m] + other[:m]


def _place(texts: DataFrame) -> Column:
    """A number that is never less for a greater id: numbers and times as they are, text by its first 6 bytes after what all ids begin with.
    A null is the least, and a number that is none the greatest, as in Spark's order."""
    kind = texts.schema["id"].dataType.typeName()
    if kind == "string" or kind.startswith(("char", "varchar")):
        least, most = texts.agg(F.min("id"), F.max("id")).first()
        same = len(os.path.commonprefix([(least or "").encode(), (most or "").encode()]))
        place = F.expr(f"cast(conv(rpad(hex(substring(cast(id as binary), {same + 1}, 6)), 12, '0'), 16, 10) as double)")
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        place = F.col("id").cast("timestamp").cast("double")
    else:
        place = F.col("id").cast("double")
    return F.when(F.isnan(place), F.lit(float("inf"))).otherwise(F.coalesce(place, F.lit(float("-inf"))))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_bytes: int = 16_000_000, most: int = 1 << 15) -> tuple[DataFrame, int]:
    """Texts dealt by ranges of ids, with the first row of the next lower range as a guest in each.

    (bucket, id, text, guest): a range's rows and then, with guest true, the row that follows its last in descending
    order; the lowest range is followed by the highest row. And the number of ranges: one for each target_bytes of text,
    `most` at most, beyond which ranges grow (a task reads its range as a stream, so that costs no memory). Ids are numbers, times or
    text; of text ids that agree in what _place takes of them, all are in one range.
    """
    from pyspark.ml.feature import Bucketizer

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n, volume = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = max(1, min(most, int((volume or 0) // target_bytes)))
    cuts = []
    if n and buckets > 1:
        placed = texts.withColumn("place", _place(texts))
        cuts = sorted({c for c in placed.filter("place > double('-inf') and place < double('inf')").approxQuantile("place", [i / buckets for i in range(1, buckets)], 0.2 / buckets)})
    if not cuts:
        return texts.select(F.lit(0).alias("bucket"), "id", "text", F.lit(False).alias("guest")), 1
    ranges = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="place", outputCol="range")
    placed = ranges.transform(placed).select(F.col("range").cast("int").alias("bucket"), "id", "text")
    ends = placed.groupBy("bucket").agg(F.max("id").alias("top")).orderBy("bucket").collect()  # a row for each range
    follows = [(ends[i]["bucket"], ends[i + 1]["bucket"] if i + 1 < len(ends) else ends[0]["bucket"], ends[i]["top"]) for i in range(len(ends))]
    firsts = docs.sparkSession.createDataFrame(follows, "bucket int, host int, top " + docs.schema[id_col].dataType.simpleString())
    guests = placed.join(F.broadcast(firsts), "bucket").filter(F.col("id").eqNullSafe(F.col("top"))).select(F.col("host").alias("bucket"), "id", "text", F.lit(True).alias("guest"))
    return placed.select("bucket", "id", "text", F.lit(False).alias("guest")).unionByName(guests), len(cuts) + 1


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The next document is the one with the next lower id; after the last comes the first. Null texts count as empty. Rows of
    one id follow each other by text, null ids come last. A document alone is its own next. Other columns are ignored. No rows: none. A task
    holds two documents at a time, of any length, and rows that wait to be sent, some 2 MB.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    dealt, many = neighbours(docs, id_col=id_col, text_col=text_col)
    # a guest is one row: of several with the top id, the first in order
    order = [F.col("bucket"), F.col("guest"), F.col("id").desc_nulls_last(), F.col("text")]
    laid = dealt.repartition(many, "bucket").sortWithinPartitions(*order)

    def marked(batches):
        bucket = first = held = None
        out: list[tuple] = []
        volume = 0

        def row(doc, following):
            i, text, a = doc
            _, other, b = following
            changed = edited(text, other)
            e = anchors(changed)
            return i, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(a), fingerprint(e), likeness(a, e), likeness(a, b)

        def batch(ids_type):
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], ids_type), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:5]), *(pa.array(c, pa.float64()) for c in cols[5:])], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        ids_type = None
        for b in batches:
            ids_type = b.schema.field("id").type
            texts = b.column("text")
            for at, (k, i, guest) in enumerate(zip(*(b.column(c).to_pylist() for c in ("bucket", "id", "guest")), strict=True)):
                if k != bucket:
                    if held is not None:
                        out.append(row(held, first))
                    bucket, first, held = k, None, None
                if guest and held is None:
                    continue  # a further row of the guest's id
                text = texts[at].as_py()
                doc = (i, text, anchors(text))
                if held is not None:
                    out.append(row(held, doc))
                    volume += 300 + len(out[-1][3]) + len(out[-1][4])
                held = None if guest else doc
                first = first or doc
                if volume >= 2_000_000:
                    yield batch(ids_type)
                    volume = 0
        if held is not None:
            out.append(row(held, first))
        if out:
            yield batch(ids_type)

    out = laid.select("bucket", "id", "text", "guest").mapInArrow(marked, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)
