"""Best-fit packing of token sequences into bins of fixed capacity.

Only lengths decide, and there are at most `capacity` of them: all pieces are counted by length, the bins are planned on
that histogram as patterns with a multiplicity, and every piece finds its place from its rank among pieces of its
length. The plan's size does not grow with the data.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arachne.llm.shared import cut, small_batches

#: The pattern by which a byte-level pre-tokenizer splits texts where its file asks for one; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_APART = re.compile(r" (?!\S)")
_SPLIT = re.compile(r" (?=\S)")
_NEWLINE = re.compile(r"(\n)(?=\S)")


def _spec(path: str) -> dict:
    """A vocabulary file that splits texts by PATTERN and nothing else; others are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or spec["model"].get("type") != "BPE":
        raise ValueError(f"{path} is no byte-level BPE vocabulary without normaliser and added spaces")
    return spec


def _ranks(spec: dict) -> dict[bytes, int]:
    """Byte strings and ids of a byte-level BPE vocabulary, whose ids are in the order of its merges."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in spec.get("added_tokens", ())}
    return {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}


def _added(spec: dict) -> dict[str, int]:
    """The file's added tokens and their ids, which the library takes out of a text before anything else."""
    found = spec.get("added_tokens", ())
    odd = [t["content"] for t in found if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if odd:
        raise ValueError(f"added tokens that match by more than their text aren't handled: {odd}")
    return {t["content"]: t["id"] for t in found}


class Encoder(dict):
    """Texts to ids, packed as unsigned little-endian 32-bit numbers.

    Unless `encode_special_tokens` (the library's option of that name) an added token in a text is its own id.

    The pattern never joins a space that stands before other text with what is left of it, so a text is cut there and
    each part's ids are kept: most parts are words that occur again.
    """

    KEEP = 100_000
    LONGEST = 32

    def __init__(self, path: str, encode_special_tokens: bool = False):
        import tiktoken

        super().__init__()
        spec = _spec(path)
        added = {} if encode_special_tokens else _added(spec)
        self.added = {t: np.array([i], dtype="<u4").tobytes() for t, i in added.items()}
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.raw = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=_ranks(spec), special_tokens={}).encode_ordinary

    def ids(self, part: str) -> bytes:
        return np.array(self.raw(part), dtype="<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        """Ids of a space and `part`."""
        if "\n" in part and len(pieces := _NEWLINE.split(part)) > 1 and not any(p and p[-1].isspace() for p in pieces[::2]):
            return self[pieces[0]] + b"".join(self.first(p) for p in pieces[1:]) if pieces[0] else self.ids(f" {part}")
        found = self.ids(f" {part}")
        if len(part) <= self.LONGEST:
            if len(self) >= self.KEEP:
                self.clear()
            self[part] = found
        return found

    def first(self, part: str) -> bytes:
        key = f"\0{part}"
        if key in self:
            return self[key]
        found = self.ids(part)
        if len(part) <= self.LONGEST:
            if len(self) >= self.KEEP:
                self.clear()
            self[key] = found
        return found

    def encode(self, text: str) -> bytes:
        if self.apart is None or not self.apart.search(text):
            return self.plain(text)
        return b"".join(self.added[t] if t in self.added else self.plain(t) for t in self.apart.split(text))

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        parts = (_SPLIT.split if _APART.search(text) else lambda t: t.split(" "))(text)
        head = self.ids(parts[0]) if parts[0] else b""
        return head + b"".join(map(self.__getitem__, parts[1:]))


_kept: dict = {}


def encoder(path: str, encode_special_tokens: bool = False) -> Encoder:
    """The one encoder of this process, which tasks that run in it one after another share."""
    if (path, encode_special_tokens) not in _kept:
        _kept.clear()
        _kept[path, encode_special_tokens] = Encoder(path, encode_special_tokens)
    return _kept[path, encode_special_tokens]


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", encode_special_tokens: bool = False) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, and the task that made it with its rank there by length.

    A text longer than the capacity is cut so that its first piece may be shorter and all others are full.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def pieces(batches):
        known, task, ranks = encoder(path, encode_special_tokens), TaskContext.get().partitionId(), Counter()
        tail = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows, out = [], ([], [], [], [], [])
            for i, text in enumerate(b.column("text")):
                ids = known.encode(text.as_py() or "") + tail
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n % capacity or capacity) if not start else capacity
                    rows.append(i)
                    for c, v in zip(out, (piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), ranks[length]), strict=True):
                        c.append(v)
                    ranks[length] += 1
                    start, piece = start + length, piece + 1
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(c, pa.int64()) for c in out[1:]), pa.array([task] * len(rows), pa.int32())],
                ["id", "piece", "start", "length", "ids_crc32", "rank", "task"],
            )

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(pieces, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, rank bigint, task int")


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many bins have each.

    Lengths above a third of the capacity, of which no bin holds three, are matched first: the longest left takes the
    longest left that fits beside it. Shorter ones, longest first, go to the bin with the smallest gap that takes them.
    """
    left = {n: c for n, c in counts.items() if c}
    open_bins: dict[int, list] = defaultdict(list)
    gaps: list[int] = []
    done = []

    def put(items: list[int], count: int) -> None:
        gap = capacity - sum(items)
        if gap == 0:
            done.append((items, count))
            return
        if not open_bins[gap]:
            gaps.insert(bisect_left(gaps, gap), gap)
        open_bins[gap].append([items, count])

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        for m in reversed(large):
            if m > n or n + m > capacity or not left[m]:
                continue
            pairs = min(left[n], left[m]) if m != n else left[n] // 2
            if pairs:
                left[n] -= pairs
                left[m] -= pairs
                put([n, m], pairs)
            if not left[n]:
                break
        if left[n]:
            put([n], left[n])
            left[n] = 0
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[n]
        while c and (at := bisect_left(gaps, n)) < len(gaps):
            gap = gaps[at]
            items, count = open_bins[gap].pop()
            if not open_bins[gap]:
                gaps.pop(at)
            used = min(c, count)
            if count > used:
                put(items, count - used)
            put([*items, n], used)
            c -= used
        each = capacity // n
        if c // each:
            put([n] * each, c // each)
        if c % each:
            put([n] * (c % each), 1)
    return done + [tuple(x) for g in gaps for x in open_bins[g]]


def _places(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Sorted by length and first rank: which ranks of a length go to which sequences, at which offset."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for items, count in bins:
        offset = 0
        for n in items:
            rows.append((n, used[n], sequence, offset))
            used[n] += count
            offset += n
        sequence += count
    rows.sort()
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(("length", "first", "sequence", "offset"))}


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", encode_special_tokens: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of docs.

    Null and empty texts have the end id alone. Repeated rows and ids are packed once each. A null id stays null. Other
    columns are ignored. No rows: no sequences. `encode_special_tokens` is the tokenizers library's: true spells added
    tokens in texts out, false (the library's default) gives them their ids. A text of any length is one row in memory.
    """
    pieces = cut(token_pieces(docs, path, capacity, end_id, id_col, text_col, encode_special_tokens))
    tasks = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = tasks.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    places = docs.sparkSession.sparkContext.broadcast(_places(plan_bins(counts, capacity)))
    kind = pieces.schema["id"].dataType.simpleString()

    def placed(batches):
        p = places.value
        lengths, first = p["length"], p["first"]
        begins = np.searchsorted(lengths, np.arange(capacity + 2))
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.zeros(len(n), np.int64)
            for v in np.unique(n):
                mine = n == v
                a, z = begins[v], begins[v + 1]
                at[mine] = a + np.searchsorted(first[a:z], rank[mine], side="right") - 1
            columns = [*(b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(p["sequence"][at] + rank - first[at]), pa.array(p["offset"][at])]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before")), ["length", "task"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    out = ranked.mapInArrow(placed, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)
