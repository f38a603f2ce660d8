"""Words and shingles of a whole Arrow text column as 64-bit hashes, computed with numpy on the column's own buffers.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D. Every hash of a word is a polynomial over random
values of its bytes, read from one prefix sum and then mixed; a shingle's hash is a polynomial over word hashes.

Texts are taken in pieces of PIECE bytes or so. A text of any length needs 24 bytes for each of its words besides its own bytes, and what a
piece needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = U(0xD6E8FEB86659FD93)
PIECE = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser: every bit of the result depends on all bits of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * U(0xA0761D6478BD642F))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of them at least."""
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def text_chunks(column: pa.Array, budget: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `budget` bytes: (first row, offsets from 0, bytes). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + budget, side="right")) - 1)
        last = min(last, n)
        yield first, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


def _break(data: np.ndarray, start: int) -> int:
    """Where a piece that begins at `start` ends: after a space, at PIECE bytes or before, unless there is none."""
    end = start + PIECE
    if end >= len(data):
        return len(data)
    at = np.flatnonzero(SPACE[data[start:end]])
    if len(at):
        return start + int(at[-1]) + 1
    for a in range(end, len(data), PIECE):
        at = np.flatnonzero(SPACE[data[a : a + PIECE]])
        if len(at):
            return a + int(at[0]) + 1
    return len(data)


def _spans(edges: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    space = SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[edges] = True
    begins, ends = edge[:n].copy(), edge[1:].copy()
    begins[1:] |= space[:-1]
    ends[:-1] |= space[1:]
    begins &= ~space
    ends &= ~space
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    if n <= 2 * PIECE:
        starts, ends = _spans(offsets, data)
    else:
        found, a = [], 0
        while a < n:
            b = _break(data, a)
            inner = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, side="right")] - a
            found.append([x + a for x in _spans(np.append(inner, [0, b - a]), data[a:b])])
            a = b
        starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of spans in order, of which none overlap: words, or lines."""
    table = _LOWER if lower else _BYTES
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        first = int(starts[i])
        j = int(np.searchsorted(ends, first + 2 * PIECE, side="right"))
        if j > i:
            part = data[first : ends[j - 1]]
            up, down = powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[part] * up[: len(part)], out=sums[1:])
            a, b = starts[i:j] - first, ends[i:j] - first
            out[i:j] = mix((sums[b] - sums[a]) * down[a])
            i = j
        else:
            out[i] = mix(_long(table, data[first : ends[i]]))[0]
            i += 1
    return out


def _long(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The polynomial of a span of more than a piece, in an array of one."""
    total, scale = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    for a in range(0, len(data), PIECE):
        part = data[a : a + PIECE]
        up, _ = powers(len(part) + 1)
        total += (table[part] * up[: len(part)]).sum(dtype=np.uint64) * scale
        scale = scale * up[len(part)]
    return total


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, over text borders too; the caller leaves those out."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    h = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        h *= _STEP
        h += words[j : len(words) - k + 1 + j]
    return mix(h + U(k))


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each text: its k-word shingles, the whole sequence if it has fewer words."""
    for first, offsets, data in text_chunks(column):
        starts, ends, at = word_spans(offsets, data)
        words = word_hashes(data, starts, ends)
        windows = window_hashes(words, k)
        for i in range(len(offsets) - 1):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= k:
                yield first + i, np.unique(windows[a : b - k + 1])
            elif b > a:
                yield first + i, window_hashes(words[a:b], b - a)
            else:
                yield first + i, np.zeros(0, np.uint64)


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed 64-bit numbers; equal sets have equal keys."""
    m = mix(tokens + U(0x632BE59BD9B4E019))
    a = int(m.sum(dtype=np.uint64))
    b = int(np.bitwise_xor.reduce(mix(m * _STEP))) if len(m) else 0
    return tuple(v - (1 << 64) if v >= 1 << 63 else v for v in (a, b))


def runs(batches, key_names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches that are sorted by these keys, whichever way the batches cut them."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = [table.column(c).to_numpy(zero_copy_only=False) for c in key_names]
        change = np.zeros(table.num_rows, dtype=bool)
        for c in keys:
            change[1:] |= c[1:] != c[:-1]
        borders = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            key = tuple(c[a] for c in keys)
            if held and key != held_key:
                yield pa.concat_tables(held)
                held = []
            held_key = key
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)
