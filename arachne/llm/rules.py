"""Quality rules, and an isolation forest on their statistics.

Each document's rule statistics come from one pass over its whole text. The forest's trees split random statistics at
random values, with a margin beyond the range of their rows; documents that few splits isolate are anomalous. All labelled
good rows are dealt to the trees, and all labelled rows of both classes set the threshold on the score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arachne.llm.hashing import SPACE, U, mix, text_chunks, window_hashes, word_hashes, word_spans
from arachne.llm.shared import cut, small_batches

#: The rules' symbols; fixed values.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("word_length", "symbols", "dup_lines", "repeats", "capitals", "digits", "marks", "distinct")
#: Levels of a tree, at most. Nodes there count on by their size, so this bounds the forest and leaves out no row.
DEPTH = 10
#: Steps that a mean path is rounded to, for each level of it; a score has one value for each step.
STEPS = 4096

_SYMBOL = np.zeros(256, np.int8)
_SYMBOL[list(SYMBOLS)] = 1
_POINT = ((np.arange(256) & 0xC0) != 0x80) & ~SPACE
_CAPITAL, _DIGIT, _MARK = (np.isin(np.arange(256), list(s)) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?.,;:"))


def _of_texts(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings equal values of one text together, where runs of them begin, and how long they are."""
    keys = mix(values ^ mix(text.astype(np.uint64) + U(1)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(keys)))


def _distinct(values: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    order, first, _ = _of_texts(values, text)
    return np.bincount(text[order[first]], minlength=texts)


def _lines(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of all lines, in order."""
    breaks = np.flatnonzero(data == 10)
    of = np.searchsorted(offsets, breaks, side="right") - 1
    text = np.concatenate([np.arange(len(offsets) - 1), of])
    starts, ends = np.concatenate([offsets[:-1], breaks + 1]), np.concatenate([offsets[1:], breaks])
    order = np.lexsort((starts, text))
    return starts[order], ends[np.lexsort((ends, text))], text[order]


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (whole numbers) and RATES of each text, by row. Null counts as empty, and empty texts have all 0."""
    counts, rates = np.zeros((len(column), len(COUNTS)), np.int64), np.zeros((len(column), len(RATES)))
    for first, offsets, data in text_chunks(column):
        starts, ends, at = word_spans(offsets, data)
        words = word_hashes(data, starts, ends, lower=False)
        texts, n = len(offsets) - 1, np.diff(at)
        text = np.repeat(np.arange(texts), n)
        some = offsets[1:] > offsets[:-1]
        summed = {}
        for name, of in (("points", _POINT), ("symbols", _SYMBOL), ("capitals", _CAPITAL), ("digits", _DIGIT), ("marks", _MARK)):
            summed[name] = np.zeros(texts, np.int64)
            if some.any():
                summed[name][some] = np.add.reduceat(of[data], offsets[:-1][some], dtype=np.int64)
        a, b, line = _lines(offsets, data)
        full = np.searchsorted(starts, a) < np.searchsorted(starts, b)
        a, b, line = a[full], b[full], line[full]
        lines = np.bincount(line, minlength=texts)
        dup = lines - _distinct(word_hashes(data, a, b, lower=False), line, texts)
        inside = np.flatnonzero(text[2:] == text[:-2])
        order, runs, lengths = _of_texts(window_hashes(words, 3)[inside], text[inside])
        covered = np.zeros(len(words), dtype=bool)
        for k in range(3):
            covered[inside[order[np.repeat(lengths > 1, lengths)]] + k] = True
        repeated = np.bincount(text[covered], minlength=texts)
        rows = slice(first, first + texts)
        counts[rows] = np.stack([n, summed["points"], summed["symbols"], dup, repeated], axis=1)
        chars, m = np.maximum(1, summed["points"]), np.maximum(1, n)
        distinct = _distinct(words, text, texts) / m * np.minimum(1.0, np.log1p(n) / 8)
        found = np.stack([np.minimum(chars / m, 30), summed["symbols"] / m, dup / np.maximum(1, lines), repeated / m, summed["capitals"] / chars, summed["digits"] / chars, summed["marks"] / chars, distinct], axis=1)
        rates[rows] = np.where((n > 0)[:, None], found, 0.0)
    return counts, rates


def fails(counts: np.ndarray, min_words: int, max_repeat_percent: int) -> np.ndarray:
    """The base rules: too few words, or too many in repeated 3-word windows."""
    return (counts[:, 0] < min_words) | (100 * counts[:, 4] > max_repeat_percent * counts[:, 0])


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n, by the forest's definition."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees in flat arrays: a node's feature (-1: leaf), split, first child (the other follows it) and path value. Node t is the root of tree t.

    Every row is in `copies` trees, one at least: a tree has some `rows` rows while there are few, and its share of all when there are many.
    Trees grow by levels, from sizes and ranges of the rows in each open node; those add up over any parts of the rows.
    """

    def __init__(self, x: np.ndarray | None = None, n: int = 0, trees: int = 100, rows: int = 256, margin: float = 1.0, seed: int = 1):
        """Grown on all rows of x; without x not grown yet, for n rows."""
        n = n if x is None else len(x)
        self.count = trees if n else 0
        self.copies = min(trees, -(-rows * trees // max(n, 1)))
        share = max(2.0, n * self.copies / trees)
        self.norm = float(_mean_path(share))
        self.depth = min(DEPTH, int(np.ceil(np.log2(share))))
        self.margin, self.seed, self.level, self.open = margin, seed, 0, 0
        self.feature, self.split = np.full(self.count, -1), np.zeros(self.count)
        self.child, self.value = np.zeros(self.count, np.int64), np.zeros(self.count)
        if x is not None:
            names = mix(np.arange(n, dtype=np.uint64))
            while self.grows:
                self.grow(*self.ranges(names, x))

    @property
    def grows(self) -> bool:
        return self.open < len(self.feature)

    def _leaves(self, x: np.ndarray, rows: np.ndarray, node: np.ndarray) -> np.ndarray:
        while (inner := self.feature[node] >= 0).any():
            right = x[rows, np.maximum(self.feature[node], 0)] >= self.split[node]
            node = np.where(inner, self.child[node] + right, node)
        return node

    def ranges(self, names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Open nodes that the rows reach, and how many do, with the least and greatest of their values. Names (hashes) choose a row's trees."""
        strides = np.array([b for b in range(1, self.count + 1) if math.gcd(b, self.count) == 1])
        first, stride = (names % U(self.count)).astype(np.int64), strides[((names >> U(32)) % U(len(strides))).astype(np.int64)]
        tree = (first[:, None] + stride[:, None] * np.arange(self.copies)) % self.count
        rows = np.repeat(np.arange(len(x)), self.copies)
        node = self._leaves(x, rows, tree.ravel())
        rows, node = rows[node >= self.open], node[node >= self.open]
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
        at = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
        if not len(at):
            return node, at, x[:0], x[:0]
        return node[at], np.diff(np.append(at, len(node))), np.minimum.reduceat(x[rows], at, axis=0), np.maximum.reduceat(x[rows], at, axis=0)

    def grow(self, node: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Close the open nodes, by the sizes and ranges of all rows in them: each is split or becomes a leaf. Nodes that aren't named have no rows."""
        order = np.argsort(node)
        node, size, low, high = node[order], size[order], low[order], high[order]
        self.value[self.open :] = self.level
        self.value[node] += _mean_path(size)
        wide = high > low
        some = (size > 1) & wide.any(axis=1) & (self.level < self.depth)
        node, low, high, wide = node[some], low[some], high[some], wide[some]
        rng = np.random.default_rng([self.seed, self.level])
        f = np.where(wide, rng.random(wide.shape), -1.0).argmax(axis=1) if len(node) else np.zeros(0, np.int64)
        low, high = low[np.arange(len(f)), f], high[np.arange(len(f)), f]
        pad = self.margin * (high - low)
        self.open = len(self.feature)
        self.feature[node], self.split[node], self.child[node] = f, low - pad + rng.random(len(f)) * (high - low + 2 * pad), self.open + 2 * np.arange(len(f))
        self.feature = np.append(self.feature, np.full(2 * len(f), -1))
        self.split, self.child, self.value = (np.append(a, np.zeros(2 * len(f), a.dtype)) for a in (self.split, self.child, self.value))
        self.level += 1

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length, in whole steps."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(self.count):
            total += self.value[self._leaves(x, rows, np.full(len(x), t))]
        return np.rint(total / max(1, self.count) * STEPS).astype(np.int64)

    def scored(self, steps: np.ndarray | float) -> np.ndarray:
        """Anomaly in 0 to 1: 2 to the power of minus the mean path length over its expectation."""
        return 2.0 ** (-np.asarray(steps, dtype=float) / STEPS / self.norm)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.scored(self.paths(x))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, COUNTS, RATES) of each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def measured(batches):
        for b in batches:
            counts, rates = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(np.ascontiguousarray(c)) for c in (*counts.T, *rates.T))], ["id", *COUNTS, *RATES])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(measured, f"id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in RATES))


def _columns(b: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)


def _grown(good: DataFrame, n: int) -> IsolationForest:
    """A forest of all n rows of (name, RATES); each level is one pass over them."""
    forest = IsolationForest(n=n)
    lows, highs = [f"low{i}" for i in range(len(RATES))], [f"high{i}" for i in range(len(RATES))]
    while forest.grows:
        model = good.sparkSession.sparkContext.broadcast(forest)

        def ranges(batches, model=model):
            for b in batches:
                node, size, low, high = model.value.ranges(b.column("name").to_numpy().view(np.uint64), _columns(b, RATES))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (node, size, *low.T, *high.T)], ["node", "size", *lows, *highs])

        parts = good.mapInArrow(ranges, "node bigint, size bigint, " + ", ".join(f"{c} double" for c in lows + highs))
        found = parts.groupBy("node").agg(F.sum("size").alias("size"), *(F.min(c).alias(c) for c in lows), *(F.max(c).alias(c) for c in highs)).toArrow().combine_chunks()
        node, size = (found.column(c).to_numpy() for c in ("node", "size"))
        low, high = (np.stack([found.column(c).to_numpy() for c in names], axis=1) for names in (lows, highs))
        forest.grow(node, size, low, high)
        model.destroy()
    return forest


def _fit(measured: DataFrame, labels: DataFrame, spare: float, min_words: int, max_repeat_percent: int, id_col: str) -> tuple[IsolationForest, float]:
    marks = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("y")).filter("id is not null and y in (0, 1)").distinct()
    passed = measured.filter((F.col("n_words") >= min_words) & (100 * F.col("n_repeat_words") <= max_repeat_percent * F.col("n_words")))
    rows = cut(passed.select("id", *RATES).join(marks, "id").select("y", F.xxhash64("id", F.lit(11)).alias("name"), *RATES))
    good = rows.filter("y = 1").drop("y")
    forest = _grown(good, good.count())
    if not forest.count:
        return forest, 2.0
    model = measured.sparkSession.sparkContext.broadcast(forest)

    def paths(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(model.value.paths(_columns(b, RATES)))], ["y", "steps"])

    counted = rows.select("y", *RATES).mapInArrow(paths, "y int, steps bigint").groupBy("steps").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad")).toArrow().sort_by("steps")
    steps, good, bad = (counted.column(c).to_numpy() for c in ("steps", "good", "bad"))
    best = (-1.0, 2.0)
    if bad.sum():
        dropped, caught = np.cumsum(good) / good.sum(), np.cumsum(bad) / bad.sum()
        for k in np.flatnonzero(dropped <= spare):
            best = max(best, (caught[k] - dropped[k], float(forest.scored(steps[k] + 0.5))))  # between two scores
    return forest, best[1]


def fit_rules(docs: DataFrame, labels: DataFrame, spare: float = 0.05, min_words: int = 50, max_repeat_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> tuple[IsolationForest, float]:
    """A forest and its threshold, from all labelled rows that pass the base rules.

    The threshold is the one with the best balanced accuracy among those that drop at most the share `spare` of the
    good rows. Without labelled good rows nothing is anomalous.
    """
    return _fit(measure(docs, id_col, text_col), labels, spare, min_words, max_repeat_percent, id_col)


def _judge(rows: DataFrame, forest: IsolationForest, threshold: float, min_words: int, max_repeat_percent: int, id_col: str) -> DataFrame:
    """Verdicts on rows of (id, text), or of (id, COUNTS, RATES)."""
    kind = rows.schema["id"].dataType.simpleString()
    model = rows.sparkSession.sparkContext.broadcast(forest)

    def judge(batches):
        for b in batches:
            counts, rates = statistics(b.column("text")) if "text" in b.schema.names else (_columns(b, COUNTS), _columns(b, RATES))
            failed = fails(counts, min_words, max_repeat_percent)
            anomaly = model.value.score(rates)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(np.ascontiguousarray(c)) for c in counts.T), pa.array(failed), pa.array(~failed & (anomaly < threshold)), pa.array(anomaly)], ["id", *COUNTS, "base_failed", "kept", "anomaly"])

    out = rows.mapInArrow(judge, f"id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double")
    return out.withColumnRenamed("id", id_col)


def apply_rules(docs: DataFrame, forest: IsolationForest, threshold: float, min_words: int = 50, max_repeat_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly) for each row.

    Null and empty texts have no words and fail. Repeated rows and null ids keep their rows. Other columns are ignored. No rows: none.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return _judge(texts, forest, threshold, min_words, max_repeat_percent, id_col)


def judge_rules(docs: DataFrame, labels: DataFrame, spare: float = 0.05, min_words: int = 50, max_repeat_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What apply_rules gives with the model of fit_rules on the same rows, whose texts are read once."""
    measured = cut(measure(docs, id_col, text_col))
    return _judge(measured, *_fit(measured, labels, spare, min_words, max_repeat_percent, id_col), min_words, max_repeat_percent, id_col)
