"""Quality by compression: zstandard dictionaries trained on good and on bad labelled text.

A document is compressed with either dictionary, in blocks of fixed size that each start from the dictionary alone, so that
each part of a long text counts as much as its beginning. The difference of the two sizes, summed over the blocks and in
proportion to the text's own size, goes through a logistic curve fitted on labelled rows that trained no dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arachne.llm.labelled import labelled_sample
from arachne.llm.shared import small_batches


#: Bytes that are compressed at once: what follows more text than that is matched against the text, not the dictionary.
BLOCK = 8192


class Compressors:
    """Opened once in each worker: compressors are not shared between processes."""

    def __init__(self, dictionaries: tuple[bytes, bytes], level: int = 3):
        import zstandard as z

        self.of = []
        for d in dictionaries:
            known = z.ZstdCompressionDict(d)
            known.precompute_compress(level=level)
            self.of.append(z.ZstdCompressor(level=level, dict_data=known, write_content_size=False))

    def difference(self, text: bytes | pa.Buffer | None) -> float:
        """How much smaller the good dictionary makes a text than the bad one, in parts of its size; 0 if null or empty."""
        if not text:
            return 0.0
        whole = memoryview(text)
        good, bad = (sum(len(c.compress(whole[i : i + BLOCK])) for i in range(0, len(whole), BLOCK)) for c in self.of)
        return (bad - good) / len(whole)


def build_dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary of `size` bytes at most; texts that are too few to train on are its content as they are."""
    import zstandard as z

    texts = [t for t in texts if len(t) > 8]
    try:
        return z.train_dictionary(min(size, max(1024, sum(map(len, texts)) // 8)), texts).as_bytes()
    except z.ZstdError:
        return b"".join(texts)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method; classes weigh as they are."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_compression(docs: DataFrame, labels: DataFrame, where: Column | None = None, sample_rows: int = 4000, dictionary: int = 112_640, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Dictionaries and curve from at most `sample_rows` labelled rows of each class that `where` admits.

    A half of them, chosen by hash, trains the dictionaries, the others fit the curve. Texts are cut into blocks to train
    on; of a class's blocks, wherever they stand in their texts, `sample_rows` at most are taken by hash. Where a class has no rows in either half every score is 0.5.
    """
    small_batches(docs.sparkSession)
    none = {"dictionaries": (b"", b""), "weights": np.zeros(2)}
    sample = labelled_sample(docs, labels, "quality", sample_rows, where, id_col, text_col)
    even = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2)) == 0
    cut = sample.filter(even).select("id", "y", F.expr("cast(text as binary)").alias("whole"))
    cut = cut.select("id", "y", "whole", F.explode(F.expr(f"sequence(0, cast(greatest(octet_length(whole) - 1, 0) div {BLOCK} as int))")).alias("k"))
    cut = cut.select("id", "y", "k", F.expr(f"substring(whole, k * {BLOCK} + 1, {BLOCK})").alias("block"))
    order = Window.partitionBy("y").orderBy(F.xxhash64("id", "k", F.lit(7)), "id", "k", "block")
    blocks = cut.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample_rows).drop("place").collect()
    blocks.sort(key=lambda r: (str(r["id"]), r["k"], bytes(r["block"])))
    dictionaries = tuple(build_dictionary([bytes(r["block"]) for r in blocks if r["y"] == y], dictionary) for y in (1, 0))
    if not all(dictionaries):
        return none

    def measured(batches):
        c = Compressors(dictionaries)
        for b in batches:
            d = np.array([c.difference(t) for t in b.column("text").cast(pa.binary()).to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(d)], ["y", "d"])

    rows = np.array([tuple(r) for r in sample.filter(~even).select("text", "y").mapInArrow(measured, "y int, d double").collect()], dtype=float).reshape(-1, 2)
    rows = rows[np.lexsort(rows.T)]
    if len(set(rows[:, 0])) < 2:
        return none
    share = labels.filter(where if where is not None else F.lit(True)).filter("quality in (0, 1)").agg(F.avg(F.col("quality").cast("double"))).first()[0]
    scale = float(rows[:, 1].std()) or 1.0
    weights = _logistic(rows[:, 1:] / scale, rows[:, 0])
    weights[1] /= scale
    # the sample's classes are of other sizes than the labels'
    weights[0] += np.log(share / (1 - share)) - np.log(rows[:, 0].mean() / (1 - rows[:, 0].mean()))
    return {"dictionaries": dictionaries, "weights": weights}


def score_compression(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column `score_col` in 0 to 1, higher where label 1 is likelier; one of that name is replaced.

    Null and empty texts get the score of a text that neither dictionary favours. All rows stay, repeated ones too. No rows: none.
    A text is compressed block by block, so a long one takes no more memory than itself.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = all(sent.value["dictionaries"])
        c = Compressors(sent.value["dictionaries"]) if known else None
        w = sent.value["weights"]
        for texts in columns:
            d = np.array([c.difference(t.as_buffer()) for t in texts.cast(pa.binary())] if known else [0.0] * len(texts), dtype=float)
            yield pa.array(1 / (1 + np.exp(-np.clip(w[0] + d * w[1], -30, 30))))

    # the texts alone go to Python, once, and only scores come back
    others = [F.col(f"`{c}`") for c in docs.columns if c != score_col]
    return docs.select(*others, F.arrow_udf(scored, "double")(F.col(text_col).cast("string")).alias(score_col))
