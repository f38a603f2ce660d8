"""Aggregation, projection and quantisation of vectors. Models are bounded arrays; vectors never leave their rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dimensions of which a covariance is kept in memory at most, 128 MB.
MOST_DIMENSIONS = 4096


def sampled(rows: DataFrame, column: str, sample: int = 2000) -> np.ndarray:
    """The first `sample` vectors by hash, which is all that codebooks are fitted on."""
    found = [r[0] for r in rows.select(column).filter(F.col(column).isNotNull()).orderBy(F.xxhash64(column)).limit(sample).collect()]
    return np.array(found, dtype=float)


def centroids(x: np.ndarray, k: int, seed: int = 1, steps: int = 20) -> np.ndarray:
    """k of them, or as many as there are vectors, by Lloyd's method."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(steps):
        near = _nearest(x, c)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def codebook(rows: DataFrame, column: str, k: int, seed: int = 1, sample: int = 2000, steps: int = 20) -> np.ndarray:
    return centroids(sampled(rows, column, sample), k, seed, steps)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)


def aggregated(descriptors: np.ndarray, books: list[np.ndarray], power: float = 0.5) -> np.ndarray:
    """For each codebook the sums of residuals to the nearest centroids, with signed powers, of unit length in all."""
    v = np.zeros(sum(b.size for b in books))
    at = 0
    for b in books:
        r = np.zeros_like(b)
        if len(descriptors):
            near = _nearest(descriptors, b)
            np.add.at(r, near, descriptors - b[near])
        v[at : at + b.size] = r.ravel()
        at += b.size
    v = np.sign(v) * np.abs(v) ** power
    return v / (np.linalg.norm(v) or 1.0)


def vlad(groups: DataFrame, column: str, books: list[np.ndarray], power: float = 0.5) -> DataFrame:
    """groups with `vlad`. Null and empty arrays of descriptors give zeros."""

    @F.pandas_udf("array<double>")
    def aggregate(s: pd.Series) -> pd.Series:
        return pd.Series([aggregated(np.array([np.asarray(d, dtype=float) for d in (x if x is not None else ())]), books, power) for x in s])

    return groups.withColumn("vlad", aggregate(column))


def keep_descriptors(column: str, p_out: str, p_in: str):
    """Descriptors unless their outer probability exceeds 0.7 and their inner one is below 0.3; arrays of equal order."""
    return F.transform(F.filter(F.arrays_zip(column, p_out, p_in), lambda d: ~((d[p_out] > 0.7) & (d[p_in] < 0.3))), lambda d: d[column])


def guard_length(length: int, most: int) -> None:
    if not 0 < length <= most:
        raise ValueError(f"a vector's length must be from 1 to {most}, not {length}")


def fit_pca(rows: DataFrame, column: str, n: int, whiten: bool = True) -> dict:
    """Mean, n components and scales of all vectors, from sums that each task makes: nothing is sampled.

    Vectors of more than MOST_DIMENSIONS are refused, as their covariance would not fit in memory. Components have the sign
    that makes their largest entry positive.
    """
    first = rows.select(column).filter(F.col(column).isNotNull()).head()
    d = len(first[0]) if first else 0
    guard_length(d, MOST_DIMENSIONS)
    guard_length(n, d)

    def sums(batches):
        total, outer, count = np.zeros(d), np.zeros((d, d)), 0
        for b in batches:
            x = np.array(b.column(0).drop_null().to_pylist(), dtype=float).reshape(-1, d)
            total, outer, count = total + x.sum(0), outer + x.T @ x, count + len(x)
        yield _sums(total, outer, count)

    def added(batches):
        total, outer, count = np.zeros(d), np.zeros((d, d)), 0
        for b in batches:
            for t, o, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                total, outer, count = total + np.frombuffer(t), outer + np.frombuffer(o).reshape(d, d), count + c
        yield _sums(total, outer, count)

    def _sums(total, outer, count):
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([outer.tobytes()], pa.binary()), pa.array([count], pa.int64())], ["total", "outer", "n"])

    schema = "total binary, outer binary, n bigint"
    found = rows.select(column).mapInArrow(sums, schema).repartition(16).mapInArrow(added, schema).coalesce(1).mapInArrow(added, schema).first()
    total, outer, count = np.frombuffer(bytes(found.total)), np.frombuffer(bytes(found.outer)).reshape(d, d), max(1, found.n)
    mean = total / count
    values, vectors = np.linalg.eigh(outer / count - np.outer(mean, mean))
    order = np.argsort(-values)[:n]
    components = vectors[:, order].T
    components = components * np.sign(components[np.arange(n), np.abs(components).argmax(1)])[:, None]
    scales = 1 / np.sqrt(np.maximum(values[order], 1e-12)) if whiten else np.ones(n)
    return {"mean": mean, "components": components, "scales": scales}


def project(rows: DataFrame, column: str, model: dict | None, length: int) -> DataFrame:
    """rows with `projected`, of the given length: the vector itself where it has that length already, else its projection. Null stays null."""
    if model is not None:
        guard_length(length, len(model["components"]))

    @F.pandas_udf("array<double>")
    def projected(s: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            v = np.asarray(v, dtype=float)
            if len(v) == length:
                return v
            if model is None:
                raise ValueError(f"a vector of length {len(v)} needs a projection to {length}")
            return ((model["components"] @ (v - model["mean"])) * model["scales"])[:length]

        return pd.Series([one(v) for v in s])

    return rows.withColumn("projected", projected(column))


def fit_ivfpq(rows: DataFrame, column: str, lists: int = 8192, parts: int = 64, k: int = 256, seed: int = 1, sample: int = 2000) -> dict:
    """A coarse codebook, a random permutation of dimensions, and a codebook for each part of the permuted residuals, all
    fitted on at most `sample` vectors."""
    x = sampled(rows, column, sample)
    guard_length(parts, x.shape[1] if x.ndim == 2 else 0)
    if x.shape[1] % parts:
        raise ValueError(f"{x.shape[1]} dimensions don't divide into {parts} parts")
    coarse = centroids(x, lists, seed)
    order = np.random.default_rng(seed).permutation(x.shape[1])
    residuals = (x - coarse[_nearest(x, coarse)])[:, order]
    return {"coarse": coarse, "order": order, "books": [centroids(p, k, seed + 1 + i) for i, p in enumerate(np.split(residuals, parts, axis=1))]}


def coded(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(list, code of each part) of each vector."""
    if not len(x):
        return np.zeros(0, int), np.zeros((0, len(model["books"])), int)
    near = _nearest(x, model["coarse"])
    pieces = np.split((x - model["coarse"][near])[:, model["order"]], len(model["books"]), axis=1)
    return near, np.stack([_nearest(p, b) for p, b in zip(pieces, model["books"], strict=True)], axis=1)


def ivfpq_codes(rows: DataFrame, column: str, model: dict) -> DataFrame:
    """rows with list_id, the nearest coarse centroid, and code, the nearest centroid of each part of the residual, for the vector. Rows
    without a vector go."""

    @F.pandas_udf("list_id int, code array<int>")
    def assign(s: pd.Series) -> pd.DataFrame:
        near, codes = coded(np.array([np.asarray(v, dtype=float) for v in s]).reshape(len(s), -1), model)
        return pd.DataFrame({"list_id": near, "code": list(codes)})

    return rows.filter(F.col(column).isNotNull()).withColumn("_a", assign(column)).select("*", "_a.*").drop("_a", column)


def insert_codes(codes: DataFrame, path: str, key: str, capacity: int | None = None) -> int:
    """Append the codes whose key the index at `path` lacks, one of each key, and return how many. A full index takes no more: of the new
    ones those with the least keys go in."""
    from arachne.sinks.text import append_new, stored_rows

    stored = stored_rows(codes.sparkSession, path)
    if capacity is None:
        return append_new(codes, stored, path, key)
    room = max(0, capacity - (stored.count() if stored is not None else 0))
    fresh = codes if stored is None else codes.join(stored.select(key), key, "left_anti")
    return append_new(fresh.dropDuplicates([key]).orderBy(key).limit(room), None, path, key)
