"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of at most `rows` labelled documents of each class, those with the least hash of their id.

    Only ids and labels of this bounded sample are broadcast, so one scan of the texts finds its rows.
    """
    labels = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"), F.xxhash64(F.col(id_col), F.lit(11)).alias("h")).filter("id is not null and y in (0, 1)")
    if where is not None:
        labels = labels.withColumnRenamed("id", id_col).filter(where).withColumnRenamed(id_col, "id")
    some = None
    for y in (0, 1):
        part = labels.filter(F.col("y") == y).orderBy("h", "id").limit(rows)
        some = part if some is None else some.union(part)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(some.select("id", "y").distinct()), "id")
