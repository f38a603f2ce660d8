"""A corpus from documents to packed sequences, in stages that each keep their result as a table.

quality: documents that the compression classifier scores below 0.5 go.
near_duplicates: of documents that links on 5-word shingles (similarity 0.8 or more) connect, the least id stays.
private_data: personal data and secrets are replaced by their kind.
mixture: documents are taken as often as their source's target says, so they can repeat.
packing: sequences of 2048 tokens at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arachne.llm.compression import fit_compression, score_compression
from arachne.llm.mixing import mixed_documents
from arachne.llm.ngram_join import link_components
from arachne.llm.packing import pack
from arachne.llm.pii import fit_spans, redact
from arachne.llm.queries import vocabulary
from arachne.llm.shared import cut, shared_dir

LEAST_QUALITY = 0.5
#: Not a column of documents.
_SCORE = "_quality_score"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below LEAST_QUALITY go, by labels.parquet in sf_dir. Null and empty texts have the score of a text that tells nothing. Without
    labelled rows all stay. No rows: none."""
    model = fit_compression(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_compression(docs, model, score_col=_SCORE).filter(F.col(_SCORE) >= LEAST_QUALITY).drop(_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a null id or without words stay. Rows of one id go if all of them are linked to a lesser id; of rows
    with one id and text one stays."""
    linked = link_components(docs, k=5, num=80, den=100).filter("doc_id is not null")
    ids = cut(linked.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone"), F.count("*").alias("n")).filter("gone or n > 1"))
    kept = docs.join(ids.filter("gone").select("doc_id"), "doc_id", "left_anti")
    repeated = ids.filter("not gone").select("doc_id")
    if repeated.head(1):
        once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(once)
    return kept.select(docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; in texts each span of personal data is its kind in brackets, and n_chars counts anew. Null texts stay null."""
    return redact(docs, fit_spans(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target takes them, 0 to 2 times; rows of one id go together. A null source is a source. No rows: none."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all rows' pieces; null and empty texts are their end alone."""
    return pack(docs, vocabulary())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("private_data", private_data), ("mixture", mixture), ("packing", packing)]

#: SQL has no form of the classifier, the span classifier or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
