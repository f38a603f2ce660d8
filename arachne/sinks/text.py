"""Text sinks, and appending to tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, order: str | None = None) -> None:
    """Tab-separated key and value lines; what the folder held goes first."""
    df = df.orderBy(order) if order else df
    df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_media_json(refs: DataFrame, path: str) -> None:
    """Gzipped lines of JSON objects, each followed by a comma."""
    from arachne.operators.media import media_json

    media_json(refs).write.mode("overwrite").option("compression", "gzip").text(path)


def batch_folder(base: str, start: int) -> str:
    """Where the batch that begins at a manifest's line writes: the base with the number at its end."""
    return f"{base}{start}"


def write_batches(batches: dict[int, DataFrame], base: str) -> list[str]:
    """The media of each batch, by its first line, in a folder of its own, one after another."""
    folders = []
    for start in sorted(batches):
        write_media_json(batches[start], batch_folder(base, start))
        folders.append(batch_folder(base, start))
    return folders


def write_report(rows: DataFrame, path: str) -> None:
    """The lines of operators.report, in order, as one text file."""
    from arachne.operators.report import report_lines

    report_lines(rows).orderBy("place").select("value").coalesce(1).write.mode("overwrite").text(path)


def stored_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path; None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_new(df: DataFrame, stored: DataFrame | None, path: str, key: str = "id") -> int:
    """Append one row of each key that isn't stored yet, and return how many. Of rows with one key in df one is kept; rows with a null key
    are left out."""
    fresh = df.filter(F.col(key).isNotNull()).dropDuplicates([key])
    fresh = fresh if stored is None else fresh.join(stored.select(key), key, "left_anti").select(*df.columns)
    before = stored_rows(df.sparkSession, path)
    had = before.count() if before is not None else 0  # by the files' footers
    fresh.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path).count() - had


def arff_dense(rows: DataFrame, relation: str, features: list[str], label: str = "class") -> DataFrame:
    """Header lines, then data lines; (part, value), to be written in this order."""
    return _arff(rows.select(F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in features), F.col(label)).alias("value")), relation, features)


def arff_dense_ngrams(rows: DataFrame, relation: str, n: int, hits: str = "hits", label: str = "class") -> DataFrame:
    """As arff_dense, a 0 or 1 for each of n n-grams: 1 for those whose indexes `hits` has. Rows without a hit stay."""
    marks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.array_contains(F.col(hits).cast("array<int>"), i), F.lit(False)).cast("int").cast("string"))
    return _arff(rows.select(F.concat(F.array_join(marks, ","), F.lit(","), F.col(label)).alias("value")), relation, [f"ngram{i}" for i in range(n)])


def arff_sparse(rows: DataFrame, relation: str, n: int, hits: str = "hits", label: str = "class") -> tuple[DataFrame, DataFrame]:
    """Lines `{i 1, ..., n CLASS}`, and a row that says how many rows had no hit and were left out: (skipped)."""
    some = F.coalesce(F.size(hits) > 0, F.lit(False))
    marks = F.transform(F.sort_array(hits), lambda i: F.concat(i.cast("string"), F.lit(" 1")))
    line = F.concat(F.lit("{"), F.array_join(marks, ", "), F.lit(f", {n} "), label, F.lit("}"))
    return _arff(rows.filter(some).select(line.alias("value")), relation, [f"ngram{i}" for i in range(n)]), rows.filter(~some).agg(F.count("*").alias("skipped"))


def _arff(data: DataFrame, relation: str, features: list[str]) -> DataFrame:
    head = [f"@relation {relation}", "", *(f"@attribute {f} numeric" for f in features), "@attribute class {'SMALL','BIG'}", "", "@data"]
    lines = data.sparkSession.createDataFrame([(i, h) for i, h in enumerate(head)], "part int, value string")
    return lines.unionByName(data.select(F.lit(len(head)).alias("part"), "value"))


def sparse_of_dense(lines: DataFrame, n: int) -> DataFrame:
    """Sparse data lines of dense 0/1 ones with n features and a class; shorter lines are left out."""
    v = F.split("value", ",")
    hits = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(v, i) == "1")
    marks = F.transform(hits, lambda i: F.concat(i.cast("string"), F.lit(" 1")))
    return lines.filter(F.size(v) > n).select(F.concat(F.lit("{"), F.array_join(F.concat(marks, F.array(F.concat(F.lit(f"{n} "), F.get(v, F.lit(n))))), ", "), F.lit("}")).alias("value"))


def write_arff(lines: DataFrame, path: str) -> None:
    """One file, as the format has one header: the lines of part order."""
    lines.orderBy("part").select("value").coalesce(1).write.mode("overwrite").text(path)
