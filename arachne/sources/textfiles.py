"""Text inputs: manifests, JSON lines, seeds, frequency and vocabulary files, reports, image headers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arachne.functions.url import host, strip_www
from arachne.operators.gates import MOST_LISTED, first_distinct
from arachne.operators.order import numbered_as_read

IMAGE = "id string, src string, normalizedSrc string, alt string, pageUrl string, parentTxt string, domElem string, domSib int, domDepth int, filename string, w string, h string, isBig boolean, isSmall boolean"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value), from 1, of one file such as a manifest."""
    return numbered_as_read(spark.read.text(path)).select("line", "value")


def manifest_range(spark: SparkSession, path: str, start: int, end: int, prefix: str = "") -> DataFrame:
    """Paths of manifest lines in [start, end), half open so that neighbouring batches share none."""
    return numbered_lines(spark, path).filter((F.col("line") >= start) & (F.col("line") < end)).select(F.concat(F.lit(prefix), "value").alias("path"))


def batch_ranges(start: int, end: int, step: int) -> list[tuple[int, int]]:
    """Half-open ranges of `step` lines that cover [start, end), each line once."""
    return [(a, min(a + step, end)) for a in range(start, end, step)]


def read_media_json(spark: SparkSession, path: str, strict_dims: bool = False) -> tuple[DataFrame, DataFrame]:
    """(images, rejects) of JSON lines in all .gz files under a folder; a trailing comma is let pass. Each line is in one of them.

    w and h are read as text and cast. A line whose object can't be read is a reject. One of whose dimensions is no number is an
    image with null for it, or a reject if strict_dims.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").text(path).filter(F.trim("value") != "")
    lines = lines.withColumn("o", F.from_json(F.regexp_replace("value", r",\s*$", ""), IMAGE))
    images = lines.select("value", "o.*").withColumns({"w0": F.col("w"), "h0": F.col("h")}).withColumns({c: F.trim(c).try_cast("int") for c in ("w", "h")})
    broken = F.coalesce("src", "pageUrl", "alt", "parentTxt", "domElem").isNull()
    odd = (F.col("w0").isNotNull() & F.col("w").isNull()) | (F.col("h0").isNotNull() & F.col("h").isNull())
    bad = broken | odd if strict_dims else broken
    return images.filter(~bad).drop("value", "w0", "h0"), images.filter(bad).select("value")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a list's lines as they are, such as domains or known cases; empty lines and repeated ones go."""
    return spark.read.text(path).select(F.col("value").alias("url")).filter("url <> ''").distinct()


def read_image_list(spark: SparkSession, path: str, most: int = MOST_LISTED) -> DataFrame:
    """(url): the first token of each line, distinct, `most` at most: the least ones."""
    return first_distinct(spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].alias("url")).filter("url <> ''"), "url", most)


def seed_hosts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip_www(host(F.trim("value"))).alias("host")).filter("host is not null").distinct()


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(elem, n) of `elem count` lines cut at the last space; counts of one element add up."""
    t = spark.read.text(path).select(F.trim("value").alias("v"))
    parts = t.select(F.regexp_extract("v", r"^(.+) (\S+)$", 1).alias("elem"), F.regexp_extract("v", r"^(.+) (\S+)$", 2).try_cast("bigint").alias("n"))
    return parts.filter("elem <> '' and n is not null").groupBy("elem").agg(F.sum("n").alias("n"))


def read_vocabulary(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(idx, ngram): the first token of each of the first n lines."""
    return numbered_lines(spark, path).filter(F.col("line") <= n).select((F.col("line") - 1).alias("idx"), F.split(F.trim("value"), r"\s+")[0].alias("ngram"))


def read_report_hosts(spark: SparkSession, path: str, more_than: int = 20) -> DataFrame:
    """Sorted distinct hosts of a report: those that head a distribution, as they are, and those counted more often than that, without a
    leading `www.`."""
    v = F.col("value")
    head = "Image url distribution for host: "
    counted = F.regexp_extract(v, r"^(\S+)\s+(\d+)$", 2).try_cast("bigint") > more_than
    hosts = spark.read.text(path).select(F.when(v.startswith(head), F.substring(v, len(head) + 1, 1 << 20)).when(counted, strip_www(F.regexp_extract(v, r"^(\S+)", 1))).alias("host"))
    return hosts.filter("host is not null").distinct().orderBy("host")


def archive_preview(records: DataFrame, first: int = 6, order: tuple[str, ...] = ("path", "rec_no")) -> DataFrame:
    from arachne.functions.text import preview

    return records.orderBy(*order).limit(first).select("url", preview(F.col("content").cast("string")).alias("preview"))


def header_dims(data: bytes | None) -> tuple[int, int] | None:
    """Width and height by the first bytes of a PNG, GIF, BMP or JPEG image."""
    if not data:
        return None
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                marker = data[at + 1]
                if data[at] != 0xFF:
                    return None
                if marker == 0xFF:
                    at += 1
                elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                else:
                    at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    except struct.error:
        pass
    return None


def image_dims(files: DataFrame) -> DataFrame:
    """(filename, width, height) of binaryFile rows; unknown formats have nulls."""

    @F.pandas_udf("width int, height int")
    def dims(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header_dims(bytes(c)) or (None, None) for c in content], columns=["width", "height"])

    return files.select(F.col("path").alias("filename"), dims("content").alias("d")).select("filename", "d.*")
