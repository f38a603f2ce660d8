"""Host counts over a folder that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arachne.functions.url import host


def running_host_counts(stream: DataFrame, url_col: str = "url", ts_col: str | None = None, late: str = "1 day") -> DataFrame:
    """Distinct URLs by host, for a complete-mode sink.

    With `ts_col` state holds the URLs of `late` before the newest time only, and a URL that comes back later counts again;
    without it, it holds all URLs ever seen, so that is for streams whose URLs are few.
    """
    if ts_col is None:
        seen = stream.select(F.col(url_col).alias("url")).dropDuplicates(["url"])
    else:
        seen = stream.select(F.col(url_col).alias("url"), F.col(ts_col).alias("ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["url"])
    return seen.groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def windowed_events(stream: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"))
