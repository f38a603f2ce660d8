"""Filters that stand before a fetch or a save, and row caps that are features of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that an image must exceed, and its least width and height.
LEAST_BYTES, LEAST_SIDE = 20_000, 400
#: Lines read in all, and distinct entries of an image list.
MOST_LINES, MOST_LISTED = 2_000_000, 8_000


def has_source(src: str = "src", page_url: str = "pageUrl") -> Column:
    """Neither the source nor the page's URL is null or empty."""
    return F.coalesce((F.length(src) > 0) & (F.length(page_url) > 0), F.lit(False))


def is_image_type(content_type: Column) -> Column:
    return F.coalesce(content_type.startswith("image"), F.lit(False))


def passes_headers(length: Column, content_type: Column, least: int = LEAST_BYTES) -> Column:
    """More than `least` bytes and a type that begins with `image`; null counts as neither."""
    return F.coalesce(length > least, F.lit(False)) & is_image_type(content_type)


def is_large(width: Column, height: Column, least: int = LEAST_SIDE) -> Column:
    return F.coalesce((width >= least) & (height >= least), F.lit(False))


def first_lines(rows: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """`most` rows at most; which ones, where there are more, is not fixed."""
    return rows.limit(most)


def first_distinct(rows: DataFrame, key: str, most: int = MOST_LISTED) -> DataFrame:
    """`most` distinct keys at most, the least ones, so reruns agree."""
    return rows.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(key).limit(most)
