"""Rows in one order over all partitions, without a window that takes all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arachne.shared import cut


def by_ranges(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """rows dealt by ranges of their order, with `_part`, the number of the range, and `_at`, the place in it. They are kept
    in the shared folder, so the numbers stay as they are. Equal keys are in one range."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return cut(laid.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))


def before_each(ends: DataFrame, sums: dict[str, str]) -> DataFrame:
    """ends, a row for each range, with the sums of the named columns over earlier ranges: {new column: column}. The one
    window over all rows here sees as many rows as there are ranges."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return ends.withColumns({new: F.coalesce(F.sum(old).over(earlier), F.lit(0)) for new, old in sums.items()})


def numbered(rows: DataFrame, order: list[Column], name: str = "line") -> DataFrame:
    """rows with their number from 1 in the given order; ties are numbered in no fixed order."""
    laid = by_ranges(rows, order)
    ends = before_each(laid.groupBy("_part").agg(F.count("*").alias("_n")), {"_before": "_n"}).select("_part", "_before")
    here = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return laid.withColumn(name, here).join(F.broadcast(ends), "_part").withColumn(name, (F.col(name) + F.col("_before")).cast("bigint")).drop("_part", "_at", "_before")  # a row for each range


def numbered_as_read(rows: DataFrame, name: str = "line") -> DataFrame:
    """rows with their number from 1 in the order in which they are read: partitions in turn. One further pass counts them."""
    at = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    ends = before_each(at.groupBy("_part").agg(F.count("*").alias("_n")), {"_before": "_n"}).select("_part", "_before")
    out = at.join(F.broadcast(ends), "_part").withColumn(name, F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1)  # a row for each partition
    return out.drop("_part", "_at", "_before")
