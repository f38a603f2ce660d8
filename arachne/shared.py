"""The folder that driver and executors share, cutting lineage with it, and the size of Arrow batches."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that goes to Python, at most. A task holds a few copies of one batch, so this bounds its memory.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a session on one machine gets a temporary one; on a cluster
    that is an error, as executors would not see it."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="arachne-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and keep it as a checkpoint in the shared folder, so lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to `most`, unless it is lower."""
    now = (spark.conf.get(_BATCH, None) or "").strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(now[-1:], 0)
    digits = now.rstrip("kmg")
    if not digits.isdigit() or not 0 < int(digits) << unit <= most:
        spark.conf.set(_BATCH, f"{most}b")
