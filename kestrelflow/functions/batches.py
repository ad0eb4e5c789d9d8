"""Bounds of the batches that Python workers get."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of rows that Spark gives a Python worker at a time, where the session sets no other bound (Spark's own is 2 GB).
BATCH_BYTES = 1 << 22


def small_batches(frame: DataFrame) -> DataFrame:
    """The same rows; its session bounds Arrow batches by bytes, so that rows of long texts don't fill a worker."""
    conf, key = frame.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return frame
