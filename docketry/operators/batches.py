"""Batches that go to Python workers."""

from pyspark.sql import SparkSession

#: Bytes of a batch, about: it bounds a worker's memory, however long the texts.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on batches of the session hold BATCH_BYTES at most, or one row."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
