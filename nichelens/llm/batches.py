"""Arrow batch bounds for the Python stages."""

from __future__ import annotations

from pyspark.sql import SparkSession

MAX_RECORDS = 2000
MAX_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep a Python batch small even if texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(MAX_RECORDS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(MAX_BYTES))
