"""What a Python worker gets at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of one Arrow batch on its way to Python; a row that is longer is a batch of its own.
BATCH = "8m"


def bound(spark: SparkSession | None = None) -> None:
    """Bound the session's Arrow batches by bytes: rows hold whole files and pages, and 10,000 of them would not fit."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
