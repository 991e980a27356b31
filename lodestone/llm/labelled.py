"""Labelled rows for the trained operators: the split, and a bounded sample to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.kit import keyed

#: Labelled rows that a model is fitted on at most; taken in the order of a hash of doc_id.
SAMPLE = 20_000


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, label) of at most ``sample`` labelled rows that are not held out.

    Which ids are taken is decided over the narrow label table; only their texts are read on.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return keyed(docs).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
