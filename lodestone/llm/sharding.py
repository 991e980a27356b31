"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered in the order of (doc_id, text_crc32, size): ranges of keys go to tasks, each
task numbers its rows, and a running sum over the tasks' counts gives the global number.
The permutation is a Feistel network over Z_a x Z_b with a * b >= rows and less than
``a`` numbers to spare; a number beyond the last row walks on along its cycle until it is
a row's.  So place = permute(row number), shard = place mod shards and slot = place div
shards: both can be computed for any row without looking at another, shard sizes differ by
one at most, and slots have no gaps.  Everything runs as built-in SQL functions.

Law: ``rows``.  Equal texts are spread like other rows; a law on counts leaves no room for
keeping a group together that holds a third of all rows.

Defined results: a null text has size 8 and crc 0; a null doc_id sorts first and is returned
as null; rows that repeat are numbered one after the other; no rows give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.kit import NO_ID, Scratch, number_rows, unkeyed

ROUNDS = 8


def domain(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("long"))


def _feistel(x: Column, a: int, b: int, seed: int) -> Column:
    half = F.struct(_div(x, b).alias("l"), (x % F.lit(b).cast("long")).alias("r"))
    key = F.lit(seed).cast("long")

    def turn(acc: Column, i: Column) -> Column:
        left = F.pmod(acc["l"] + F.pmod(F.xxhash64(key, i, acc["r"]), F.lit(a).cast("long")), F.lit(a).cast("long"))
        right = F.pmod(acc["r"] + F.pmod(F.xxhash64(key, i, acc["l"]), F.lit(b).cast("long")), F.lit(b).cast("long"))
        return F.when(i % 2 == 0, F.struct(left.alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), right.alias("r")))

    rounds = F.array(*(F.lit(i).cast("long") for i in range(ROUNDS)))
    return F.aggregate(rounds, half, turn, lambda acc: acc["l"] * F.lit(b).cast("long") + acc["r"])


def permute(row: Column, n: int, seed: int = 0) -> Column:
    """The place of each row number below n, a permutation of 0 to n - 1."""
    a, b = domain(n)
    steps = min(a * b - n, 64)  # numbers to spare: no walk is longer; beyond 64 steps lies a chance of n ** -32
    first = _feistel(row, a, b, seed)
    walked = F.aggregate(F.array(*(F.lit(i) for i in range(steps))), first, lambda acc, _: F.when(acc < n, acc).otherwise(_feistel(acc, a, b, seed))) if steps else first
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("the cycle walk did not end")).cast("long"))


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 20240607) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null) and row_number of every document."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
    )
    numbered, n = number_rows(rows, ["doc_id", "text_crc32", "size"], Scratch(docs.sparkSession, "sharding"))
    placed = numbered.withColumn("place", permute(F.col("row_number"), n, seed))
    return placed.select(
        unkeyed(), "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        _div(F.col("place"), shards).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def write_shards(docs: DataFrame, folder: str, shards: int = 24, seed: int = 20240607) -> DataFrame:
    """Documents with their shard and slot as Parquet, a folder for each shard, in slot order within it.

    Every row is written once, whether its id is null or repeats; no rows give no files (an error to read).
    """
    # Rows of one id and text are numbered among themselves on both sides: which of them gets which slot is open.
    text, keys = F.coalesce(F.col("text").cast("string"), F.lit("")), ["_id", "_crc", "_size", "_n"]
    size = (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 8).cast("long")
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.withColumns({"_id": id_, "_crc": F.crc32(text), "_size": size})
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys[:3]).orderBy("text")))
    placed = shard_rows(docs, shards, seed).select(id_.alias("_id"), F.col("text_crc32").alias("_crc"), F.col("size").alias("_size"), "shard", "slot", "row_number")
    placed = placed.withColumn("_n", F.row_number().over(Window.partitionBy(*keys[:3]).orderBy("row_number"))).drop("row_number")
    rows.join(placed, keys).drop(*keys).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.parquet(folder)
