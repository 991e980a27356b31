"""Best-fit-decreasing packing of token pieces into sequences of fixed capacity.

Best fit decreasing looks at lengths alone, and equal lengths are interchangeable.  So the
exact algorithm runs over the histogram of lengths (at most ``capacity`` entries, whatever
the corpus): pieces come in descending length; a segment tree over remaining capacities
gives the tightest open sequences in logarithmic time; sequences with equal contents are
kept as one interval of numbers and split only where a length runs out.  The plan is a
short list of (length, first rank, first sequence, pieces a sequence, offset); each piece
finds its place from its rank among the pieces of its length, which is a count per task
plus a running sum over tasks.  No piece travels to the driver and no length to one task.

Defined results: a null text is empty (the end id alone); a null doc_id packs like others and
is returned as null; rows that repeat an id are pieces of their own; no rows give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.kit import Scratch, keyed, pieces, unkeyed
from lodestone.llm.tokens import encoder


class OpenBins:
    """Segment tree over remaining capacities: how many intervals of sequences each has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = np.zeros(2 * self.size, np.int64)
        self.intervals: dict[int, list] = defaultdict(list)

    def _count(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def add(self, room: int, first: int, n: int, used: int) -> None:
        if room and n:
            self.intervals[room].append((first, n, used))
            self._count(room, 1)

    def take(self, room: int) -> tuple[int, int, int]:
        self._count(room, -1)
        return self.intervals[room].pop()

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that some sequence has."""
        i = least + self.size
        if i >= 2 * self.size:
            return None
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.size


def plan_packing(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Placements (length, first rank, first sequence, pieces a sequence, offset) by length and rank, and the number of sequences."""
    bins, plan, made = OpenBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                per = capacity // length
                first, n, used, room = made, -(-left // per), 0, capacity
                made += n
            else:
                first, n, used = bins.take(room)
                per = room // length
            full = min(n, left // per)
            rest = min(per, left - full * per) if full < n else 0
            if full:
                plan.append((length, rank, first, per, used))
                bins.add(room - per * length, first, full, used + per * length)
            if rest:
                plan.append((length, rank + full * per, first + full, rest, used))
                bins.add(room - rest * length, first + full, 1, used + rest * length)
            bins.add(room, first + full + bool(rest), n - full - bool(rest), used)
            placed = full * per + rest
            rank, left = rank + placed, left - placed
    return np.array(sorted(plan), np.int64).reshape(-1, 5), made


_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary, part int, within long"


def _cut(tokenizer: str, end: int, capacity: int, keep_ids: bool):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, end), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in pieces(batches, limit=2 << 20):
            ids, counts = enc.encode(batch["text"])
            n = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(counts[doc] - start, capacity)
            begin = (np.cumsum(counts) - counts)[doc] + start
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            spans = list(zip((4 * begin).tolist(), (4 * (begin + length)).tolist()))
            # Rank among the pieces of equal length in this task.
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            many = np.diff(np.append(new, len(ordered)))
            within = np.empty(len(doc), np.int64)
            within[order] = np.arange(len(doc)) - np.repeat(new, many) + seen[ordered]
            seen[ordered[new]] += many
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64()), pa.array([bytes(raw[a:b]) for a, b in spans] if keep_ids else [None] * len(spans), pa.binary()), pa.array(np.full(len(doc), part, np.int32)), pa.array(within)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "within"],
            )

    return build


def _place(plan: np.ndarray):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan[:, 0] * (1 << 45) + plan[:, 1]
        for batch in batches:
            length, rank = np.asarray(batch["length"]).astype(np.int64), np.asarray(batch["rank"])
            row = plan[np.searchsorted(key, length * (1 << 45) + rank, side="right") - 1]
            bin_, nth = np.divmod(rank - row[:, 1], row[:, 3])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")), pa.array(row[:, 2] + bin_), pa.array(row[:, 4] + nth * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    return build


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, ids (little-endian 32 bit, if kept), sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.table(keyed(docs).mapInArrow(_cut(tokenizer, end, capacity, keep_ids), _PIECES), "pieces")
    counts = scratch.table(cut.groupBy("part", "length").count(), "counts")
    # At most ``capacity`` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan, _ = plan_packing(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    # Sort-merge: there is a base for each task and length, so what would be broadcast grows with the corpus.
    ranked = cut.join(base.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("within"))
    placed = ranked.mapInArrow(_place(plan), "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary, sequence_id long, offset long")
    return placed.withColumn("doc_id", unkeyed()).withColumn("length", F.col("length").cast("long"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of each sequence, from pack(keep_ids=True); a sequence is at most one capacity long; no rows give none."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return parts.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["length"]).alias("length"), joined.alias("ids"))
