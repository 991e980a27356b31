"""Keeping the index up to date: a snapshot diff at intervals, or new files as a stream.

A file stream never sees deletions or changes in place, so the diff remains the truth; the
stream only brings new documents in early.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.config import EngineConfig
from lodestone.operators.index import ARRIVED, build_index
from lodestone.sources.batches import bound
from lodestone.sources.files import extension_of, listed, text_or_error


@dataclass
class AutoSync:
    """Runs a sync at most once an interval and never twice at a time; errors become an answer."""

    sync: Callable[[], dict]
    interval: float = 5.0
    enabled: bool = True
    clock: Callable[[], float] = time.monotonic
    _last: float = float("-inf")
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def __call__(self, force: bool = False) -> dict:
        if not self.enabled:
            return {"ok": False, "skipped": True, "reason": "disabled"}
        if not force and self.clock() - self._last < self.interval:
            return {"ok": True, "skipped": True, "reason": "interval"}
        if not self._lock.acquire(blocking=False):
            return {"ok": True, "skipped": True, "reason": "running"}
        try:
            stats = self.sync()
            self._last = self.clock()
            return {"ok": True} | stats
        except Exception as e:  # noqa: BLE001
            return {"ok": False, "error": str(e)[:160]}
        finally:
            self._lock.release()


def stream_documents(spark: SparkSession, folder: str) -> DataFrame:
    """New files below a folder as (path, mtime, size, text)."""
    bound(spark)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)

    def read(frames):
        for f in frames:
            f["text"] = [text_or_error(e, c)[0] for e, c in zip(f["ext"], f["content"])]
            yield f[["path", "mtime", "size", "text"]]

    found = files.where(listed(F.col("path"))).select("path", F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"), extension_of(F.col("path")).alias("ext"), "content")
    return found.mapInPandas(read, "path string, mtime double, size long, text string")


def append_new_documents(spark: SparkSession, folder: str, target: str, checkpoint: str, config: EngineConfig = EngineConfig()) -> StreamingQuery:
    """Index what arrives: each micro-batch is a folder of its own below ``target``, written over when the batch is run again.

    Index.read() takes these folders in with the three tables; the next sync or rebuild makes them one.
    """

    def add(batch: DataFrame, number: int) -> None:
        name = F.element_at(F.split("path", "/"), -1)
        docs = batch.select(F.xxhash64("path").alias("doc_id"), "path", name.alias("rel_path"), F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), extension_of(F.col("path")).alias("ext"), "mtime", "size", "text")
        index = build_index(docs, config)
        for table in ("documents", "paragraphs", "chunks"):
            getattr(index, table).write.mode("overwrite").parquet(f"{target}/{ARRIVED}/{table}/batch={number}")

    return stream_documents(spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
