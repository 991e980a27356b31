"""Token-id files with fixed-width bit packing.

A file is ``LDTOK1\\0\\0``, then blocks of BLOCK ids, each id in the least number of bits
that the vocabulary needs, then a footer: an int64 doc_id and an int64 first id for each
document, an int64 byte offset for each block (one more at the end), and last eight int64:
bits, ids a block, documents, ids, blocks, 0, 0, the footer's offset.  Ids are packed least
significant bit first, 64 ids to ``bits`` little-endian 64-bit words, so that any range is
read from the blocks that hold it and unpacked in a few numpy operations.

Files are numbered in ascending doc_id order, about FILE_BYTES of text each, so a file, its sort and what
its writer holds (two numbers a document) do not grow with the corpus.  A task writes under a name of its own and
renames the finished file, so a task that runs again leaves one file.

Defined results: a null text is an empty one (the end id alone); a null doc_id sorts first
and is returned as null; rows that repeat an id are documents of their own, in the order of
a hash of their texts; extra columns are ignored; no rows give no files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.kit import NO_ID, Scratch, keyed, pieces, unkeyed
from lodestone.llm.tokens import encoder

MAGIC = b"LDTOK1\0\0"
BLOCK = 65_536
#: Bytes of text that one file is to hold, and the least that is worth a task of its own.
FILE_BYTES, LEAST_BYTES = 256 << 20, 2 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, packed; padded with zeros to 64 ids."""
    n = -(-len(ids) // 64)
    rows = np.zeros((n, 64), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((n, bits + 1), np.uint64)
    for i in range(64):
        word, shift = divmod(i * bits, 64)
        out[:, word] |= rows[:, i] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, i] >> np.uint64(64 - shift)
    return out[:, :bits].astype("<u8").tobytes()


def unpack(data: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """n ids from the start-th on."""
    padded = np.frombuffer(bytes(data) + b"\0" * 8, np.uint8)
    windows = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    at = np.arange(start, start + n, dtype=np.int64) * bits
    return ((windows[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class Writer:
    def __init__(self, uri: str, bits: int):
        self.fs, self.path = open_store(uri)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rsplit("/", 1)[0])
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.bits, self.held, self.n_held, self.at, self.ids = bits, [], 0, len(MAGIC), 0
        self.blocks, self.doc_ids, self.firsts = [], [], []

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_ids)
        self.firsts.append(self.ids + np.concatenate([[0], np.cumsum(counts)[:-1]]))
        self.ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            flat = np.concatenate(self.held)
            whole = len(flat) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(flat[i : i + BLOCK])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.blocks.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> dict[str, int]:
        if self.n_held:
            self._block(np.concatenate(self.held))
        docs = np.concatenate(self.doc_ids) if self.doc_ids else np.zeros(0, np.int64)
        firsts = np.concatenate(self.firsts) if self.firsts else np.zeros(0, np.int64)
        tail = [self.bits, BLOCK, len(docs), self.ids, len(self.blocks), 0, 0, self.at]
        for part in (docs, firsts, [*self.blocks, self.at], tail):
            self.out.write(np.asarray(part, "<i8").tobytes())
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return {"n_docs": len(docs), "n_ids": self.ids, "n_bytes": self.at}


class Reader:
    """Random access: ids(start, n); documents: doc_ids, firsts."""

    def __init__(self, uri: str):
        fs, path = open_store(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = np.frombuffer(self.file.read_at(64, size - 64), "<i8")
        self.bits, self.block, n_docs, self.n_ids, n_blocks, _, _, at = map(int, tail)
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        footer = np.frombuffer(self.file.read_at(size - 64 - at, at), "<i8")
        self.doc_ids, self.firsts, self.blocks = footer[:n_docs], footer[n_docs : 2 * n_docs], footer[2 * n_docs :]

    def ids(self, start: int, n: int) -> np.ndarray:
        if n <= 0:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (start + n - 1) // self.block + 1
        data = self.file.read_at(int(self.blocks[b] - self.blocks[a]), int(self.blocks[a]))
        return unpack(data, self.bits, start - a * self.block, n)

    def documents(self, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(doc_ids, counts, ids) over groups of documents of about ``step`` ids."""
        ends = np.append(self.firsts[1:], self.n_ids)
        i = 0
        while i < len(self.doc_ids):
            j = max(i + 1, int(np.searchsorted(ends, self.firsts[i] + step, side="right")))
            yield self.doc_ids[i:j], ends[i:j] - self.firsts[i:j], self.ids(int(self.firsts[i]), int(ends[j - 1] - self.firsts[i]))
            i = j

    def close(self) -> None:
        self.file.close()


def _write(folder: str, tokenizer: str, end: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        name = f"{folder}/tokens-{part:06d}.ldt"
        enc = encoder(tokenizer, end)
        for batch in pieces(batches, limit=2 << 20):
            ids, counts = enc.encode(batch["text"])
            writer = writer or Writer(name, bits_for(enc.vocabulary))
            writer.add(np.asarray(batch["doc_id"]), counts, ids)
        if writer:
            made = writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [made["n_docs"]], "n_ids": [made["n_ids"]], "n_bytes": [made["n_bytes"]]})

    return build


def files_for(docs: DataFrame) -> int:
    """How many files: by bytes, and for a small corpus one for each core that has enough to do."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    return max(1, -(-size // FILE_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = 1, files: int | None = None) -> DataFrame:
    """Write the files; returns their manifest (part, file, n_docs, n_ids, n_bytes), not yet run."""
    n = files or files_for(docs)
    rows = keyed(docs).withColumn("key", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "doc_id", "key").sortWithinPartitions("doc_id", "key").select("doc_id", "text")
    return ordered.mapInArrow(_write(folder, tokenizer, end), "part long, file string, n_docs long, n_ids long, n_bytes long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            reader, start = Reader(row["file"]), row["start"]
            for doc_ids, counts, ids in reader.documents():
                ends = np.cumsum(counts)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array(start + ends - counts), pa.array(counts), pa.array(crc, pa.int64()), pa.array([row["file"].rsplit("/", 1)[1]] * len(counts))], names=["doc_id", "start", "n_tokens", "ids_crc32", "file"])
                start += int(ends[-1])
            reader.close()


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) of every document in the files of a manifest.

    The running start is over files, whose number is that of write tasks, not over rows.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("part", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    n = max(1, manifest.count())  # a file a task, so far as the hash spreads them
    rows = files.repartition(n, "part").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")
    return rows.withColumn("doc_id", unkeyed())


def token_output(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Write, then read back; the files stay in the shared folder."""
    scratch = Scratch(docs.sparkSession, "tokens")
    return read_tokens(scratch.table(write_tokens(docs, scratch.path("files"), tokenizer, end), "manifest"))
