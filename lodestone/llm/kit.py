"""Shared plumbing of the training-data operators: scratch tables and word hashing.

Scratch tables are Parquet folders below ``spark.checkpoint.dir`` (the folder that a
cluster shares between driver and executors).  They cut lineage: whatever reads them
afterwards survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators, so that joins keep the row.
NO_ID = -(2**63)
#: Bytes that an Arrow batch may hold on its way to Python.
BATCH = "8m"
#: Bytes of text that one numpy pass handles at a time.
CHUNK = 1 << 20
#: Edges that a task holds at a time before it replaces them by stars.
CONTRACT = 1 << 20


# --------------------------------------------------------------------------- scratch


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode with none configured (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, dropped one by one or when Python ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lodestone-{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self.drop)

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df as Parquet and read it back."""
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def free(self) -> None:
        """Let Spark delete the shuffle files of finished steps now, not when the driver next collects garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Remove the given tables, or everything."""
        for path in [t._scratch_path for t in tables] or [self.root]:
            try:
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
            except Exception:  # noqa: BLE001  at exit the JVM may be gone already
                if tables:
                    raise


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """doc_id (null: NO_ID) and text only; other columns never reach an operator.

    Bounds the session's Arrow batches by bytes (they are a setting of the session, read when a plan is made),
    since 10,000 long texts would not fit a worker.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).cast("string").alias("text"))


def unkeyed(column: str = "doc_id"):
    return F.when(F.col(column) != NO_ID, F.col(column)).alias(column)


# -------------------------------------------------------------------------- identity

_ID, _KEY, ROW = "_lodestone_id", "_lodestone_key", "_lodestone_row"


def id_of() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def key_of() -> Column:
    """Tells apart the texts of one id."""
    return F.xxhash64(F.col("text").cast("string"))


class Identity:
    """One number for each document, whatever its ids are.

    A document's number is its doc_id.  Of the texts that share an id, the one of least hash keeps it; the
    others, and all texts without an id, are numbered above all ids in the order of (doc_id, hash).  Rows
    equal in id and text are one document.  Usually no id repeats: then only the ids are read, once.
    """

    def __init__(self, docs: DataFrame, scratch: Scratch):
        ids = docs.select(id_of().alias("id"))
        again = scratch.table(ids.groupBy("id").count().where((F.col("count") > 1) | (F.col("id") == NO_ID)).select("id"), "again")
        self.shared, self.repeats = None, False
        if again.isEmpty():
            return
        texts = docs.select(id_of().alias("id"), key_of().alias("key")).groupBy("id", "key").agg(F.count("*").alias("rows"))
        texts = scratch.table(texts.where(F.col("id") == NO_ID).union(texts.join(again.where(F.col("id") != NO_ID).hint("merge"), "id", "left_semi")), "texts")
        least = texts.where(F.col("id") != NO_ID).groupBy("id").agg(F.min("key").alias("key")).withColumn("own", F.lit(True))
        texts = texts.join(least.hint("merge"), ["id", "key"], "left")
        others, n = number_rows(texts.where("own is null").select("id", "key", "rows"), ["id", "key"], scratch)
        top = ids.where(F.col("id") != NO_ID).agg(F.max("id")).first()[0]
        base = max(-1 if top is None else top, -1) + 1
        if base + n >= 2**63:
            raise ValueError(f"{n} texts share or lack an id, and the greatest id leaves no room for numbers of their own")
        numbered = others.select("id", "key", "rows", (F.col("row_number") + base).alias("row"))
        self.shared = scratch.table(numbered.union(texts.where("own").select("id", "key", "rows", F.col("id").alias("row"))), "shared")
        self.repeats = not self.shared.where("rows > 1").isEmpty()

    def mark(self, docs: DataFrame, name: str = ROW) -> DataFrame:
        """docs with the number of each row's document."""
        if self.shared is None:
            return docs.withColumn(name, id_of())
        known = self.shared.select(F.col("id").alias(_ID), F.col("key").alias(_KEY), F.col("row").alias(name))
        marked = docs.withColumns({_ID: id_of(), _KEY: key_of()}).join(known.hint("merge"), [_ID, _KEY], "left")
        return marked.withColumn(name, F.coalesce(name, _ID)).drop(_ID, _KEY)

    def texts(self, docs: DataFrame, once: bool = True) -> DataFrame:
        """(doc_id: the number, text); once: a document whose row repeats is taken once."""
        docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        rows = self.mark(docs.select("doc_id", "text")).select(F.col(ROW).alias("doc_id"), F.col("text").cast("string").alias("text"))
        return rows.dropDuplicates(["doc_id"]) if once and self.repeats else rows

    def back(self, df: DataFrame, column: str, key: str | None = None) -> DataFrame:
        """df with ids (null: none) in place of numbers; key: a column for the hash of the text, null where its id has no other."""
        if self.shared is None:
            return df.withColumn(key, F.lit(None).cast("long")) if key else df
        known = self.shared.select(F.col("row").alias(column), F.col("id").alias(_ID), F.col("key").alias(_KEY))
        out = df.join(known.hint("merge"), column, "left")
        if key:
            out = out.withColumn(key, F.col(_KEY))
        out = out.withColumn(column, F.when(F.col(_ID).isNull(), F.col(column)).when(F.col(_ID) != NO_ID, F.col(_ID)))
        return out.select(*df.columns, *([key] if key else []))


def matching(docs: DataFrame, found: DataFrame, how: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """docs, all columns (and ``extra`` ones of found), joined with found (doc_id, text_key) as ``how`` says.

    Null is an id like others; a null text_key stands for any text of the id.  Sort-merge at every size: such
    a list of ids grows with the corpus.
    """
    wanted = found.select(F.coalesce("doc_id", F.lit(NO_ID)).alias(_ID), F.col("text_key").alias("_lodestone_found"), *extra)
    marked = docs.withColumns({ROW: id_of(), _KEY: key_of()})
    fits = (F.col(ROW) == F.col(_ID)) & (F.col("_lodestone_found").isNull() | (F.col("_lodestone_found") == F.col(_KEY)))
    return marked.join(wanted.hint("merge"), fits, how).select(*(f"`{c}`" for c in docs.columns), *extra)


def number_rows(rows: DataFrame, keys: list[str], scratch: Scratch) -> tuple[DataFrame, int]:
    """rows with a gapless ``row_number`` from 0 in the order of keys, and how many there are."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = scratch.table(sorted_.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}), "sorted")
    counts = scratch.table(sorted_.groupBy("_part").count(), "counts")  # a row for each task
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    total = counts.agg(F.sum("count")).first()[0] or 0
    return sorted_.join(bases, "_part").withColumn("row_number", F.col("_base") + F.col("_at")).drop("_part", "_at", "_base"), total


# ----------------------------------------------------------------------------- arrow


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch[text]), 0))
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def runs(batches: Iterable[pa.RecordBatch], key: str | list[str]) -> Iterator[pa.Table]:
    """Rows of equal key as tables, from batches that are sorted by key."""
    keys = [key] if isinstance(key, str) else key
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = np.asarray(batch[k])
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            part = batch.slice(a, b - a)
            if i == 0 and held and any(held[-1][k][-1].as_py() != part[k][0].as_py() for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            if i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


# ----------------------------------------------------------------------------- words

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser over uint64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)])) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


class Words:
    """Words of some texts: lower-cased runs of letters, digits, ``_`` and non-ASCII characters.

    hashes: a uint64 for each word; first: index of each text's first word (one more at the
    end); starts, ends: byte offsets within ``buffer``, base: each text's offset there.
    A null text has no words.
    """

    def __init__(self, texts: list[str | None], lower: bool = True):
        data = [((t.lower() if lower else t) if t else "").encode("utf-8", "replace") for t in texts]
        self.buffer = np.frombuffer(b"\n" + b"\n".join(data) + b"\n", np.uint8)
        sizes = np.fromiter((len(x) + 1 for x in data), np.int64, len(data))
        self.base = np.concatenate([[1], 1 + np.cumsum(sizes)]) if len(data) else np.array([1])
        flags = _WORD[self.buffer]
        edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.base)
        self._hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            with np.errstate(over="ignore"):
                up, down = _powers(len(self.buffer))
                total = np.cumsum(_SALT[self.buffer] * up[: len(self.buffer)])
                self._hashes = mix((total[self.ends - 1] - total[self.starts - 1]) * down[self.starts])
        return self._hashes

    def word(self, i: int) -> str:
        return self.buffer[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def hash_words(words: list[str]) -> np.ndarray:
    """The hash of each of these (they must be single words)."""
    return Words(words).hashes


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and the text each belongs to; a shorter text gives one of all its words."""
    h, n = words.hashes, len(words)
    doc = words.doc
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            out = out * np.uint64(0x9FB21C651E98DF25) + h[j : n - k + 1 + j] if len(out) else out
        whole = doc[: len(out)] == doc[k - 1 :] if len(out) else np.zeros(0, bool)
        owner, values = doc[: len(out)][whole], out[whole]
        short = np.flatnonzero((words.counts > 0) & (words.counts < k))
        extra = np.zeros(len(short), np.uint64)
        for x, d in enumerate(short):
            for j in range(words.first[d], words.first[d + 1]):
                extra[x] = extra[x] * np.uint64(0x9FB21C651E98DF25) + h[j]
    if len(short):
        owner, values = np.concatenate([owner, short]), np.concatenate([values, extra + np.uint64(1)])
        order = np.argsort(owner, kind="stable")
        owner, values = owner[order], values[order]
    return mix(values), owner


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive runs of values as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


# --------------------------------------------------------------- connected components


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least reachable node) that connect what the edges (a, b) do."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        least = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(least, root[x], low)
        np.minimum.at(least, root[y], low)
        while (least[least] != least).any():
            least = least[least]
        least = least[root]
        if (least == root).all():
            return nodes[root != np.arange(len(nodes))], nodes[root[root != np.arange(len(nodes))]]
        root = least


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars in place of the edges of a task, CONTRACT edges at a time."""
    held, n = [(np.zeros(0, np.int64),) * 2], 0
    for batch in batches:
        held.append((np.asarray(batch["a"]), np.asarray(batch["b"])))
        n += batch.num_rows
        if n >= CONTRACT:
            held = [contracted(*(np.concatenate(x) for x in zip(*held)))]
            n = len(held[0][0])
            if n >= CONTRACT // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["a", "b"])
                held, n = [(np.zeros(0, np.int64),) * 2], 0
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(*(np.concatenate(x) for x in zip(*held)))], names=["a", "b"])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that is reachable.

    Each task first replaces its own edges by stars.  Then every node, and all its neighbours, hook to the
    least node among them, until all are stars.
    A round is a group-by with map-side combine and a join on the node; the rows of a hub are
    split by Spark's skew join, being two numbers each.  Rounds are logarithmic in the longest path.
    """
    stars = edges.select("a", "b").where("a != b").mapInArrow(_contract, "a long, b long")  # a above b
    seen = scratch.table(stars.distinct(), "links")
    while True:
        # Every node points at least neighbour; the neighbours of a node then point there too.
        sym = seen.select("a", "b", F.lit(1).alias("up")).union(seen.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("up")))
        least = scratch.table(sym.groupBy("a").agg(F.min("b").alias("m"), F.sum("up").alias("up"), F.count("*").alias("n")), "least")
        # Done when no node is below two others, or both above and below one: all are stars round their least node.
        if least.where("up > 1 or (up = 1 and n > 1)").isEmpty():
            break
        to = least.select("a", F.least("a", "m").alias("m"))
        nxt = scratch.table(
            sym.join(to, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(to.where("a > m").select("a", F.col("m").alias("b"))).distinct(),
            "links",
        )
        scratch.drop(seen, least)
        seen = nxt
    return least.select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
