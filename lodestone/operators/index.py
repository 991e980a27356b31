"""The document index: three Parquet tables, rebuilt or synchronised with a snapshot diff."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import EngineConfig
from lodestone.functions.text import content_hash, filled
from lodestone.functions.tokens import terms_text
from lodestone.operators.split import chunks, paragraphs

LEAST_CHARS = 20
#: Where a stream puts what has arrived since the tables were written.
ARRIVED = "arrived"
TABLES = ("documents", "paragraphs", "chunks")


@dataclass
class Index:
    """documents (doc_id, path, rel_path, title, ext, mtime, size, content_hash), paragraphs and chunks by doc_id.

    Chunks repeat their document's title and rel_path, so a search scans one table and joins nothing.
    """

    documents: DataFrame
    paragraphs: DataFrame
    chunks: DataFrame

    def write(self, folder: str) -> Index:
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").option("mergeSchema", True).parquet(f"{folder}/{name}")
        return Index.read(self.documents.sparkSession, folder)

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Index:
        """The tables below a folder, with what a stream has added; columns that some files lack are null there."""
        return cls(*(_stored(spark, folder, name) for name in TABLES))


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    read = spark.read.option("mergeSchema", True)
    places = [p for p in (f"{folder}/{name}", f"{folder}/{ARRIVED}/{name}") if _exists(spark, p)]
    found = [read.parquet(p).drop("batch") for p in places] or [read.parquet(f"{folder}/{name}")]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1], allowMissingColumns=True)


def parsed(docs: DataFrame, config: EngineConfig = EngineConfig(), entities: bool = True) -> DataFrame:
    """docs with ``paras`` and ``chunks`` arrays; one pass over the texts."""
    with_paras = docs.withColumn("paras", paragraphs(F.col("text"), entities))
    return with_paras.withColumn("chunks", chunks(F.col("paras"), config.chunk_size, config.chunk_overlap))


def build_index(docs: DataFrame, config: EngineConfig = EngineConfig(), entities: bool = True) -> Index:
    """Index of (doc_id, path, rel_path, title, ext, mtime, size, text); texts under 20 characters or without a chunk are left out."""
    return _tables(_kept(docs, config, entities))


def _kept(docs: DataFrame, config: EngineConfig, entities: bool) -> DataFrame:
    rows = parsed(docs.where(F.length(filled(F.col("text"))) >= LEAST_CHARS), config, entities).where(F.size("chunks") > 0)
    return rows.withColumn("content_hash", content_hash(F.col("text")))


def _tables(rows: DataFrame) -> Index:
    documents = rows.select("doc_id", "path", "rel_path", "title", "ext", "mtime", "size", "content_hash")
    paras = rows.select("doc_id", F.inline("paras"))
    parts = rows.select("doc_id", "title", "rel_path", F.inline("chunks")).withColumn("terms", terms_text(F.col("text")))
    return Index(documents, paras, parts)


def write_index(docs: DataFrame, folder: str, config: EngineConfig = EngineConfig(), entities: bool = True) -> Index:
    """build_index() written below ``folder``; texts are parsed once, into a table that the three others are made from."""
    rows = _kept(docs, config, entities).drop("text")
    rows.write.mode("overwrite").parquet(f"{folder}/parsed")
    return _tables(docs.sparkSession.read.parquet(f"{folder}/parsed")).write(folder)


def index_stats(docs: DataFrame, config: EngineConfig = EngineConfig(), entities: bool = True) -> DataFrame:
    """One row: doc_count, paragraph_count, chunk_count, skipped_count."""
    rows = parsed(docs, config, entities).select(
        ((F.length(filled(F.col("text"))) >= LEAST_CHARS) & (F.size("chunks") > 0)).alias("kept"), F.size("paras").alias("p"), F.size("chunks").alias("c"))
    total = lambda v: F.coalesce(F.sum(F.when(F.col("kept"), v)), F.lit(0)).cast("long")
    return rows.agg(total(F.lit(1)).alias("doc_count"), total(F.col("p")).alias("paragraph_count"), total(F.col("c")).alias("chunk_count"), F.count_if(~F.col("kept")).alias("skipped_count"))


def sync_actions(files: DataFrame, index: DataFrame) -> DataFrame:
    """(path, action) by the first rule that fits: removed, unchanged, skipped, added, updated.

    files: path, mtime, size, content_hash, readable (20 characters and a chunk at least).
    index: path, mtime, size, content_hash, paragraph_count.
    A file of unchanged time and size is not looked into, but for an index without its
    paragraphs; a file that can no longer be read leaves the index and counts as skipped.
    """
    joined = files.alias("f").join(index.alias("i"), "path", "full_outer")
    indexed, present = F.col("i.mtime").isNotNull(), F.col("f.mtime").isNotNull()
    whole = F.coalesce(F.col("i.paragraph_count"), F.lit(0)) > 0
    same_stat = (F.col("f.mtime") == F.col("i.mtime")) & (F.col("f.size") == F.col("i.size"))
    same_text = F.col("f.content_hash") == F.col("i.content_hash")
    action = (
        F.when(~present, "removed").when(indexed & same_stat & whole, "unchanged").when(~F.col("f.readable"), "skipped")
        .when(indexed & same_text & whole, "unchanged").when(indexed, "updated").otherwise("added")
    )
    return joined.select("path", action.alias("action"), indexed.alias("was_indexed"))


def sync_stats(actions: DataFrame) -> DataFrame:
    """One row of counts; a skipped file that was indexed counts as removed too, and skipped files count as a change."""
    n = lambda c: F.count_if(c)
    a = F.col("action")
    out = actions.agg(
        n(a == "added").alias("added_count"), n(a == "updated").alias("updated_count"),
        n((a == "removed") | ((a == "skipped") & F.col("was_indexed"))).alias("removed_count"),
        n(a == "unchanged").alias("unchanged_count"), n(a == "skipped").alias("skipped_count"))
    return out.withColumn("changed", (F.col("added_count") + F.col("updated_count") + F.col("removed_count") + F.col("skipped_count")) > 0)


def sync_index(docs: DataFrame, index: Index, config: EngineConfig = EngineConfig(), entities: bool = True) -> tuple[Index, DataFrame]:
    """The index after a run over the current documents, and its actions; write it to a new folder, then swap.

    Documents of unchanged time and size are told by those alone; only the texts of the others are read and parsed.
    """
    counts = index.paragraphs.groupBy("doc_id").agg(F.count("*").alias("paragraph_count"))
    known = index.documents.join(counts, "doc_id", "left").select("path", "mtime", "size", "content_hash", "paragraph_count")
    same = docs.select("path", "mtime", "size").join(known.where("paragraph_count > 0").select("path", "mtime", "size"), ["path", "mtime", "size"], "left_semi")
    rest = docs.join(same.select("path"), "path", "left_anti")
    rows = parsed(rest, config, entities).withColumn("content_hash", content_hash(F.col("text")))
    looked = rows.select("path", "mtime", "size", "content_hash", ((F.length(filled(F.col("text"))) >= LEAST_CHARS) & (F.size("chunks") > 0)).alias("readable"))
    files = looked.unionByName(same.withColumns({"content_hash": F.lit(None).cast("string"), "readable": F.lit(None).cast("boolean")}))
    actions = sync_actions(files, known)
    keep = actions.where("action = 'unchanged'").select("path")
    old = index.documents.join(keep, "path", "left_semi")
    stat = docs.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    old_docs = old.join(stat, "path").withColumns({"mtime": F.col("_m"), "size": F.col("_s")}).select(index.documents.columns)
    new = build_index(rest.join(actions.where("action in ('added', 'updated')").select("path"), "path", "left_semi"), config, entities)
    ids = old.select("doc_id")
    add = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    merged = Index(add(old_docs, new.documents), add(index.paragraphs.join(ids, "doc_id", "left_semi"), new.paragraphs), add(index.chunks.join(ids, "doc_id", "left_semi"), new.chunks))
    return merged, actions


def index_status(files: DataFrame, index: Index) -> DataFrame:
    """One row: what is indexed, and whether the files have moved on."""
    f, i = files.select("path", "mtime", "size"), index.documents.select("path", "mtime", "size")
    both = f.alias("f").join(i.alias("i"), "path", "full_outer")
    changed = F.col("f.mtime").isNotNull() & (F.col("i.mtime").isNull() | (F.col("f.mtime") != F.col("i.mtime")) | (F.col("f.size") != F.col("i.size")))
    diff = both.agg(
        F.count_if(F.col("f.mtime").isNotNull()).alias("file_count"), F.count_if(F.col("i.mtime").isNotNull()).alias("indexed_documents"),
        F.count_if(changed).alias("new_or_changed_files"), F.count_if(F.col("f.mtime").isNull()).alias("removed_files"))
    counts = index.chunks.agg(F.count("*").alias("indexed_chunks")).crossJoin(index.paragraphs.agg(F.count("*").alias("indexed_paragraphs")))  # one row each
    return diff.crossJoin(counts).withColumn("is_stale", (F.col("new_or_changed_files") + F.col("removed_files")) > 0)
