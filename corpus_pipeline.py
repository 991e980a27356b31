"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but
the last return the columns of ``documents``.  SQL cannot express these stages; the tests
hold them against brute force.  Every stage keeps extra columns, takes empty tables (and gives empty ones), and
treats ties and repeated rows as the operator that it calls says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, jaccard_join, packing, substring_dedup, toxicity
from lodestone.llm.kit import Scratch, read

ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go; empty and null texts stay, whatever their ids are."""
    return toxicity.reject_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; texts that share an id, or have none, are documents of their own.

    Word-less texts are one group.
    """
    return jaccard_join.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go, from the text that they were found in; a document with nothing else goes."""
    return substring_dedup.remove_passages(docs, substring_dedup.passages(docs))


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, and no others of their id; without a benchmark all stay."""
    return decontaminate.remove_leaks(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 4096; an empty text is one piece of its end id."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_each),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", remove_leaks),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each one returns is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = scratch.table(stage(spark, docs, sf_dir), name)
        if hasattr(docs, "_scratch_path"):
            scratch.drop(docs)
        docs = done
    return docs
