"""The driver tables read as the engine's inputs."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.classify import detect_resource_intent
from lodestone.functions.text import clean_snippet, html_title, sub
from lodestone.operators.index import Index, write_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; one in fewer pieces than there are cores is dealt out, as parsing its texts is the work."""
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return t.repartition(cores) if name in ("documents", "pages") and t.rdd.getNumPartitions() < cores else t


def kb_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of a knowledge base: title is the source, the path source/doc_id."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string"))
    return d.select(
        "doc_id", F.concat(F.lit("file:///"), path).alias("path"), path.alias("rel_path"), F.col("source").alias("title"), F.lit(".txt").alias("ext"),
        F.col("n_chars").cast("double").alias("mtime"), F.col("n_chars").alias("size"), "text")


def stored_index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of all documents, written to the folder that the cluster shares and dropped at exit.

    Read back, no text is parsed again for each use of a table.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    shared = shared or "file://" + tempfile.mkdtemp(prefix="lodestone-")
    folder = f"{shared.rstrip('/')}/lodestone-index-{uuid.uuid4().hex[:12]}"
    atexit.register(_drop, spark, folder)
    return write_index(kb_documents(spark, sf_dir), folder, entities=False)


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  at exit the JVM may be gone already
        pass


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question): what the user says first in each conversation."""
    c = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    return c.groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("text", F.struct("turn", "text")).alias("question"))


#: What the tables' questions lack, so that every rule of the classifiers, rewriters and filters meets a case.
PHRASES = (
    "帮我找几篇关于 transformer 的论文", "有没有开源的 GitHub 项目，可以获取 ChatGPT 服务降级风险等级、深度研究 和 Codex 用量 信息，最新一次提交 三周之前", "最新版本的 pytorch 价格 是多少 2024",
    "Docker 安装 教程", "Python 报错 Traceback 怎么解决", "官方 API 文档 在哪里", "GPU vs TPU 有什么区别", "推荐 哪个好 framework", "RAG", "微调",
    "marx labor process three basic elements correct answer", "see https://github.com/a/b.git and (http://www.example.org/x?y=1).", "什么是 Kubernetes", "Codex 是什么工具", "如何使用 LangChain",
    "vLLM 的 论文", "查找 源码 仓库 llama.cpp", "获取 Codex 用量 数据 的 开源 项目 两周前 提交", "python 3.12 release changelog compatibility", "how to fix CUDA error 700 in PyTorch", "compare A100 and H100 for LLM inference benchmark paper",
    "找 开源 项目 一个月前 提交 查看 使用量",
)
#: Hosts that pages are moved to in turn, so that every type of source occurs; None leaves a page where it is.
HOSTS = ("github.com", "arxiv.org", "docs.python.org", "www.zhihu.com", "en.wikipedia.org", "www.nasa.gov", "cs.mit.edu", "huggingface.co", "readthedocs.io", None, None, None, "openreview.net")
DATED, NEGATIVE = '<meta property="article:published_time" content="2024-03-05T10:00">', "<p>This is a known issue and deprecated.</p>"


def in_turn(number: Column, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions, in turn as they are, with a phrase of PHRASES behind, and that phrase alone."""
    q, phrase = F.col("question"), in_turn(F.col("qid"), PHRASES)
    return questions(spark, sf_dir).withColumn("question", F.when(F.col("qid") % 3 == 0, phrase).when(F.col("qid") % 3 == 1, F.concat(q, F.lit(" "), phrase)).otherwise(q))


def seen_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, some on other hosts, some with a stated date or a word of warning."""
    host, i = in_turn(F.col("page_id"), HOSTS), F.col("page_id") % 5
    url = F.when(host.isNull(), F.col("url")).otherwise(F.regexp_replace("url", "^([A-Za-z]+)://[^/?#]*", F.concat(F.lit("$1://"), host)))
    html = F.when(i == 0, F.concat(F.lit(DATED), "html")).when(i == 1, F.concat(F.lit(NEGATIVE), "html")).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").withColumns({"url": url, "html": html})


def page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as web hits: five in a row belong to the question of one conversation."""

    p = seen_pages(spark, sf_dir).withColumn("qid", F.expr("page_id div 5"))
    h = p.select("qid", F.col("page_id").alias("pos"), html_title(F.col("html"), False).alias("title"), "url", clean_snippet(sub(F.col("html"), "<[^>]+>", " ")).alias("content"))
    h = h.join(asked(spark, sf_dir), "qid").withColumn("resource_intent", detect_resource_intent(F.col("question")))
    return h.withColumns({"snippet": F.lit(""), "matched_query": F.col("question"), "source_type": F.lit(None).cast("string"), "kb_score": F.lit(None).cast("double")})
