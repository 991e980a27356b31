"""Keyword search of chunks for a set of questions at once, and the evidence of each hit.

Questions are a stated set, searched block by block: a block is one scan of the chunks, and the driver makes a plan
for each.  A chunk is scored for all questions of a block in one pass: an Aho-Corasick automaton over
all their terms and phrases finds every substring, and each term adds to the questions that have it.  Each
task keeps its best ``limit`` chunks of each question, which holds every chunk of the final
top; so what is shuffled is tasks x questions x limit small rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.rewrite import expand_kb_query
from lodestone.functions.score import chunk_score
from lodestone.functions.text import clean_kb, filled, format_location, let, strip, sub
from lodestone.functions.tokens import kb_terms, terms_text
from lodestone.sources.batches import bound

#: Questions that one automaton holds; more are searched block by block.
BLOCK = 2000
QUERY_TERMS = 28
_HIT = "qid long, doc_id long, chunk_index int, score double"


def query_rows(queries: DataFrame) -> DataFrame:
    """(qid, phrase, terms) of (qid, query); queries without a term find nothing and go."""
    rows = queries.select("qid", strip(filled(F.col("query"))).alias("query"))
    terms = F.slice(kb_terms(F.col("query")), 1, QUERY_TERMS)
    return rows.select("qid", "query", F.lower("query").alias("phrase"), terms.alias("terms")).where("size(terms) > 0")


class Scorer:
    """Scores of a block of questions for one chunk after another.

    What is held is the questions' terms, once for each use: a term's questions are a slice of ``uses``.
    """

    def __init__(self, rows: list[tuple[int, str, list[str]]]):
        self.qids = np.array([r[0] for r in rows], np.int64)
        self.terms = sorted({t for _, _, ts in rows for t in ts})
        number = {t: i for i, t in enumerate(self.terms)}
        term = np.array([number[t] for _, _, ts in rows for t in ts], np.int64)
        question = np.repeat(np.arange(len(rows)), [len(ts) for _, _, ts in rows])
        order = np.argsort(term, kind="stable")
        self.uses = question[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.sizes = np.maximum(np.bincount(question, minlength=len(rows)), 1)
        self.factor = np.array([1.0 + min(len(t), 12) / 18.0 for t in self.terms])
        # A term that overlaps itself is counted by str.count; for the rest every match counts.
        self.overlaps = {i for t, i in number.items() if any(t.endswith(t[:n]) for n in range(1, len(t)))}
        phrases: dict[str, list[int]] = {}
        for q, (_, phrase, _) in enumerate(rows):
            if len(phrase) >= 3:
                phrases.setdefault(phrase, []).append(q)
        self.phrases = list(phrases.values())
        self.machine = ahocorasick.Automaton()
        both: dict[str, list[int]] = {t: [i] for t, i in number.items()}
        for j, p in enumerate(phrases):
            both.setdefault(p, []).append(-1 - j)
        for word, marks in both.items():
            self.machine.add_word(word, tuple(marks))
        if both:
            self.machine.make_automaton()

    def found(self, text: str) -> Counter:
        if not len(self.machine):
            return Counter()
        return Counter(m for _, marks in self.machine.iter(text) for m in marks)

    def score(self, title: str, path: str, text: str, blob: str) -> np.ndarray:
        hit: dict[int, int] = {}
        phrase = np.zeros(len(self.qids))
        inside, named = self.found(text), set()
        for points, part in ((5, title), (3, path), (2, blob)):
            for m in self.found(part):
                if m >= 0:
                    hit[m] = hit.get(m, 0) + points
                elif points > 2:
                    named.add(m)
        for m, n in inside.items():
            if m >= 0:
                hit[m] = hit.get(m, 0) + min(6, 1 + (text.count(self.terms[m]) if m in self.overlaps else n))
            else:
                phrase[self.phrases[-1 - m]] += 9.0
        for m in named:
            phrase[self.phrases[-1 - m]] += 8.0
        at = np.array(sorted(hit), np.int64)
        size = self.first[at + 1] - self.first[at]
        where = np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        asked = self.uses[where]
        points = np.repeat(np.array([hit[m] for m in at.tolist()], np.float64) * self.factor[at], size)
        n = len(self.qids)
        return np.round(phrase + np.bincount(asked, points, n) + np.bincount(asked, minlength=n) / self.sizes * 8.0, 3)


def _local_best(rows: list[tuple], limit: int, least: float):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(rows)
        best: list[list[tuple]] = [[] for _ in rows]

        def shrink(q: int) -> None:
            best[q] = sorted(best[q])[:limit]

        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("doc_id", "chunk_index", "title", "rel_path", "text", "terms"))
            for doc, index, title, path, text, blob in zip(*columns):
                lower = [(x or "").lower() for x in (title, path, text, blob)]
                scores = scorer.score(*lower)
                for q in np.flatnonzero(scores >= least).tolist():
                    held = best[q]
                    held.append((-scores[q], doc, index))
                    if len(held) >= 4 * limit + 16:
                        shrink(q)
        out = []
        for q, held in enumerate(best):
            out += [(int(scorer.qids[q]), doc, index, float(-s)) for s, doc, index in sorted(held)[:limit]]
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=["qid", "doc_id", "chunk_index", "score"])

    return build


def search_chunks(chunks: DataFrame, queries: DataFrame, limit: int = 8, min_score: float = 1.0) -> DataFrame:
    """(qid, rank, doc_id, chunk_index, score): the best chunks of each (qid, query), ties by document and chunk.

    chunks: doc_id, chunk_index, title, rel_path, text, terms.  One scan; what is shuffled is each
    task's best chunks.
    """
    bound(chunks.sparkSession)
    full = chunks.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("chunk_index").cast("int").alias("chunk_index"), "title", "rel_path", "text", "terms")
    found, block = None, []

    def run(rows: list[tuple]) -> DataFrame:
        return full.mapInArrow(_local_best(rows, limit, min_score), _HIT)

    for r in query_rows(queries).orderBy("qid").toLocalIterator():  # a stated set of questions, block by block
        block.append((r["qid"], r["phrase"], list(r["terms"])))
        if len(block) == BLOCK:
            found, block = run(block) if found is None else found.union(run(block)), []
    if block or found is None:
        found = run(block) if found is None else found.union(run(block))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id", "chunk_index")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("qid", "rank", "doc_id", "chunk_index", "score")


# ------------------------------------------------------------------ paragraph evidence

ANSWER_MARK = r"(?i)^(A|B|C|D|E|F)[.．、:：]|正确答案|我的答案|答案解析"


def _chosen(rows: Column) -> Column:
    """rows: array<struct<paragraph_index, text, page_number, score>> of one hit, by paragraph."""
    top = F.array_max(F.transform(rows, lambda r: r["score"]))
    best = F.element_at(F.filter(rows, lambda r: r["score"] == top), 1)

    def grow(best: Column) -> Column:
        near = F.filter(rows, lambda r: r["paragraph_index"].between(best["paragraph_index"] + 1, best["paragraph_index"] + 4))
        start = F.struct(best["text"].alias("joined"), best["paragraph_index"].alias("last"))

        def take(acc: Column, r: Column) -> Column:
            fits = strip(r["text"]).rlike(ANSWER_MARK) | ((F.length(acc["joined"]) < 420) & (F.length(r["text"]) < 80))
            return F.when(fits, F.struct(F.concat(acc["joined"], F.lit("\n"), r["text"]).alias("joined"), r["paragraph_index"].alias("last"))).otherwise(acc)

        grown = F.aggregate(near, start, take)
        quote = lambda g: clean_kb(g["joined"], False)
        cut = lambda t: F.when(F.length(t) > 720, F.concat(sub(F.substring(t, 1, 700), r"\s+$"), F.lit("..."))).otherwise(t)
        return let(lambda g: F.struct(best["paragraph_index"].alias("paragraph_start"), g["last"].alias("paragraph_end"), let(cut, quote(g)).alias("quote"), best["page_number"].alias("page_number")), grown)

    return let(grow, best)


def paragraph_evidence(hits: DataFrame, paragraphs: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits (qid, doc_id, chunk_index, paragraph_start, paragraph_end) with the best paragraph of each and the short answers after it.

    Hits are joined once and carried through the grouping, so whatever found them runs once.
    """
    asked = query_rows(queries).select("qid", "query", "terms")
    p = paragraphs.select(F.col("doc_id").alias("_d"), F.col("paragraph_index").alias("_i"), F.col("text").alias("_t"), F.col("page_number").alias("_p"))
    inside = hits.join(p, (F.col("doc_id") == F.col("_d")) & F.col("_i").between(F.col("paragraph_start"), F.col("paragraph_end")), "left").join(asked, "qid", "left")
    score = chunk_score(F.col("terms"), F.col("query"), F.lit(""), F.lit(""), F.lower("_t"), terms_text(F.col("_t")))
    row = F.struct(F.col("_i").alias("paragraph_index"), F.col("_t").alias("text"), F.col("_p").alias("page_number"), score.alias("score"))
    kept = [c for c in hits.columns if c not in ("paragraph_start", "paragraph_end")]
    rows = inside.groupBy(*kept).agg(F.sort_array(F.collect_list(F.when(F.col("_i").isNotNull(), row))).alias("rows"))  # the paragraphs of one chunk
    none = F.lit(None).cast("struct<paragraph_start:int,paragraph_end:int,quote:string,page_number:int>")
    return rows.select(*kept, F.when(F.size("rows") > 0, _chosen(F.col("rows"))).otherwise(none).alias("_e")).select(*kept, "_e.*")


def search_documents(index, queries: DataFrame, limit: int = 8, min_score: float = 1.0) -> DataFrame:
    """Hits with title, url, content, quote and location, as a search page shows them."""
    hits = search_chunks(index.chunks, queries, limit, min_score)
    full = hits.join(index.chunks.select("doc_id", "chunk_index", "text", "paragraph_start", "paragraph_end", "char_start", "char_end"), ["doc_id", "chunk_index"])
    shown = paragraph_evidence(full, index.paragraphs, queries).join(index.documents.select("doc_id", "path", "rel_path", "ext", "mtime"), "doc_id")
    content = F.substring(clean_kb(F.col("text"), False), 1, 1400)
    quote = F.when(filled(F.col("quote")) != "", F.col("quote")).otherwise(F.substring(content, 1, 520))
    return shown.join(queries.select("qid", strip(filled(F.col("query"))).alias("matched_query")), "qid").select(
        "qid", "rank", F.concat(F.lit("本地知识库："), F.col("rel_path")).alias("title"), F.col("path").alias("url"), content.alias("content"), F.lit("local_kb").alias("source_type"), "matched_query",
        F.col("doc_id").alias("kb_doc_id"), F.col("chunk_index").alias("kb_chunk_index"), F.col("score").alias("kb_score"), F.col("rel_path").alias("kb_path"), F.col("ext").alias("kb_ext"),
        F.col("paragraph_start").alias("kb_paragraph_start"), F.col("paragraph_end").alias("kb_paragraph_end"), F.col("char_start").alias("kb_char_start"), F.col("char_end").alias("kb_char_end"),
        format_location(F.col("rel_path"), F.col("paragraph_start"), F.col("paragraph_end"), F.col("page_number")).alias("kb_location"), quote.alias("kb_quote"),
        F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd").alias("published_at"),
    )


def kb_queries(questions: DataFrame, most: int = 4) -> DataFrame:
    """(qid, query_pos, query): question, search query and translated terms of each question, distinct, at most ``most``."""
    expanded = expand_kb_query(F.col("question"))
    every = F.array_compact(F.array(strip(filled(F.col("question"))), strip(filled(F.col("search_query"))), expanded))
    return questions.select("qid", F.posexplode(F.slice(F.array_distinct(F.filter(every, lambda q: q != "")), 1, most)).alias("query_pos", "query"))


def collect_hits(hits: DataFrame, limit: int = 8) -> DataFrame:
    """Hits of a question's queries one query after another, each chunk once, cut to ``limit``; not sorted by score again.

    hits: qid, query_pos, rank, doc_id, chunk_index and more.
    """
    once = Window.partitionBy("qid", "doc_id", "chunk_index").orderBy("query_pos", "rank")
    order = Window.partitionBy("qid").orderBy("query_pos", "rank")
    first = hits.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    return first.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)


def local_is_enough(hits: DataFrame, results: int = 4, score: float = 8.0) -> DataFrame:
    """(qid, enough): whether a question's local hits make a web search needless."""
    return hits.groupBy("qid").agg(((F.count("*") >= results) & (F.max("score") >= score)).alias("enough"))
