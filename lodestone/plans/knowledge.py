"""Queries over the documents as a knowledge base."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.tokens import kb_terms
from lodestone.operators import index as I
from lodestone.operators.search import collect_hits, local_is_enough, search_chunks, search_documents
from lodestone.operators.split import explode_chunks, explode_paragraphs, normalize_blocks, passages, text_blocks
from lodestone.plans import duck as D
from lodestone.plans.catalog import register
from lodestone.plans.inputs import benchmark_queries, kb_documents, stored_index, table
from lodestone.sources.files import text_or_error

# Paragraph texts by the three-step split, with spans found one after another from a cursor.
_PARAGRAPHS = f"""
cleaned AS (SELECT doc_id, source, text, {D.clean_kb('text')} AS c FROM documents),
steps AS (SELECT *, {D.pieces("regexp_split_to_array(c, '" + chr(92) + "n" + D.WS + "*" + chr(92) + "n+')")} AS blank, {D.pieces("regexp_split_to_array(c, '" + chr(92) + "n+')")} AS by_line, {D.pieces(D.sentences('c'))} AS by_end FROM cleaned),
parts AS (SELECT doc_id, source, text, c, CASE WHEN c = '' THEN [] WHEN len(blank) > 1 THEN blank WHEN len(by_line) > 1 THEN by_line WHEN length(c) > 900 THEN by_end ELSE by_line END AS p FROM steps),
placed AS (
  SELECT doc_id, c, p, 0 AS i, 0 AS cursor, 0 AS a FROM parts
  UNION ALL
  SELECT doc_id, c, p, i + 1, off + length(p[i + 1]), off FROM (
    SELECT doc_id, c, p, i, CASE WHEN strpos(substr(c, cursor + 1), p[i + 1]) > 0 THEN cursor + strpos(substr(c, cursor + 1), p[i + 1]) - 1 ELSE cursor END AS off FROM placed WHERE i < len(p))
),
paras AS (SELECT doc_id, i AS paragraph_index, p[i] AS text, a AS char_start, cursor AS char_end FROM placed WHERE i > 0)"""

# Packing walks over paragraphs; flushing is a change of ``start``.
_CHUNKS = (
    _PARAGRAPHS
    + f""",
packed AS (
  SELECT doc_id, 1 AS i, CASE WHEN length(text) > 1500 THEN 0 ELSE length(text) END AS n, 1 AS start FROM paras WHERE paragraph_index = 1
  UNION ALL
  SELECT k.doc_id, k.i + 1,
    CASE WHEN length(t.text) > 1500 THEN 0 WHEN k.n > 0 AND k.n + length(t.text) + 2 <= 1000 THEN k.n + length(t.text) + 2 ELSE length(t.text) END,
    CASE WHEN length(t.text) <= 1500 AND k.n > 0 AND k.n + length(t.text) + 2 <= 1000 THEN k.start ELSE k.i + 1 END
  FROM packed k JOIN paras t ON t.doc_id = k.doc_id AND t.paragraph_index = k.i + 1
),
whole AS (
  SELECT k.doc_id, k.start AS a, max(k.i) AS b, string_agg(t.text, chr(10) || chr(10) ORDER BY k.i) AS joined, min(t.char_start) AS s, max(t.char_end) AS e
  FROM packed k JOIN paras t ON t.doc_id = k.doc_id AND t.paragraph_index = k.i WHERE k.n > 0 GROUP BY 1, 2
),
sliced AS (SELECT doc_id, paragraph_index, off, {D.strip('substr(text, CAST(off + 1 AS BIGINT), 1000)')} AS part, char_start FROM (SELECT *, unnest(range(0, length(text), 840)) AS off FROM paras WHERE length(text) > 1500)),
made AS (
  SELECT doc_id, a, b, 0 AS off, {D.clean_kb('joined')} AS text, s AS char_start, e AS char_end, 40 AS least FROM whole
  UNION ALL
  SELECT doc_id, paragraph_index, paragraph_index, off, part, char_start + off, char_start + off + length(part), 80 FROM sliced
),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, off) - 1 AS chunk_index, text, a AS paragraph_start, b AS paragraph_end, char_start, char_end FROM made WHERE length(text) >= least)"""
)


@register("kb_paragraphs", f"WITH RECURSIVE {_PARAGRAPHS} SELECT doc_id, CAST(paragraph_index AS INTEGER) AS paragraph_index, text, CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end FROM paras")
def kb_paragraphs(spark, sf_dir):
    return explode_paragraphs(table(spark, sf_dir, "documents"), False).drop("page_number")


@register("kb_chunks", f"""WITH RECURSIVE {_CHUNKS} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, text, CAST(paragraph_start AS INTEGER) AS paragraph_start, CAST(paragraph_end AS INTEGER) AS paragraph_end,
CAST(char_start AS INTEGER) AS char_start, CAST(char_end AS INTEGER) AS char_end, array_to_string(list_slice({D.kb_terms('text')}, 1, 900), ' ') AS terms FROM chunks""")
def kb_chunks(spark, sf_dir):
    return explode_chunks(table(spark, sf_dir, "documents"), entities=False)


@register("kb_terms", f"SELECT doc_id, array_to_string({D.kb_terms('text')}, ' ') AS terms, CAST(len({D.kb_terms('text')}) AS INTEGER) AS n_terms FROM documents")
def kb_terms_query(spark, sf_dir):
    terms = kb_terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(terms, " ").alias("terms"), F.size(terms).alias("n_terms"))


@register("kb_index_stats", f"""WITH RECURSIVE {_CHUNKS},
counts AS (SELECT d.doc_id, length(d.text) >= 20 AND c.n > 0 AS kept, coalesce(p.n, 0) AS p, coalesce(c.n, 0) AS c FROM documents d
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM paras GROUP BY 1) p USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) c USING (doc_id))
SELECT count(*) FILTER (kept) AS doc_count, CAST(coalesce(sum(p) FILTER (kept), 0) AS BIGINT) AS paragraph_count, CAST(coalesce(sum(c) FILTER (kept), 0) AS BIGINT) AS chunk_count, count(*) FILTER (kept IS NOT TRUE) AS skipped_count FROM counts""")
def kb_index_stats(spark, sf_dir):
    return I.index_stats(kb_documents(spark, sf_dir), entities=False)


# The score, term by term over every chunk and question.
_SEARCH = f"""WITH RECURSIVE {_CHUNKS},
queries AS (SELECT item_id AS qid, lower({D.strip(D.filled('text'))}) AS phrase, list_slice({D.kb_terms(D.strip(D.filled('text')))}, 1, 28) AS terms FROM benchmark),
body AS (SELECT c.doc_id, c.chunk_index, lower(d.source) AS title, lower(d.source || '/' || d.doc_id) AS path, lower(c.text) AS text, array_to_string(list_slice({D.kb_terms('c.text')}, 1, 900), ' ') AS blob FROM chunks c JOIN documents d USING (doc_id)),
hits AS (
  SELECT qid, doc_id, chunk_index, len(terms) AS n, phrase, title, path, text,
    list_filter(list_transform(terms, lambda t: {{'t': t, 'h': (CASE WHEN contains(title, t) THEN 5 ELSE 0 END) + (CASE WHEN contains(path, t) THEN 3 ELSE 0 END) + (CASE WHEN contains(blob, t) THEN 2 ELSE 0 END)
      + (CASE WHEN contains(text, t) THEN least(6, 1 + (length(text) - length(replace(text, t, ''))) // length(t)) ELSE 0 END)}}), lambda x: x.h > 0) AS found
  FROM body, queries WHERE len(terms) > 0
),
scored AS (
  SELECT qid, doc_id, chunk_index, round(
    (CASE WHEN length(phrase) >= 3 AND contains(text, phrase) THEN 9 ELSE 0 END) + (CASE WHEN length(phrase) >= 3 AND (contains(title, phrase) OR contains(path, phrase)) THEN 8 ELSE 0 END)
    + coalesce(list_sum(list_transform(found, lambda x: x.h * (1.0::DOUBLE + least(length(x.t), 12) / 18.0::DOUBLE))), 0) + len(found) / n::DOUBLE * 8, 3) AS score FROM hits
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, chunk_index) AS rank FROM scored WHERE score >= 1)
SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, score FROM ranked WHERE rank <= 8"""


@register("kb_search_topk", _SEARCH)
def kb_search_topk(spark, sf_dir):
    chunks = explode_chunks(kb_documents(spark, sf_dir), entities=False, keep=("title", "rel_path"))
    return search_chunks(chunks, benchmark_queries(spark, sf_dir))


@register("kb_collected_hits", f"""{_SEARCH.split('SELECT qid, CAST(rank AS INTEGER)')[0].rstrip()},
top AS (SELECT qid // 4 AS question, qid % 4 AS query_pos, rank, doc_id, chunk_index, score FROM ranked WHERE rank <= 8),
once AS (SELECT *, row_number() OVER (PARTITION BY question, doc_id, chunk_index ORDER BY query_pos, rank) AS n FROM top),
gathered AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY query_pos, rank) AS pos FROM once WHERE n = 1)
SELECT question AS qid, CAST(pos AS INTEGER) AS pos, doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, score FROM gathered WHERE pos <= 8""")
def kb_collected_hits(spark, sf_dir):
    """Four benchmark queries in a row as the queries of one question: their hits one after another, each chunk once."""
    hits = kb_search_topk(spark, sf_dir).withColumn("query_pos", F.col("qid") % 4).withColumn("qid", F.expr("qid div 4"))
    return collect_hits(hits).select("qid", "pos", "doc_id", "chunk_index", "score")


@register("kb_chunk_scan", f"""WITH RECURSIVE {_CHUNKS} SELECT c.doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, source AS title, source || '/' || c.doc_id AS rel_path, CAST(length(c.text) AS INTEGER) AS n,
source || '/' || c.doc_id || CASE WHEN paragraph_start = paragraph_end THEN '，第 ' || paragraph_start || ' 段' ELSE '，第 ' || paragraph_start || '–' || paragraph_end || ' 段' END AS location FROM chunks c JOIN documents d USING (doc_id)""")
def kb_chunk_scan(spark, sf_dir):
    """Every chunk with its document's title and path, and where it stands."""
    c = explode_chunks(kb_documents(spark, sf_dir), entities=False, keep=("title", "rel_path"))
    where = X.format_location(F.col("rel_path"), F.col("paragraph_start"), F.col("paragraph_end"), F.lit(None).cast("int"))
    return c.select("doc_id", "chunk_index", "title", "rel_path", F.length("text").alias("n"), where.alias("location"))


@register("kb_paragraph_counts", f"WITH RECURSIVE {_PARAGRAPHS} SELECT doc_id, count(*) AS n_paragraphs, CAST(max(length(text)) AS INTEGER) AS longest FROM paras GROUP BY doc_id")
def kb_paragraph_counts(spark, sf_dir):
    return explode_paragraphs(table(spark, sf_dir, "documents"), False).groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.max(F.length("text")).alias("longest"))


@register("kb_local_enough", f"""{_SEARCH.split('SELECT qid, CAST(rank AS INTEGER)')[0]} SELECT qid, count(*) >= 4 AND max(score) >= 8 AS enough FROM ranked WHERE rank <= 8 GROUP BY qid""")
def kb_local_enough(spark, sf_dir):
    """Whether the local hits of each benchmark query make a web search needless."""
    return local_is_enough(kb_search_topk(spark, sf_dir))


@register("kb_search_hits")
def kb_search_hits(spark, sf_dir):
    """Hits as a page shows them, with the best paragraphs of each."""
    return search_documents(stored_index(spark, sf_dir), benchmark_queries(spark, sf_dir))


@register("content_hashes", "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


def _snapshots(spark, sf_dir):
    """Files: all documents.  Index: the labelled ones as they were; a low quality one had another size, a toxic one another text, and some are gone."""
    d, labels = kb_documents(spark, sf_dir), table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    files = d.select("path", "mtime", "size", X.content_hash(F.col("text")).alias("content_hash"), (F.length(X.filled(F.col("text"))) >= 20).alias("readable"))
    old = d.join(labels, "doc_id").select(
        F.when(F.col("quality") + F.col("toxic") == 2, F.concat("path", F.lit("-old"))).otherwise(F.col("path")).alias("path"), "mtime", F.when(F.col("quality") == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        X.content_hash(F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"), F.lit(1).cast("long").alias("paragraph_count"))
    return files, old


_SNAPSHOTS = """
files AS (SELECT 'file:///' || source || '/' || doc_id AS path, n_chars AS mtime, n_chars AS size, sha256(coalesce(text, '')) AS h, length(coalesce(text, '')) >= 20 AS readable FROM documents),
marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
old AS (SELECT 'file:///' || source || '/' || doc_id || CASE WHEN quality + toxic = 2 THEN '-old' ELSE '' END AS path, n_chars AS mtime, CASE WHEN quality = 0 THEN n_chars + 1 ELSE n_chars END AS size,
  sha256(CASE WHEN toxic = 1 THEN text || '!' ELSE coalesce(text, '') END) AS h FROM documents JOIN marks USING (doc_id)),
actions AS (SELECT coalesce(f.path, o.path) AS path, o.path IS NOT NULL AS was_indexed, CASE WHEN f.path IS NULL THEN 'removed' WHEN f.mtime = o.mtime AND f.size = o.size THEN 'unchanged' WHEN NOT f.readable THEN 'skipped'
  WHEN f.h = o.h THEN 'unchanged' WHEN o.path IS NOT NULL THEN 'updated' ELSE 'added' END AS action FROM files f FULL JOIN old o ON f.path = o.path)"""


@register("kb_sync_actions", f"WITH {_SNAPSHOTS} SELECT path, action, was_indexed FROM actions")
def kb_sync_actions(spark, sf_dir):
    return I.sync_actions(*_snapshots(spark, sf_dir))


@register("kb_sync_stats", f"""WITH {_SNAPSHOTS}, c AS (SELECT count(*) FILTER (action = 'added') AS added_count, count(*) FILTER (action = 'updated') AS updated_count,
count(*) FILTER (action = 'removed' OR action = 'skipped' AND was_indexed) AS removed_count, count(*) FILTER (action = 'unchanged') AS unchanged_count, count(*) FILTER (action = 'skipped') AS skipped_count FROM actions)
SELECT *, added_count + updated_count + removed_count + skipped_count > 0 AS changed FROM c""")
def kb_sync_stats(spark, sf_dir):
    return I.sync_stats(I.sync_actions(*_snapshots(spark, sf_dir)))


@register("kb_status", f"""WITH RECURSIVE {_CHUNKS},
kept AS (SELECT doc_id, n_chars FROM documents WHERE length(coalesce(text, '')) >= 20 AND doc_id IN (SELECT doc_id FROM chunks))
SELECT (SELECT count(*) FROM documents) AS file_count, (SELECT count(*) FROM kept) AS indexed_documents, (SELECT count(*) FROM documents) - (SELECT count(*) FROM kept) AS new_or_changed_files, 0::BIGINT AS removed_files,
(SELECT count(*) FROM chunks SEMI JOIN kept USING (doc_id)) AS indexed_chunks, (SELECT count(*) FROM paras SEMI JOIN kept USING (doc_id)) AS indexed_paragraphs, (SELECT count(*) FROM documents) > (SELECT count(*) FROM kept) AS is_stale""")
def kb_status(spark, sf_dir):
    return I.index_status(kb_documents(spark, sf_dir), stored_index(spark, sf_dir))


@register("text_cleaners", f"""SELECT doc_id, md5({D.clean_kb('text')}) AS kb, md5({D.clean_web('text')}) AS web, md5({D.cut(D.clean_web('text'), 520, '…')}) AS web_cut, md5({D.snippet('text')}) AS snippet,
md5({D.answer_block('text')}) AS answer, md5({D.cut(D.one_spaced(D.filled('text')), 4000, '...')}) AS direct, md5({D.cut(D.snippet('text'), 520, '…')}) AS quote FROM documents""")
def text_cleaners(spark, sf_dir):
    t, d = F.col("text"), table(spark, sf_dir, "documents")
    made = {"kb": X.clean_kb(t, False), "web": X.clean_web(t, entities=False), "web_cut": X.clean_web(t, 520, False), "snippet": X.clean_snippet(t), "answer": X.clean_answer_block(t), "direct": X.clean_direct(t, entities=False), "quote": X.evidence_quote(t)}
    return d.select("doc_id", *(F.md5(v).alias(k) for k, v in made.items()))


@register("text_passages", f"""WITH one AS (SELECT doc_id, {D.one_spaced(D.filled('text'))} AS t FROM documents),
parts AS (SELECT doc_id, unnest(s) AS part, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, list_transform({D.sentences('t')}, lambda p: {D.snippet('p')}) AS s FROM one)),
made AS (SELECT doc_id, i, 0 AS off, part AS passage FROM parts WHERE length(part) BETWEEN 40 AND 900
  UNION ALL SELECT doc_id, i, off, {D.snippet('substr(part, CAST(off + 1 AS BIGINT), 620)')} FROM (SELECT *, unnest(range(0, least(length(part), 2600), 520)) AS off FROM parts WHERE length(part) > 900))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, off) - 1 AS INTEGER) AS n, passage FROM made WHERE length(passage) >= 40""")
def text_passages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(passages(F.col("text"))).alias("n", "passage"))


@register("numbered_blocks", f"""WITH one AS (SELECT doc_id, {D.one_spaced(D.filled('text'))} AS t FROM documents),
parts AS (SELECT doc_id, unnest(s) AS part, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, {D.sentences('t')} AS s FROM one)),
clean AS (SELECT doc_id, i, {D.clean_web('part')} AS text, CASE i % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'h2' ELSE 'text' END AS tag FROM parts),
keyed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower({D.sub('substr(text, 1, 220)', X.WS + '+', chr(39) + ' ' + chr(39))}) ORDER BY i) AS n FROM clean WHERE length(text) >= 20),
numbered AS (SELECT doc_id, tag, text, row_number() OVER w AS b, count(*) FILTER (tag = 'p') OVER w AS p, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM keyed WHERE n = 1 WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, 'P' || b AS block_id, CAST(b AS INTEGER) AS block_index, CASE tag WHEN 'p' THEN '网页正文第 ' || p || ' 段' WHEN 'h2' THEN '网页正文标题块 ' || b ELSE '网页正文块 ' || b END AS location, tag, text, CAST(s AS INTEGER) AS char_start, CAST(s + length(text) AS INTEGER) AS char_end FROM numbered""")
def numbered_blocks(spark, sf_dir):
    """Sentences as raw blocks of three kinds in turn, numbered."""
    kind = lambda i: F.when((i + 1) % 3 == 0, "p").when((i + 1) % 3 == 1, "h2").otherwise("text")
    raw = F.transform(F.split(X.one_spaced(X.filled(F.col("text"))), X.SENTENCE_END), lambda p, i: F.struct(kind(i).alias("tag"), p.alias("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(normalize_blocks(raw))).drop("paragraph_index")


@register("file_texts")
def file_texts(spark, sf_dir):
    """Documents as files of four kinds, read back by extension."""
    d = kb_documents(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, (".txt", ".json", ".csv", ".html"))), (F.abs(F.xxhash64("doc_id")) % 4 + 1).cast("int"))
    body = F.when(kind == ".json", F.to_json(F.struct("title", "text"))).when(kind == ".html", F.concat(F.lit("<p>"), "text", F.lit("</p>"))).otherwise(F.col("text"))

    def read(frames):
        for f in frames:
            f["text"] = [text_or_error(e, None if c is None else bytes(c))[0] for e, c in zip(f["ext"], f["content"])]
            yield f[["doc_id", "ext", "text"]]

    return d.select("doc_id", kind.alias("ext"), F.encode(body, "UTF-8").alias("content")).mapInPandas(read, "doc_id long, ext string, text string")


@register("text_blocks")
def text_blocks_query(spark, sf_dir):
    """Evidence blocks of plain text, numbered."""
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(normalize_blocks(text_blocks(F.col("text"), False))))
