"""The ten ``opN_`` queries: each applies its operator to whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.kit import read

TOKENIZER = "word_bpe_49k.json"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, copy_of, class_id, n_links of every document: five-word shingles, similarity 0.8."""
    from lodestone.llm.jaccard_join import jaccard_join

    return jaccard_join(read(spark, sf_dir, "documents"))


def op2_bitpacked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to bit-packed files and read back."""
    from lodestone.llm.token_files import token_output

    return token_output(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).select("doc_id", "start", "n_tokens", "ids_crc32", "file")


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``rows``."""
    from lodestone.llm.sharding import shard_rows

    return shard_rows(read(spark, sf_dir, "documents"), 24)


def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from labels that are not held out."""
    from lodestone.llm import toxicity

    docs = read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op5_url_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page: rules first, else trust over the host graph."""
    from lodestone.llm.url_graph import judge_pages

    return judge_pages(read(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that an earlier document has too, with its source."""
    from lodestone.llm.substring_dedup import passages

    return passages(read(spark, sf_dir, "documents")).drop("text_key")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of 4096 tokens."""
    from lodestone.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).drop("ids")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a benchmark item in it."""
    from lodestone.llm.decontaminate import matches

    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")


def op9_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from labels that are not held out."""
    from lodestone.llm import quality

    docs = read(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op10_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a TIFF file and read back."""
    from lodestone.llm import tiff

    return tiff.digests(tiff.documents_media(read(spark, sf_dir, "documents")))


_ALL = [
    op1_ngram_jaccard_join, op2_bitpacked_tokens, op3_feistel_sharding, op4_toxicity_grammar, op5_url_link_graph,
    op6_substring_dedup, op7_best_fit_packing, op8_benchmark_decontamination, op9_quality_gam, op10_tiff_pages,
]

_WORD = r"[0-9a-z_\x{80}-\x{10FFFF}]+"
_SQL: dict[str, str] = {
    # Every pair of distinct shingle sets is measured; classes by reachability.
    "op1_ngram_jaccard_join": f"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END) AS sh FROM w),
c AS (SELECT sh, min(doc_id) AS rep, count(*) AS copies, row_number() OVER () AS num FROM s GROUP BY sh),
t AS (SELECT num AS rep, copies, len(sh) AS n, unnest(sh) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.copies) AS na, any_value(b.copies) AS nb FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b, nb AS n FROM p UNION ALL SELECT b, a, na FROM p),
r AS (SELECT num AS a, num AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
k AS (SELECT r.a AS num, min(c.rep) AS class_id FROM r JOIN c ON c.num = r.b GROUP BY r.a),
l AS (SELECT a AS num, sum(n) AS n FROM e GROUP BY a)
SELECT s.doc_id, c.rep AS copy_of, k.class_id, CAST(c.copies - 1 + coalesce(l.n, 0) AS BIGINT) AS n_links FROM s JOIN c USING (sh) JOIN k USING (num) LEFT JOIN l USING (num)""",
    # Rounds of the two propagations as sums over walks of growing length.
    "op5_url_link_graph": r"""WITH RECURSIVE
n AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/' WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM n),
v AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM m),
h AS (SELECT host, avg((ruled IS NOT NULL AND ruled = 'allow')::INT) AS good, avg((ruled IS NOT NULL AND ruled = 'block')::INT) AS bad FROM v WHERE host <> '' GROUP BY host),
u AS (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]+)', 1), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS dst FROM n WHERE host <> ''),
e AS (SELECT src, dst, count(*) AS links FROM u WHERE src <> dst GROUP BY 1, 2),
f AS (SELECT src, dst, links / sum(links) OVER (PARTITION BY src) AS share FROM e),
g AS (SELECT dst AS src, src AS dst, links / sum(links) OVER (PARTITION BY dst) AS share FROM e),
t AS (SELECT 0 AS i, host, good * (1 - 0.85::DOUBLE) AS x FROM h WHERE good > 0 UNION ALL SELECT t.i + 1, f.dst, sum(t.x * f.share * 0.85::DOUBLE) FROM t JOIN f ON f.src = t.host WHERE t.i < 60 GROUP BY t.i, f.dst),
d AS (SELECT 0 AS i, host, bad * (1 - 0.85::DOUBLE) AS x FROM h WHERE bad > 0 UNION ALL SELECT d.i + 1, g.dst, sum(d.x * g.share * 0.85::DOUBLE) FROM d JOIN g ON g.src = d.host WHERE d.i < 60 GROUP BY d.i, g.dst),
tt AS (SELECT host, sum(x) AS trust FROM t GROUP BY host), dd AS (SELECT host, sum(x) AS distrust FROM d GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0), 9)::DOUBLE AS trust, round(coalesce(distrust, 0), 9)::DOUBLE AS distrust
FROM v LEFT JOIN tt USING (host) LEFT JOIN dd USING (host)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
