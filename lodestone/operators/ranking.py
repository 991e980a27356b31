"""Merging and ranking hits of many questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import score as S
from lodestone.functions.classify import is_noise, source_type
from lodestone.functions.text import clean_snippet, filled
from lodestone.functions.urls import direct_domains, extract_domain, normalize_domain

#: Weights are a list that people keep by hand; a plan takes at most so many as a literal.
MOST_WEIGHTS = 10_000


def parse_weights(text: str) -> list[tuple[str, int]]:
    """(domain, weight 0 to 5) by first appearance of each domain; the last weight of a domain counts."""
    out: dict[str, int] = {}
    for line in map(str.strip, text.splitlines()):
        parts = line.rsplit(maxsplit=1)
        if line.startswith("#") or len(parts) != 2 or not parts[1].lstrip("+-").isdigit():
            continue
        name = parts[0].strip().lower()
        name = name.split("://", 1)[1].split("/", 1)[0] if name.startswith(("http://", "https://")) else name
        out[name.removeprefix("www.")] = max(0, min(5, int(parts[1])))
    return list(out.items())


def site_weight(domain: Column, weights: list[tuple[str, int]], default: int = 1) -> Column:
    """The weight of the first entry that is the domain or a parent of it."""
    if len(weights) > MOST_WEIGHTS:
        raise ValueError(f"{len(weights)} site weights; {MOST_WEIGHTS} at most")
    d = normalize_domain(domain)
    if not weights:
        return F.lit(default)
    table = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")) for n, w in weights))
    fits = F.filter(table, lambda x: (d == x["n"]) | F.endswith(d, F.concat(F.lit("."), x["n"])))
    return F.when(d == "", default).otherwise(F.coalesce(F.try_element_at(F.transform(fits, lambda x: x["w"]), F.lit(1)), F.lit(default)))


def rank_hits(hits: DataFrame, weights: list[tuple[str, int]], min_relevance: int = 1, limit: int = 6, default_weight: int = 1) -> DataFrame:
    """The best ``limit`` hits of each question with all parts of their scores; ties by position.

    hits: qid, question, resource_intent, pos, title, url, content, snippet, matched_query,
    source_type (null: by domain), kb_score.  Noise, sites of weight 0, hits off the domains
    that a question names, and irrelevant hits go.
    """
    h = hits.withColumn("domain", extract_domain(F.col("url"))).withColumn("_asked", direct_domains(F.col("question")))
    h = h.where(~is_noise(F.col("title"), F.col("content"), F.col("snippet"), F.col("url")))
    h = h.where((F.size("_asked") == 0) | (F.col("domain") == "") | F.array_contains("_asked", F.col("domain")))
    h = h.withColumn("site_weight", site_weight(F.col("domain"), weights, default_weight)).where("site_weight <> 0")
    body = F.when(filled(F.col("content")) != "", F.col("content")).otherwise(filled(F.col("snippet")))
    kind = F.when(filled(F.col("source_type")) != "", F.col("source_type")).otherwise(source_type(F.col("domain")))
    h = h.withColumns({"_body": body, "source_type": kind})
    h = h.withColumn("relevance", S.relevance(F.col("question"), F.col("title"), F.col("_body"), F.col("url"))).where(F.col("relevance") >= min_relevance)
    h = h.withColumns({
        "query_bonus": S.query_bonus(F.col("matched_query"), F.col("title"), F.col("_body"), F.col("url")),
        "source_bonus": S.source_bonus(F.col("question"), F.col("source_type"), F.col("resource_intent")),
        "intent_bonus": S.intent_bonus(F.col("resource_intent"), F.col("title"), F.col("url"), F.lit(""), F.col("source_type")),
    })
    h = h.withColumn("final_score", S.final_score(F.col("relevance"), F.col("query_bonus"), F.col("source_bonus"), F.col("intent_bonus"), F.col("site_weight"), F.col("kb_score")))
    order = Window.partitionBy("qid").orderBy(F.desc("final_score"), "pos")
    h = h.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return h.withColumn("content", clean_snippet(F.col("_body"))).drop("_body", "_asked", "snippet", "matched_query")
