"""Additive scores.  Every score is a sum of plain rules, added in term order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.classify import is_technical, is_timely, lookup
from lodestone.functions.text import filled, let, occurrences, strip
from lodestone.functions.tokens import answer_terms, core_terms, query_tokens, relevance_tokens

# Bonuses and patterns.
TYPE_BONUS = {"local_kb": 42, "repo": 36, "paper": 32, "official": 28, "doc": 26, "general": 8, "community": -15}
TECHNICAL_PROJECT = {"repo": 70, "official": 16, "doc": 14, "paper": 8, "general": -5, "community": -35}
TECHNICAL_OTHER = {"repo": 48, "official": 42, "paper": 40, "doc": 38, "general": 8, "community": -35}
INTENT_PATTERNS = {
    "paper": ("arxiv", "paper", "technical report", ".pdf", "abs/", "pdf/"),
    "docs": ("docs", "documentation", "api", "readme", "manual"),
    "tutorial": ("tutorial", "guide", "example", "examples", "how to", "quickstart"),
    "troubleshooting": ("error", "exception", "traceback", "issue", "fix", "faq", "troubleshoot"),
    "project": ("github", "gitlab", "repository", "repo", "open source", "readme", "stars", "开源", "仓库"),
}
INTENT_TYPES = {
    "docs": {"official": 35, "doc": 35, "repo": -10},
    "paper": {"paper": 20, "official": 20, "repo": 20},
    "troubleshooting": {"repo": 20},
    "project": {"repo": 90, "official": 10, "doc": 10, "paper": -10, "general": -15},
}
AUTHORITY = {"local_kb": 5, "official": 5, "doc": 5, "paper": 5, "repo": 4, "general": 2, "community": 1}
EVIDENCE_WORDS = r"(?i)(according to|supports|provides|usage|quota|risk|degradation|service|功能|支持|提供|获取|用量|风险|等级|服务降级|开源)"
PASSAGE_WORDS = r"\b(version|release|support|unsupported|deprecated|error|issue|install|compatible|limitation|official|docs?)\b"
PASSAGE_WORDS_HAN = "(版本|发布|支持|不支持|弃用|错误|报错|兼容|限制|官方|文档)"


def has(text: Column, part: Column) -> Column:
    return F.contains(text, part)


def chunk_score(terms: Column, phrase: Column, title: Column, path: Column, text: Column, blob: Column) -> Column:
    """Keyword score of a chunk; title, path, text and blob in lower case already."""
    return let(_chunk_score, terms, F.lower(strip(filled(phrase))), title, path, text, blob)


def _chunk_score(terms: Column, ph: Column, title: Column, path: Column, text: Column, blob: Column) -> Column:
    start = F.when((F.length(ph) >= 3) & has(text, ph), 9.0).otherwise(0.0) + F.when((F.length(ph) >= 3) & (has(title, ph) | has(path, ph)), 8.0).otherwise(0.0)

    def one(t: Column) -> Column:
        n = occurrences(text, t)
        times = let(lambda n: F.when(n > 0, F.least(F.lit(6), n + 1)).otherwise(0), n)
        hit = F.when(has(title, t), 5).otherwise(0) + F.when(has(path, t), 3).otherwise(0) + F.when(has(blob, t), 2).otherwise(0) + times
        return let(lambda h: F.struct(h.alias("hit"), (h * (1.0 + F.least(F.length(t), F.lit(12)) / 18.0)).alias("gain")), hit)

    def summed(hits: Column) -> Column:
        total = F.aggregate(hits, start, lambda acc, h: acc + h["gain"])
        return F.round(total + F.size(hits) / F.greatest(F.size(terms), F.lit(1)) * 8.0, 3)

    return F.when(F.size(terms) == 0, 0.0).otherwise(let(summed, F.filter(F.transform(terms, one), lambda h: h["hit"] > 0)))


def _sum(terms: Column, value) -> Column:
    return F.aggregate(terms, F.lit(0), lambda acc, t: acc + value(t))


def _body(content: Column, snippet: Column) -> Column:
    return F.when(filled(content) != "", content).otherwise(filled(snippet))


def relevance(question: Column, title: Column, content: Column, url: Column) -> Column:
    return let(_relevance, relevance_tokens(question), F.lower(strip(filled(question))), F.lower(filled(title)), F.lower(filled(content)), F.lower(filled(url)))


def _relevance(tokens: Column, q: Column, t: Column, c: Column, u: Column) -> Column:
    bare = F.when(q == "", 0).when(has(t, q), 10).when(has(c, q), 5).when(has(u, q), 2).otherwise(0)
    whole = F.when(F.length(q) < 2, 0).when(has(t, q), 20).when(has(c, q), 12).otherwise(0)
    each = _sum(tokens, lambda x: F.when(has(t, x), 5).when(has(c, x), 2).when(has(u, x), 1).otherwise(0))
    return F.when(F.size(tokens) == 0, bare).otherwise(whole + each)


def query_bonus(query: Column, title: Column, content: Column, url: Column) -> Column:
    return let(_query_bonus, F.lower(strip(filled(query))), F.lower(filled(title)), F.lower(filled(content)), F.lower(filled(url)))


def _query_bonus(q: Column, t: Column, c: Column, u: Column) -> Column:
    whole = F.when(has(t, q), 12).when(has(c, q), 6).when(has(u, q), 3).otherwise(0)
    each = _sum(F.slice(relevance_tokens(q), 1, 8), lambda x: F.when(has(t, x), 2).when(has(c, x), 1).otherwise(0))
    return F.when(q == "", 0).otherwise(whole + each)


def intent_bonus(intent: Column, title: Column, url: Column, domain: Column, kind: Column) -> Column:
    return let(lambda text: _intent_bonus(intent, text, kind), F.lower(F.concat_ws(" ", filled(title), filled(url), filled(domain))))


def _intent_bonus(intent: Column, text: Column, kind: Column) -> Column:
    out = F.lit(0)
    for name, patterns in INTENT_PATTERNS.items():
        points = F.lit(0)
        for p in patterns:
            points = points + F.when(has(text, F.lit(p)), 10).otherwise(0)
        out = F.when(intent == name, points + lookup(kind, INTENT_TYPES[name], 0) if name in INTENT_TYPES else points).otherwise(out)
    return out


def technical_bonus(kind: Column, intent: Column) -> Column:
    return F.when(intent == "project", lookup(kind, TECHNICAL_PROJECT, 0)).otherwise(lookup(kind, TECHNICAL_OTHER, 0))


def source_bonus(question: Column, kind: Column, intent: Column) -> Column:
    return lookup(kind, TYPE_BONUS, 0) + F.when(is_technical(question), technical_bonus(kind, intent)).otherwise(0)


def final_score(relevance_: Column, query: Column, source: Column, intent: Column, weight: Column, kb: Column) -> Column:
    return relevance_ * 6 + query + source + intent + weight * 6 + F.least(F.coalesce(kb, F.lit(0.0)) * 2, F.lit(40.0))


def block_score(question: Column, text: Column, tag: Column, title: Column, url: Column) -> Column:
    """A page block as evidence; its length alone may lift it above zero."""
    every = F.lower(F.concat_ws(" ", filled(title), filled(url), filled(text)))
    return let(_block_score, query_tokens(question, 20), filled(text), F.lower(filled(text)), every, tag)


def _block_score(terms: Column, text: Column, low: Column, every: Column, tag: Column) -> Column:

    def one(t: Column) -> Column:
        x = F.lower(t)
        inside = F.when(F.length(t) >= 4, 5.0).otherwise(3.0) + F.when(t.rlike("[A-Za-z]"), 2.5).otherwise(0.0)
        return F.when(has(low, x), inside).when(has(every, x), 1.0).otherwise(0.0)

    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + one(t))
    n = F.length(filled(text))
    total = total + F.when(tag.isin("h1", "h2", "h3"), 1.5).otherwise(0.0) + F.when(n.between(40, 600), 2.0).when(n > 1200, -2.0).otherwise(0.0)
    total = total + F.when(filled(text).rlike(EVIDENCE_WORDS), 2.0).otherwise(0.0)
    return F.when(F.size(terms) == 0, 0.0).otherwise(total)


def passage_score(tokens: Column, passage: Column) -> Column:
    return let(_passage_score, tokens, passage, F.lower(passage))


def _passage_score(tokens: Column, passage: Column, low: Column) -> Column:
    points = _sum(F.slice(tokens, 1, 16), lambda t: F.when(has(low, F.lower(t)), F.when(F.length(t) >= 4, 4).otherwise(2)).otherwise(0))
    return points + F.when(low.rlike(PASSAGE_WORDS), 2).otherwise(0) + F.when(passage.rlike(PASSAGE_WORDS_HAN), 2).otherwise(0)


def overlap_score(question: Column, block: Column) -> Column:
    return F.size(F.array_intersect(answer_terms(question), answer_terms(block)))


def _steps(value: Column, steps: list[tuple[int, int]], least: int) -> Column:
    out = F.lit(least)
    for bar, points in reversed(steps):
        out = F.when(value >= bar, points).otherwise(out)
    return out


def evidence_metrics(question: Column, kind: Column, relevance_: Column, title: Column, content: Column, passages: Column, url: Column, published: Column, domain_count: Column) -> Column:
    """How good a source is, in six parts and a total with its label and reasons."""
    passages = F.coalesce(passages, F.expr("cast(array() as array<string>)"))
    text = F.lower(F.concat_ws(" ", filled(title), filled(content), F.array_join(passages, " "), filled(url)))
    dated, timely = filled(published) != "", is_timely(question)
    authority = lookup(kind, AUTHORITY, 2)
    relevant = _steps(F.coalesce(relevance_, F.lit(0)), [(20, 5), (12, 4), (6, 3), (2, 2)], 1)
    hits = let(lambda every: _sum(core_terms(question, 10), lambda t: F.when(has(every, t), 1).otherwise(0)), text)
    specific = let(lambda n: _steps(n, [(5, 5), (3, 4), (2, 3), (1, 2)], 1), hits)
    fresh = F.when(dated, 4).when(timely, 2).otherwise(3)
    depth = F.when(F.size(passages) > 0, 5).when(filled(content) != "", 3).otherwise(1)
    independent = F.when(domain_count <= 1, 5).when(domain_count == 2, 3).otherwise(2)
    total = authority * 2 + relevant * 2 + specific + fresh + depth + independent
    label = F.when(total >= 29, "强").when(total >= 22, "中").otherwise("弱")
    mark = lambda name, v: F.concat(F.lit(name), v.cast("string"), F.lit("/5"))
    reasons = F.array_compact(F.array(
        mark("来源权威性", authority), mark("相关性", relevant), mark("问题匹配度", specific), mark("正文可读性", depth),
        F.when(dated, F.concat(F.lit("可见日期："), published)).when(timely, "未检测到明确日期"),
    ))
    return F.struct(authority.alias("authority"), relevant.alias("relevance"), specific.alias("specificity"), fresh.alias("freshness"), depth.alias("content_depth"), independent.alias("independence"), total.alias("total"), label.alias("label"), reasons.alias("reasons"))


