"""Tokenizers and term lists; each keeps first-occurrence order where it returns an array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import HAN, filled, let, strip, sub

# Word lists.
RELEVANCE_STOPWORDS = (
    "你好", "您好", "请问", "请", "帮我", "一下", "一个", "这个", "那个",
    "怎么", "如何", "什么", "为什么", "是否", "可以", "有没有", "关于",
    "介绍", "推荐", "说明", "方法", "步骤", "问题", "搜索", "查询",
)
QUERY_STOPWORDS_LATIN = ("the", "and", "for", "with", "what", "how", "why", "this", "that")
QUERY_STOPWORDS_HAN = ("什么", "怎么", "如何", "为什么", "一个", "这个", "那个", "用户", "工具", "项目", "文章")
QUERY_SYNONYMS = {
    "chatgpt": ["ChatGPT"],
    "codex": ["Codex"],
    "deep research": ["Deep Research", "深度研究"],
    "服务降级": ["degradation", "degraded", "服务降级"],
    "风险等级": ["risk", "risk level", "风险等级"],
    "用量": ["usage", "quota", "limit", "用量"],
    "开源": ["open source", "GitHub", "开源"],
}
ENTITY_STOPWORDS = (
    "http", "https", "www", "com", "org", "net", "cn", "io",
    "what", "how", "why", "when", "where", "which", "tool",
    "github", "gitlab", "huggingface", "arxiv",
)
CORE_BAD_FRAGMENTS = ("是否", "怎么", "如何", "什么", "为什么", "有没有", "可以", "请问")
CORE_KNOWN = ("error", "exception", "traceback", "cuda", "pytorch", "python", "transformers", "github", "arxiv")
ANSWER_STOPWORD = "的了和是一个一种以及对于关于认为下面哪个哪些什么如何是否其中不包括包括根据下列以下属于不属于正确错误"

_NONE = "cast(array() as array<string>)"


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def empty() -> Column:
    return F.expr(_NONE)


def grams(run: Column, n: int) -> Column:
    """All n-character pieces of a run."""
    last = F.length(run) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(run, i, F.lit(n)))).otherwise(empty())


def kb_terms(text: Column) -> Column:
    """Index terms: latin tokens, then for each Han run its characters, pairs and triples."""
    return let(_kb_terms, F.lower(filled(text)))


def _kb_terms(t: Column) -> Column:
    latin = F.transform(found(t, r"[a-z0-9_][a-z0-9_\-.:/#]{1,}"), lambda x: sub(x, r"^[.\-:/#]+|[.\-:/#]+$"))
    latin = F.filter(latin, lambda x: F.length(x) >= 2)
    han = F.transform(found(t, f"{HAN}+"), lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.concat(grams(r, 1), grams(r, 2), grams(r, 3))))
    return F.array_distinct(F.concat(latin, F.flatten(han)))


def terms_text(text: Column, limit: int = 900) -> Column:
    return F.array_join(F.slice(kb_terms(text), 1, limit), " ")


def relevance_tokens(text: Column) -> Column:
    """Tokens that relevance is counted on: latin tokens and Han n-grams, less stop words."""
    t = F.lower(filled(text))
    latin = found(t, r"[a-zA-Z0-9][a-zA-Z0-9_\-.+#/]{1,}")

    def of_run(r: Column) -> Column:
        whole = F.when(F.length(r).between(2, 6), F.array(r)).otherwise(empty())
        more = F.when(F.length(r) > 2, F.concat(grams(r, 2), grams(r, 3), grams(r, 4))).otherwise(empty())
        return F.concat(whole, more)

    every = F.concat(latin, F.flatten(F.transform(found(t, f"{HAN}+"), of_run)))
    return F.array_distinct(F.filter(every, lambda x: ~x.isin(*RELEVANCE_STOPWORDS)))


def unique_keep_order(items: Column) -> Column:
    """Stripped, non-blank, first of each spelling regardless of case."""
    clean = F.filter(F.transform(items, strip), lambda x: x != "")
    start = F.struct(empty().alias("out"), empty().alias("seen"))

    def add(acc: Column, x: Column) -> Column:
        return let(lambda key, fresh: put(acc, x, key, fresh), F.lower(x), ~F.array_contains(acc["seen"], F.lower(x)))

    def put(acc: Column, x: Column, key: Column, fresh: Column) -> Column:
        out = F.when(fresh, F.concat(acc["out"], F.array(x))).otherwise(acc["out"])
        seen = F.when(fresh, F.concat(acc["seen"], F.array(key))).otherwise(acc["seen"])
        return F.struct(out.alias("out"), seen.alias("seen"))

    return F.aggregate(clean, start, add, lambda acc: acc["out"])


def query_tokens(text: Column, max_terms: int = 16) -> Column:
    """Evidence terms with their case, Han runs and fixed synonyms; first of each spelling regardless of case."""
    t = filled(text)
    latin = F.filter(found(t, r"[A-Za-z][A-Za-z0-9_+\-.]{1,}|\d+(?:\.\d+)?"), lambda x: (F.length(x) >= 2) & ~F.lower(x).isin(*QUERY_STOPWORDS_LATIN))
    han = F.filter(found(t, f"{HAN}{{2,12}}"), lambda x: ~x.isin(*QUERY_STOPWORDS_HAN))
    more = [F.when(F.contains(F.lower(t), F.lit(k)) | F.contains(t, F.lit(k)), F.array(*map(F.lit, v))).otherwise(empty()) for k, v in QUERY_SYNONYMS.items()]
    return F.slice(unique_keep_order(F.concat(latin, han, *more)), 1, max_terms)


def answer_terms(text: Column) -> Column:
    """Set of terms that quiz blocks are compared by."""
    t = filled(text)
    tokens = F.transform(found(t, rf"[A-Za-z][A-Za-z0-9_\-]{{1,}}|\d+|{HAN}{{2,}}"), F.lower)
    han = sub(t, r"[^\x{4E00}-\x{9FFF}]")
    return F.array_distinct(F.filter(F.concat(tokens, grams(han, 2)), lambda x: x != ANSWER_STOPWORD))


def core_terms(question: Column, max_terms: int = 8) -> Column:
    """The longest and most telling relevance tokens; equal scores keep their order."""
    bad = "|".join(CORE_BAD_FRAGMENTS)
    tokens = F.filter(relevance_tokens(question), lambda x: ~x.rlike(bad))
    scored = F.transform(tokens, lambda x, i: F.struct(
        -(F.length(x) + F.when(x.rlike(r"\d"), 3).otherwise(0) + F.when(x.isin(*CORE_KNOWN), 3).otherwise(0)).alias("s"), i.alias("i"), x.alias("x")))
    return F.slice(F.transform(F.array_sort(scored), lambda v: v["x"]), 1, max_terms)


def ascii_entities(text: Column) -> Column:
    marks = r"[.,;:!?，。；：！？()\[\]{}<>《》\"']+"
    items = F.transform(found(filled(text), r"[A-Za-z][A-Za-z0-9_.:@/\-+]{1,}"), lambda x: sub(x, f"^{marks}|{marks}$"))
    return F.array_distinct(F.filter(items, lambda x: (x != "") & ~F.lower(x).isin(*ENTITY_STOPWORDS)))
