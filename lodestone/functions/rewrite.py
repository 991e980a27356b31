"""Query rewriting by rules; each keeps what the question asks for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.classify import is_bad_query
from lodestone.functions.text import WS, clean_one_line, contains_any, contains_han, filled, let, strip, sub
from lodestone.functions.tokens import ascii_entities, core_terms, empty, unique_keep_order

# Phrases and their order.
FILLERS = (
    "帮我", "请", "查找", "查一下", "找一下", "找几篇", "推荐几篇", "找文章", "相关文章", "相关资料", "参考资料", "推荐文章",
    "推荐论文", "找论文", "论文", "资料", "链接", "网站", "有哪些", "给我", "关于",
)
FILLERS_ENGLISH = r"(?i)\b(find|search|lookup|look up|show me|give me|about|resources?|links?|articles?)\b"
INTENT_SUFFIXES = {
    "paper": ("论文", "technical report", "paper arxiv"),
    "project": ("GitHub", "github repo", "source code", "README", "open source", "repository"),
    "docs": ("官方文档", "API documentation", "docs"),
    "tutorial": ("教程", "guide", "tutorial"),
    "troubleshooting": (None, "error fix", "报错"),  # None: the question as it is
    "general": ("资料", "references"),
}
KB_TRANSLATIONS = {
    "marx": "马克思", "marxism": "马克思主义", "labor process": "劳动过程", "labour process": "劳动过程", "labor": "劳动", "labour": "劳动",
    "basic elements": "基本要素", "three basic elements": "三个基本要素", "means of labor": "劳动资料", "means of labour": "劳动资料",
    "object of labor": "劳动对象", "object of labour": "劳动对象", "tool": "工具", "tools": "工具", "correct answer": "正确答案",
    "labor law": "劳动法", "labour law": "劳动法", "garbage classification": "垃圾分类",
}
ASKS = {
    "docs": ("官方", "文档", "docs", "documentation", "api", "标准", "standard"),
    "version": ("版本", "兼容", "支持", "不支持", "release", "changelog", "support", "supported", "compatib"),
    "issue": ("报错", "错误", "异常", "失败", "error", "exception", "traceback", "install", "安装", "bug"),
    "paper": ("论文", "paper", "arxiv", "openreview", "实验", "benchmark", "评测"),
}
REQUIRED = (
    (("开源",), ("open source", "opensource")),
    (("项目", "仓库", "源码", "代码"), ("project", "repository", "repo", "github", "source code")),
    (("服务降级", "降级风险"), ("degradation", "downgrade", "service status", "risk")),
    (("深度研究",), ("deep research",)),
    (("用量", "额度", "使用量"), ("usage", "quota", "limit")),
    (("最新一次提交", "最后一次提交", "最近一次提交"), ("latest commit", "last commit", "recent commit")),
    (("三周", "3周"), ("three weeks", "3 weeks")),
)
EXPLAINS = ("is a tool for", "is used for", "designed to", "refers to", "是一种", "用于", "旨在", "指的是")


def spaced(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def ordered(*items: Column) -> Column:
    """Distinct non-blank items in order; null items are left out."""
    return F.array_distinct(F.filter(F.array_compact(F.array(*items)), lambda x: x != ""))


def resource_query(question: Column) -> Column:
    q = strip(filled(question))
    t = q
    for word in FILLERS:
        t = F.replace(t, F.lit(word), F.lit(" "))
    t = sub(strip(sub(t, f"{WS}+", " ")), FILLERS_ENGLISH, " ")
    t = sub(sub(t, f"{WS}+", " "), r"^[ \-:：]+|[ \-:：]+$")
    return let(lambda t: F.when(t != "", t).otherwise(q), t)


def resource_queries(question: Column, intent: Column) -> Column:
    return let(lambda base, q: _resource_queries(base, q, intent), resource_query(question), strip(filled(question)))


def _resource_queries(base: Column, q: Column, intent: Column) -> Column:
    out = F.array(base)
    for name, suffixes in INTENT_SUFFIXES.items():
        out = F.when(intent == name, ordered(base, *(q if s is None else strip(spaced(base, F.lit(s))) for s in suffixes))).otherwise(out)
    return let(lambda out: F.when(base == "", F.concat(F.array(base), F.filter(out, lambda x: x != ""))).otherwise(out), out)


def query_templates(question: Column, base_query: Column, answer_intent: Column, resource_intent: Column, limit: int = 3) -> Column:
    """Queries that look for official, versioned, failing and contrary evidence."""
    q = strip(filled(question))
    made = let(lambda q, base: _said(q, base), q, strip(F.when(filled(base_query) != "", base_query).otherwise(strip(filled(question)))))
    return let(lambda m: _templates(m["q"], m["base"], m["said"], m["stem"], answer_intent, resource_intent, limit), made)


def _said(q: Column, base: Column) -> Column:
    said = F.when(q != "", q).otherwise(base)
    terms = F.array_join(core_terms(said, 7), " ")
    return F.struct(q.alias("q"), base.alias("base"), said.alias("said"), let(lambda t: F.when(t != "", t).otherwise(base), terms).alias("stem"))


def _templates(q: Column, base: Column, said: Column, stem: Column, answer_intent: Column, resource_intent: Column, limit: int) -> Column:
    low = F.lower(q)
    asks = {k: contains_any(low, v) for k, v in ASKS.items()}
    more = lambda when, *tails: [F.when(when, spaced(stem, F.lit(t))) for t in tails]
    always = F.lit(True)
    candidates = [
        F.when(base != "", base),
        *more(always, "official documentation"),
        *more(asks["docs"] | answer_intent.isin("concept", "recommendation", "comparison", "troubleshooting"), "docs"),
        *more(asks["version"], "release notes changelog", "compatibility support unsupported"),
        *more(asks["issue"] | (answer_intent == "troubleshooting"), "error issue fix", "site:github.com issue"),
        *more(always, "limitation unsupported deprecated", "not supported issue"),
        *more(asks["paper"] | (resource_intent == "paper"), "arxiv paper", "openreview"),
        *more((resource_intent == "project") | F.contains(low, F.lit("github")), "site:github.com"),
    ]
    lines = F.filter(F.transform(F.array_compact(F.array(*candidates)), lambda c: clean_one_line(c, 220)), lambda c: c != "")
    good = F.filter(lines, lambda c: (c == base) | ~is_bad_query(said, c))
    return F.slice(F.array_distinct(good), 1, max(1, limit))


def expand_kb_query(question: Column) -> Column:
    """One more query with the Chinese terms of the English ones that a question has, or null."""
    low = F.lower(strip(filled(question)))
    terms = F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in KB_TRANSLATIONS.items()))))
    return F.when(F.size(terms) > 0, F.array_join(terms, " "))


def _signs(c: Column) -> dict[str, Column]:
    any_of = lambda *w: contains_any(c, w)
    return {
        "open": any_of("开源"), "project": any_of("项目", "仓库", "源码", "代码"),
        "level": any_of("服务降级风险等级", "降级风险等级"), "degraded": any_of("服务降级", "降级风险", "降级风险等级"),
        "research": any_of("深度研究"), "usage": any_of("用量", "使用量", "额度"), "fetch": any_of("获取", "查询", "查看"), "info": any_of("信息", "数据"),
        "latest": any_of("最新一次提交", "最后一次提交", "最近一次提交"), "commit": any_of("提交"),
        "three": any_of("三周之前", "3周之前", "三周前", "3周前"), "two": any_of("两周之前", "2周之前", "两周前", "2周前"), "month": any_of("一个月之前", "1个月之前", "一个月前", "1个月前"),
        "find": any_of("找", "搜索", "查找", "需要"),
    }


def preserving_query(text: Column, for_search: bool = False) -> Column:
    """English terms for a Chinese request that keep its entities and constraints; '' where too little is known."""
    t = strip(filled(text))
    kept = let(lambda c, names: _preserving(c, names, for_search), sub(t, f"{WS}+"), ascii_entities(t))
    return F.when(contains_han(t), kept).otherwise("")


def _preserving(compact: Column, names: Column, for_search: bool) -> Column:
    s = _signs(compact)
    one = lambda when, *words: F.when(when, F.array(*map(F.lit, words))).otherwise(empty())
    ago = F.when(s["three"], F.array(F.lit("three weeks ago"))).when(s["two"], F.array(F.lit("two weeks ago"))).when(s["month"], F.array(F.lit("one month ago"))).otherwise(empty())
    terms = unique_keep_order(F.concat(
        one(s["open"], "open source"), one(s["project"], "project", "GitHub repository"), names,
        one(s["level"], "service degradation risk level"), one(~s["level"] & s["degraded"], "service degradation risk"),
        one(s["research"], "Deep Research"), one(s["usage"], "usage"), one(s["fetch"], "fetch"), one(s["info"], "information"),
        one(s["latest"], "latest commit"), one(~s["latest"] & s["commit"], "commit"), ago,
    ))
    return let(lambda terms: _said_in_english(terms, names, s, for_search), terms)


def _said_in_english(terms: Column, names: Column, s: dict[str, Column], for_search: bool) -> Column:
    joined = F.array_join(terms, " ")
    if for_search:
        answer = joined
    else:
        details = F.array_join(F.array_compact(F.array(
            F.when(F.array_contains(names, "ChatGPT") & s["degraded"], F.lit("ChatGPT service degradation risk level")),
            F.when(s["research"], F.lit("Deep Research")),
            F.when(F.array_contains(names, "Codex") & s["usage"], F.lit("Codex usage")).when(s["usage"], F.lit("usage")),
        )), ", ")
        tail = F.when(s["three"], ", with its latest commit three weeks ago").when(s["two"], ", with its latest commit two weeks ago").when(s["month"], ", with its latest commit one month ago").when(s["latest"], ", with its latest commit matching the query").otherwise("")
        what = let(lambda d: F.when(d != "", d).otherwise(joined), details)
        sentence = F.concat(F.lit("Find an open-source project that fetches "), what, F.lit(" information"), tail)
        answer = F.when(s["find"] & s["open"] & s["project"], sentence).when(s["find"], F.concat(F.lit("Find "), joined)).otherwise(joined)
    return F.when(F.size(terms) >= 3, answer).otherwise("")


def rule_translate(text: Column, for_search: bool = False) -> Column:
    """Rule translation of a Chinese question round latin entities; '' where no rule fits."""
    t = strip(filled(text))
    ruled = let(lambda c, names, keep: _ruled(c, names, keep, for_search), sub(t, f"{WS}+"), ascii_entities(t), preserving_query(t, for_search))
    return F.when(contains_han(t), ruled).otherwise("")


def _ruled(c: Column, names: Column, keep: Column, for_search: bool) -> Column:
    e = F.coalesce(F.try_element_at(names, F.lit(1)), F.lit(""))
    any_of = lambda *w: contains_any(c, w)
    say = lambda search, plain: F.format_string(search if for_search else plain, e)
    long = (keep != "") & ((F.length(c) >= 28) | (F.size(names) >= 2) | any_of("开源", "最新", "用量"))
    out = (
        F.when(any_of("工具") & any_of("什么样", "是什么", "什么"), say("%s tool", "what kind of tool is %s"))
        .when(any_of("是什么", "是啥"), say("%s what is", "what is %s"))
        .when(any_of("怎么用", "如何使用", "怎么使用"), say("%s how to use", "how to use %s"))
        .when(any_of("安装", "部署"), say("%s install setup", "how to install and set up %s"))
        .when(any_of("报错", "错误", "异常", "失败"), say("%s error fix", "how to fix errors in %s"))
        .when(any_of("论文") | F.contains(F.lower(c), F.lit("paper")), say("%s paper", "papers about %s"))
        .when(any_of("项目", "仓库", "源码", "代码") & (F.length(c) <= 24), say("%s GitHub repository", "GitHub repository for %s"))
        .otherwise(keep)
    )
    return F.when((F.size(names) == 0) | long, keep).otherwise(out)


def loses_information(original: Column, translated: Column) -> Column:
    return let(_loses, filled(original), filled(translated), F.lower(filled(translated)), sub(filled(original), f"{WS}+"))


def _loses(o: Column, translated: Column, low: Column, c: Column) -> Column:
    lost = F.exists(ascii_entities(o), lambda e: ~F.contains(low, F.lower(e)))
    for said, needed in REQUIRED:
        lost = lost | (contains_any(c, said) & ~contains_any(low, needed))
    lost = lost | ((F.length(c) >= 35) & (F.length(strip(translated)) < 35))
    return contains_han(o) & lost


def looks_like_answer(original: Column, translated: Column) -> Column:
    """A translation that answers, explains, or drops what was asked."""
    return let(_answers, filled(original), strip(filled(translated)), F.lower(strip(filled(translated))))


def _answers(original: Column, t: Column, low: Column) -> Column:
    asks = low.rlike(r"^(what|how|why|when|where|which|whether)")
    states = (F.size(ascii_entities(original)) > 0) & low.rlike(rf"\bis{WS}+(a|an|the)\b") & ~F.contains(t, F.lit("?")) & ~asks
    return (t == "") | (contains_han(original) & (states | contains_any(low, EXPLAINS) | loses_information(original, t)))
