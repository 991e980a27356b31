"""Classifiers: ordered CASE expressions over keywords and domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import HAN, contains_any, filled, let, strip, sub
from lodestone.functions.tokens import relevance_tokens
from lodestone.functions.urls import normalize_domain

# Keyword lists, in order of priority where several may fit.
TASK_WORDS = (
    "相关文章", "相关资料", "参考资料", "推荐文章", "推荐论文", "找论文", "论文", "paper", "papers",
    "文档", "documentation", "资料", "链接", "网站", "博客", "教程", "guide", "references", "sources",
    "找几篇", "推荐几篇", "有哪些资料", "技术报告", "白皮书", "找文章",
)
RESOURCE_WORDS = {
    "troubleshooting": (
        "error", "errors", "exception", "traceback", "fix", "issue", "issues", "bug", "install", "setup", "config", "troubleshoot",
        "报错", "错误", "异常", "修复", "问题", "安装", "配置", "排查", "无法", "失败",
    ),
    "project": (
        "github", "gitlab", "repo", "repository", "repositories", "open source", "opensource", "library", "toolkit", "framework",
        "project", "source code", "开源", "项目", "仓库", "源码", "代码库", "库", "工具",
    ),
    "paper": ("paper", "papers", "technical report", "whitepaper", "arxiv", "论文", "技术报告", "白皮书", "报告"),
    "docs": ("documentation", "docs", "api", "readme", "manual", "文档", "官方文档", "接口", "说明书", "手册"),
    "tutorial": ("tutorial", "guide", "example", "examples", "how to", "教程", "入门", "指南", "示例", "例子", "怎么用", "如何使用"),
}
ANSWER_WORDS = {
    "troubleshooting": ("error", "exception", "traceback", "fix", "issue", "issues", "bug", "报错", "错误", "异常", "修复", "失败", "无法", "不工作"),
    "recommendation": ("recommend", "choose", "selection", "which is better", "best", "怎么选", "选哪个", "推荐", "适合", "值得", "应该用", "哪个好"),
    "comparison": ("vs", "versus", "compare", "comparison", "difference", "better than", "区别", "比较", "对比", "差异", "优劣", "是不是一样"),
}
TECHNICAL_WORDS = (
    "api", "sdk", "github", "gitlab", "huggingface", "modelscope", "arxiv", "paper", "technical report", "whitepaper", "docs",
    "documentation", "readme", "python", "pytorch", "cuda", "docker", "linux", "windows", "macos", "npm", "pip", "conda", "transformers",
    "llm", "rag", "agent", "prompt", "embedding", "quantization", "inference", "training", "benchmark", "error", "exception", "traceback",
    "报错", "错误", "异常", "技术报告", "论文", "源码", "仓库", "接口", "文档", "部署", "推理", "训练", "量化", "模型", "框架", "版本", "安装", "配置",
)
TIMELY_WORDS = (
    "最新", "当前", "现在", "today", "latest", "current", "recent", "价格", "费用", "政策", "法律", "法规", "许可证", "license", "pricing",
    "版本", "兼容", "支持", "不支持", "发布时间", "release", "changelog", "deprecated", "医疗", "药", "诊断", "投资", "股票", "汇率", "安全漏洞", "cve",
)
NEGATIVE_WORDS = (
    "not supported", "unsupported", "deprecated", "limitation", "known issue", "bug", "failed", "failure",
    "不支持", "不兼容", "已弃用", "限制", "问题", "失败", "报错", "错误", "无法",
)
NOISE_WORDS = ("广告", "推广", "赞助", "sponsored", "advertisement", "doubleclick", "adservice", "tracking", "utm_source", "utm_medium", "utm_campaign")
OFFICIAL_SUFFIXES = (".gov", ".edu")
DOMAIN_TYPES = {  # the first type that has the domain counts
    "paper": ("arxiv.org", "aclanthology.org", "openreview.net"),
    "repo": ("github.com", "gitlab.com"),
    "doc": ("readthedocs.io", "docs.python.org", "learn.microsoft.com"),
    "official": ("openai.com", "docs.python.org", "python.org", "pytorch.org", "huggingface.co", "qwenlm.github.io", "alibabacloud.com", "learn.microsoft.com", "microsoft.com", "modelscope.cn"),
    "community": ("zhihu.com", "zhuanlan.zhihu.com", "csdn.net", "blog.csdn.net", "cnblogs.com", "jianshu.com", "reddit.com", "cloud.tencent.com", "baidu.com", "wikipedia.org", "zh.wikipedia.org"),
}
PRIMARY_TYPES = ("local_kb", "official", "doc", "paper", "repo")
MODE_ALIASES = {"offline": "local", "local_only": "local", "kb": "local", "web": "online", "internet": "online", "online_only": "online", "both": "hybrid", "all": "hybrid"}
RESOURCE_LABELS = {"paper": "论文/技术报告", "project": "开源项目/仓库", "docs": "官方文档/API", "tutorial": "教程/指南", "troubleshooting": "排错/问题解决", "general": "通用资料"}
ANSWER_LABELS = {"concept": "概念解释", "comparison": "对比判断", "troubleshooting": "排错解释", "recommendation": "选型建议"}


def lookup(key: Column, table: dict, default) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def _first_kind(text: Column, table: dict, default: str) -> Column:
    return let(lambda t: _kind(t, table, default), text)


def _kind(text: Column, table: dict, default: str) -> Column:
    out = F.lit(default)
    for kind, words in reversed(table.items()):
        out = F.when(contains_any(text, words), kind).otherwise(out)
    return out


def detect_task_type(question: Column, mode: Column | None = None) -> Column:
    kind = F.when(contains_any(F.lower(strip(filled(question))), TASK_WORDS), "resource").otherwise("answer")
    if mode is None:
        return kind
    m = F.lower(strip(filled(mode)))
    return F.when(m.isin("answer", "resource"), m).otherwise(kind)


def detect_resource_intent(question: Column) -> Column:
    return _first_kind(F.lower(filled(question)), RESOURCE_WORDS, "general")


def detect_answer_intent(question: Column) -> Column:
    return _first_kind(F.lower(filled(question)), ANSWER_WORDS, "concept")


def search_category(intent: Column) -> Column:
    return F.when(intent.isin("project", "docs", "tutorial", "troubleshooting"), "it").when(intent == "paper", "science").otherwise("general")


def is_technical(question: Column) -> Column:
    return contains_any(F.lower(filled(question)), TECHNICAL_WORDS)


def wants_english_query(question: Column) -> Column:
    return filled(question).rlike("[a-zA-Z]{3,}") | is_technical(question)


def is_timely(question: Column) -> Column:
    return contains_any(F.lower(filled(question)), TIMELY_WORDS)


def is_short_ambiguous(question: Column) -> Column:
    q = sub(filled(question), r"[。！？!?，,\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{3000}]+")
    return q.rlike(rf"^{HAN}{{1,6}}$") | q.rlike(r"^[a-zA-Z0-9_\-.+#/]{1,12}$")


def is_bad_query(question: Column, query: Column) -> Column:
    """A rewritten query that lost the question: no tokens, a short question gone, or no latin token in common."""
    return let(_is_bad, relevance_tokens(question), relevance_tokens(query), strip(filled(question)), filled(query))


def _is_bad(a: Column, b: Column, q: Column, query: Column) -> Column:
    latin = lambda tokens: F.filter(tokens, lambda t: t.rlike("[a-zA-Z0-9]"))
    lost = (F.size(latin(a)) > 0) & ~F.arrays_overlap(latin(a), latin(b))
    return (F.size(b) == 0) | ((F.length(q) <= 4) & ~F.contains(query, q)) | lost


def is_noise(title: Column, content: Column, snippet: Column, url: Column) -> Column:
    body = F.when(filled(content) != "", content).otherwise(filled(snippet))
    return contains_any(F.lower(F.concat_ws(" ", filled(title), body, filled(url))), NOISE_WORDS)


def source_type(domain: Column) -> Column:
    return let(_source_type, normalize_domain(domain))


def _source_type(d: Column) -> Column:
    out = F.when(F.contains(d, F.lit(".wikipedia.org")), "community").otherwise("general")
    for kind, names in reversed(DOMAIN_TYPES.items()):
        out = F.when(d.isin(*names), kind).otherwise(out)
    suffix = F.lit(False)
    for s in OFFICIAL_SUFFIXES:
        suffix = suffix | F.endswith(d, F.lit(s))
    return F.when(suffix, "official").otherwise(out)


def evidence_role(title: Column, content: Column, page_text: Column, kind: Column) -> Column:
    """The matched query is not read: ranking has dropped it by then."""
    text = F.lower(F.concat_ws(" ", filled(title), filled(content), F.substring(filled(page_text), 1, 1200), F.lit("")))
    return F.when(contains_any(text, NEGATIVE_WORDS), "限制/反证").when(kind.isin(*PRIMARY_TYPES), "支持证据").otherwise("背景资料")


def source_mode(mode: Column, default: str = "auto") -> Column:
    m = let(lambda m: F.coalesce(lookup(m, MODE_ALIASES, None), m), F.lower(strip(F.when(filled(mode) != "", mode).otherwise(default))))
    return let(lambda m: F.when(m.isin("auto", "local", "online", "hybrid"), m).otherwise("auto"), m)


def source_flags(mode: Column, enough: Column) -> Column:
    """(use_local, use_direct, use_web); auto goes online only where local results are not enough."""
    m = source_mode(mode)
    web = F.when(m == "local", False).when(m.isin("online", "hybrid"), True).otherwise(~F.coalesce(enough, F.lit(False)))
    return F.struct((m != "online").alias("use_local"), web.alias("use_direct"), web.alias("use_web"))
