"""Text for people and prompts from ranked rows and cards: one text a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.classify import ANSWER_LABELS, RESOURCE_LABELS, lookup, source_mode
from lodestone.functions.text import clean_snippet, filled

# Sentences of the reports.
SUGGESTIONS = {
    "paper": ["优先打开 arXiv、官方博客、GitHub PDF 或模型卡。", "如果要快速判断可信度，先看摘要、发布时间和作者机构。"],
    "project": ["优先打开 GitHub/GitLab 仓库、README、Release 和 Issue。", "如果要判断项目质量，先看维护频率、stars、license 和最近提交。"],
    "docs": ["优先打开 docs、API reference、README 和 Quickstart。", "如果需要落地接入，继续加上 SDK 名称、版本号或语言名搜索。"],
    "tutorial": ["优先打开 Quickstart、Guide、Example，再看社区教程。", "如果你要动手实践，继续补充框架名或运行环境。"],
    "troubleshooting": ["优先打开 issue、FAQ、官方文档和带完整报错的页面。", "如果问题还不够聚焦，继续补充报错原文、版本号和操作系统。"],
    "general": ["优先看评分高且来源类型更强的结果。"],
}
COMMON = ["优先看官方文档、论文、GitHub 和模型平台。", "如果结果仍然偏杂，继续补充版本号、产品名或错误信息。"]
LOCAL_HEAD = ["【本地证据定位】", "说明：第 N 段按工具从本地文档抽取的文本段落计数；DOCX 页码不稳定，因此优先显示段落号。"]
WEB_HEAD = ["【网页证据定位】", "说明：“第 N 段”按工具抽取出的正文文本段落计数；标题、导航、页脚、表单等不计入。定位链接使用浏览器 Text Fragment，支持时会直接跳转并高亮原文。"]
SHORT_NONE = "【核心结论】\n没有找到与“%s”足够相关的搜索结果。"
SHORT_SOME = "【核心结论】\n你搜索的是短词：“%s”。这个词可能有多种含义，因此这里只展示搜索结果，不强行推断你的真实意图。\n\n【搜索结果】\n"
SHORT_END = "\n【不确定部分】\n短词搜索不交给模型自由总结，避免模型根据歧义词脑补错误场景。"
SHORT_ITEM = "%s. %s\n来源：%s；权重：%s；相关性：%s；总分：%s\n链接：%s\n"
SCORED_ITEM = "%s. %s\n域名：%s；类型：%s；权重：%s；相关性：%s；总分：%s；证据：%s/%s\n链接：%s"
RESOURCE_ITEM = "%s. %s\n链接：%s\n来源：%s\n类型：%s\n评分：权重 %s；相关性 %s；总分 %s\n"
RESOURCE_NONE = "【核心结论】\n已按“%s”模式检索“%s”，但没有找到足够可信的资料。\n\n【使用建议】\n1. 补充更具体的实体名、版本号、报错原文或产品名。\n2. 对技术主题优先尝试英文关键词。\n\n【来源评分】\n无可用来源。"
RESOURCE_SOME = "【核心结论】\n已按“%s”模式检索“%s”。下面只列出资料、摘要和评分，不强行生成综合分析。\n\n【找到的资料】"
LOCAL_ITEM = "- [%s] %s\n  位置：%s\n  原文摘录：%s\n  文件链接：%s"
WEB_ITEM = "- [%s] %s\n  位置：%s\n  原文摘录：%s\n  定位链接：%s\n  原文链接：%s"
NO_WARNING = "未检测到明显反证或限制，但这不等于不存在反例。"
HELD = "\n门控结论：当前证据不足以支持强结论，最终回答必须保持保守或只给验证路径。"
AUDIT_COUNTS = "综合：%s\n正文抓取成功：%s 个来源；独立域名：%s；主要来源：%s；限制/反证：%s。"
INSUFFICIENT = "【核心结论】\n当前搜索结果不足以支持一个可靠结论；强行回答会有误导风险。\n\n【简要依据】\n1. 综合证据强度：%s。\n2. 主要来源数量：%s；正文抓取成功：%s。\n3. 对版本、兼容性、政策、价格、法律或最新状态类问题，需要官方/原始来源直接支持。"
CONTEXT_ITEM = "[%s]\n标题：%s\n域名：%s\n来源类型：%s\n网站权重：%s\n相关性分：%s\n总分：%s\n证据强度：%s；证据角色：%s；证据分：%s\n链接：%s\n搜索摘要：%s\n正文摘录：%s\n"
MODE_LOCAL = "【检索模式】\n仅使用本地知识库；命中 %s 个本地片段，未访问互联网。\n\n"
MODE_ONLINE = "【检索模式】\n仅使用联网搜索/直连解析，未混入本地知识库。\n\n"
MODE_AUTO = "【检索模式】\n自动模式：本地知识库结果已达到阈值，命中 %s 个本地片段，本次未联网。\n\n"
MODE_BOTH = "【检索模式】\n本地知识库 + 联网搜索混合检索；本地命中 %s 个片段。\n\n"
MODE_SOME = "【检索模式】\n使用本地知识库；命中 %s 个片段。\n\n"


def say(template: str, *values: Column) -> Column:
    """%s-formatted; numbers as they print."""
    return F.format_string(template, *(filled(v.cast("string")) for v in values))


def lines(rows: DataFrame, order: Column, text: Column, separator: str = "\n", name: str = "body") -> DataFrame:
    """(qid, name): the texts of a question's rows in order; they are a report's few rows."""
    parts = F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return rows.groupBy("qid").agg(F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias(name))


def resource_label(intent: Column) -> Column:
    return lookup(intent, RESOURCE_LABELS, RESOURCE_LABELS["general"])


def answer_label(intent: Column) -> Column:
    return lookup(intent, ANSWER_LABELS, ANSWER_LABELS["concept"])


def suggestions(intent: Column) -> Column:
    out = F.array(*map(F.lit, COMMON))
    for kind, own in SUGGESTIONS.items():
        out = F.when(intent == kind, F.array(*map(F.lit, own + COMMON))).otherwise(out)
    return out


def numbered(items: Column) -> Column:
    return F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))


def search_list(queries: Column) -> Column:
    clean = F.array_distinct(F.filter(F.transform(queries, F.trim), lambda q: q != ""))
    return F.array_join(F.concat(F.array(F.lit("【实际搜索】")), numbered(clean)), "\n")


def short_query_report(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """(qid, report) for inputs too short to interpret: hits only."""
    c = F.col
    item = F.concat(
        say(SHORT_ITEM, c("rank"), c("title"), c("domain"), c("site_weight"), c("relevance"), c("final_score"), c("url")),
        F.when(filled(c("content")) != "", say("摘要：%s\n", F.substring(clean_snippet(c("content")), 1, 180))).otherwise(""))
    none = say(SHORT_NONE, c("question"))
    some = F.concat(say(SHORT_SOME, c("question")), c("body"), F.lit(SHORT_END))
    return questions.join(lines(ranked, c("rank"), item), "qid", "left").select("qid", F.coalesce(some, none).alias("report"))


def scored_sources(ranked: DataFrame) -> DataFrame:
    """(qid, sources): title, type, weight, relevance, score and evidence label of each source."""
    c = F.col
    item = say(SCORED_ITEM, c("rank"), c("title"), c("domain"), c("source_type"), c("site_weight"), c("relevance"), c("final_score"), c("evidence.label"), c("evidence.total"), c("url"))
    return lines(ranked, c("rank"), item, "\n\n", "body").select("qid", F.concat(F.lit("【来源评分】\n\n"), c("body")).alias("sources"))


def resource_report(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """(qid, report) of a search for material; questions: qid, question, resource_intent, queries."""
    c = F.col
    item = F.concat(
        say(RESOURCE_ITEM, c("rank"), c("title"), c("url"), c("domain"), c("source_type"), c("site_weight"), c("relevance"), c("final_score")),
        F.when(filled(c("content")) != "", say("摘要：%s\n", F.substring(clean_snippet(c("content")), 1, 260))).otherwise(""))
    label = resource_label(c("resource_intent"))
    none = say(RESOURCE_NONE, label, c("question"))
    some = F.concat_ws("\n", say(RESOURCE_SOME, label, c("question")), c("body"), F.lit("【使用建议】"), F.array_join(numbered(suggestions(c("resource_intent"))), "\n"), F.lit(""), c("sources"), F.lit(""), search_list(c("queries")))
    joined = questions.join(lines(ranked, c("rank"), item), "qid", "left").join(scored_sources(ranked), "qid", "left")
    return joined.select("qid", F.when(c("body").isNull(), none).otherwise(some).alias("report"))


def local_chain(cards: DataFrame) -> DataFrame:
    """(qid, chain): local evidence with its location."""
    c = F.col
    item = say(LOCAL_ITEM, c("evidence_id"), c("title"), c("location"), c("quote"), c("url"))
    return lines(cards, F.substring("evidence_id", 2, 9).cast("int"), item, "\n\n").select("qid", F.concat(F.lit("\n\n".join(LOCAL_HEAD) + "\n\n"), c("body")).alias("chain"))


def web_chain(cards: DataFrame) -> DataFrame:
    """(qid, chain): page evidence with its location and link."""
    c = F.col
    item = say(WEB_ITEM, c("evidence_id"), c("title"), c("location"), c("quote"), c("text_fragment_url"), c("url"))
    return lines(cards, F.substring("evidence_id", 2, 9).cast("int"), item).select("qid", F.concat(F.lit("\n".join(WEB_HEAD) + "\n"), c("body")).alias("chain"))


def item_evidence(cards: DataFrame) -> DataFrame:
    """(qid, url, evidence): a source's cards for a prompt."""
    item = say("- [%s] %s：%s", F.col("evidence_id"), F.col("location"), F.substring("quote", 1, 420))
    parts = F.sort_array(F.collect_list(F.struct(F.substring("evidence_id", 2, 9).cast("int").alias("o"), item.alias("t"))))
    return cards.groupBy("qid", "url").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("evidence"))


def evidence_only(questions: DataFrame, local: DataFrame, web: DataFrame) -> DataFrame:
    """(qid, report): cards alone, without a model."""
    joined = questions.join(local_chain(local).withColumnRenamed("chain", "l"), "qid", "left").join(web_chain(web).withColumnRenamed("chain", "w"), "qid", "left")
    body = F.when(F.col("l").isNull() & F.col("w").isNull(), F.lit("没有检索到可定位的证据。")).otherwise(F.concat_ws("\n\n", "l", "w"))
    return joined.select("qid", F.concat(say("【证据检索结果】\n问题：%s\n\n", F.col("question")), body).alias("report"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """(qid, summary): strength, counts and warnings of an audit."""
    c = F.col
    warned = F.when(F.size("warnings") > 0, F.array_join(numbered(c("warnings")), "\n")).otherwise(NO_WARNING)
    held = F.when(c("must_not_assert"), HELD).otherwise("")
    counts = say(AUDIT_COUNTS, c("strength"), c("fetched_count"), c("unique_domains"), c("primary_count"), c("caution_count"))
    return audit.select("qid", F.concat(F.lit("【反证/限制】\n"), warned, F.lit("\n\n【证据强度】\n"), counts, held).alias("summary"))


def insufficient_answer(audit: DataFrame) -> DataFrame:
    """(qid, answer) where the audit forbids an assertion."""
    held = audit.where("must_not_assert")
    head = say(INSUFFICIENT, F.col("strength"), F.col("primary_count"), F.col("fetched_count"))
    return held.join(audit_summary(held), "qid").select("qid", F.concat(head, F.lit("\n\n"), F.col("summary")).alias("answer"))


def model_context(ranked: DataFrame) -> DataFrame:
    """(qid, context): sources as a prompt shows them."""
    c = F.col
    text = F.substring(clean_snippet(F.array_join(F.slice("fetched_passages", 1, 3), " ")), 1, 760)
    item = say(CONTEXT_ITEM, c("rank"), c("title"), c("domain"), c("source_type"), c("site_weight"), c("relevance"), c("final_score"), c("evidence.label"), c("role"), c("evidence.total"), c("url"), F.substring(clean_snippet(c("content")), 1, 420), F.when(text != "", text).otherwise("未抓取到可用正文"))
    return lines(ranked, c("rank"), item, "\n", "context")


def mode_note(mode: Column, used_local: Column, used_web: Column, local_count: Column) -> Column:
    """What a report says about where it looked (strict style only)."""
    m = source_mode(mode)
    return (
        F.when(m == "local", say(MODE_LOCAL, local_count))
        .when(m == "online", F.lit(MODE_ONLINE))
        .when((m == "auto") & used_local & ~used_web, say(MODE_AUTO, local_count))
        .when(used_local & used_web, say(MODE_BOTH, local_count))
        .when(used_local, say(MODE_SOME, local_count)).otherwise("")
    )


def citation_note(answer: Column, cited: Column, chain: Column, kind: str = "网页") -> Column:
    """The answer, a word on its citations, and the evidence chain."""
    wrong = say(f"【引用校验】\n模型回答中出现了不存在的{kind}证据编号：%s。请以{kind}证据定位列表为准。", F.array_join(cited["invalid_ids"], ", "))
    bare = F.lit(f"【引用校验】\n模型回答未显式引用{kind}证据编号；下面列出本次检索得到的段落级{kind}证据，供人工核验。")
    note = F.when(F.size(cited["invalid_ids"]) > 0, wrong).when(~cited["has_any_citation"], bare)
    return F.when(filled(chain) == "", answer).otherwise(F.concat_ws("\n\n", F.rtrim(filled(answer)), note, chain))
