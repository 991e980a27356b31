"""From questions to answers as one plan: union of sources, ranking, page text, audit, prompt, model, notes.

Every step is keyed by ``qid``; a question takes exactly one of the branches evidence, direct,
resource, held, empty or model, and only the last one reaches the model.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone import models
from lodestone.config import EngineConfig
from lodestone.functions.classify import detect_task_type, source_flags
from lodestone.functions.text import clean_model_answer, filled
from lodestone.operators import evidence as E
from lodestone.operators import render as R
from lodestone.operators.answers import direct_answers
from lodestone.operators.ranking import rank_hits
from lodestone.operators.search import local_is_enough

SYSTEM = "You answer search questions. State only what the given sources support, name the limits of that support, and say so plainly where it is too thin for an answer."
PLAIN_STYLES = ("plain", "normal", "simple", "concise")

# Headings and sentences that readers of answers rely on.
SECTIONS = ["【核心结论】", "【简要依据】", "【证据链】", "【详细分析】", "【不确定部分】", "【主要来源】"]
NO_RESULTS = (
    "【核心结论】\n没有找到与问题足够相关的搜索结果，不能强行给出结论。\n\n"
    "【简要依据】\n1. 原始问题：%s\n2. 实际搜索词：%s\n3. 当前 SearXNG 返回结果与问题的相关性不足。\n\n"
    "【详细分析】\n1. 可能是问题太短、实体不明确，或搜索词没有覆盖关键概念。\n2. 也可能是搜索结果摘要中没有包含足够可验证信息。\n\n"
    "【不确定部分】\n资料不足。建议补充系统版本、软件名称、错误提示、模型名或目标场景后重新搜索。\n\n"
    "【主要来源】\n未找到足够相关的来源。"
)
NO_ANSWER = "【核心结论】\n模型没有生成有效回答。\n\n【不确定部分】\n资料不足。\n\n【主要来源】\n未找到可用来源。"
AUDIT_HEAD = "综合证据强度：%s\n是否禁止强结论：%s\n成功抓取正文来源数：%s；独立域名数：%s；主要来源数：%s"
AUDIT_CARD = "[%s] %s | %s | %s | 角色：%s | 强度：%s | 分数：%s"

PLAIN_RULES = "用简洁的中文先直接回答，再补充二到四个要点，不用大标题；来源不支持的内容要说明，不得编造；有 [L1] 或 [E1] 这类编号时，在关键事实后标注。"
STRICT_RULES = (
    "Check the premise of the question, then answer within the limits that the evidence audit sets. Cite [L..] and [E..] ids after each "
    "key fact and invent none. Use these sections in this order, each heading on a line of its own, without Markdown: "
)
INTENT_RULES = {
    "concept": "Define the object, then its purpose, limits and usual misunderstandings.",
    "comparison": "Compare by scenario, cost and failure mode; name no overall winner.",
    "troubleshooting": "Give likely causes and the order in which to check them.",
    "recommendation": "State the conditions of a recommendation before it.",
}


def system_prompt(path: str | None = None) -> str:
    """The text of a prompt file, or SYSTEM where the file is missing or blank."""
    found = Path(path) if path else None
    text = found.read_text(encoding="utf-8", errors="ignore").strip() if found and found.exists() else ""
    return text or SYSTEM


def merge_sources(local: DataFrame, web: DataFrame) -> DataFrame:
    """Local hits, then web hits, each in its order (``pos`` in both); columns that one side lacks are null there."""
    both = local.withColumn("_side", F.lit(0)).unionByName(web.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy("qid").orderBy("_side", "pos", "url")
    return both.withColumn("pos", F.row_number().over(order)).drop("_side")


def audit_context(audit: DataFrame, cards: DataFrame) -> DataFrame:
    """(qid, audit_context): an audit and its cards as a prompt shows them.  cards: of evidence.audited()."""
    c = F.col
    head = R.say(AUDIT_HEAD, c("strength"), F.when(c("must_not_assert"), "是").otherwise("否"), c("fetched_count"), c("unique_domains"), c("primary_count"))
    listed = F.transform(F.slice("warnings", 1, 6), lambda w: F.concat(F.lit("- "), w))
    warned = F.when(F.size("warnings") > 0, F.concat(F.lit("审计警告：\n"), F.array_join(listed, "\n")))
    card = R.say(AUDIT_CARD, c("rank"), c("title"), c("domain"), c("source_type"), c("role"), c("evidence.label"), c("evidence.total"))
    dated = F.when(filled(c("published_at")) != "", F.concat(F.lit("日期："), c("published_at")))
    excerpt = F.when(filled(c("excerpt")) != "", F.concat(F.lit("摘录："), F.substring("excerpt", 1, 520)))
    body = R.lines(cards.where("rank <= 8"), c("rank"), F.concat_ws("\n", card, dated, excerpt))
    return audit.join(body, "qid", "left").select("qid", F.concat_ws("\n", head, warned, F.lit("证据卡片："), c("body")).alias("audit_context"))


def answer_prompts(questions: DataFrame, ranked: DataFrame, audit: DataFrame, style: str = "plain") -> DataFrame:
    """(qid, prompt) for each question (qid, question, search_query, answer_intent) that has ranked sources."""
    cards = E.audited(ranked)
    c = F.col
    intent = F.lit("")
    for kind, rule in INTENT_RULES.items():
        intent = F.when(c("answer_intent") == kind, rule).otherwise(intent)
    rules = F.lit(PLAIN_RULES) if style in PLAIN_STYLES else F.concat(F.lit(STRICT_RULES + " ".join(SECTIONS) + "\n"), intent, F.lit("\n回答类型："), R.answer_label(c("answer_intent")))
    shown = F.concat(rules, R.say("\n\n用户问题：\n%s\n\n实际搜索词：\n%s\n\n证据审计：\n%s\n\n搜索结果和正文摘录：\n%s", c("question"), c("search_query"), c("audit_context"), c("context")))
    return questions.join(R.model_context(cards), "qid").join(audit_context(audit, cards), "qid", "left").select("qid", shown.alias("prompt"))


def _once(df: DataFrame) -> DataFrame:
    """df, written if the session names a checkpoint folder, because every branch reads it."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def _branch(evidence_only: bool) -> Column:
    c = F.col
    return (
        F.when(F.lit(evidence_only), "evidence").when((c("task") == "answer") & c("direct").isNotNull(), "direct").when(c("task") == "resource", "resource")
        .when(c("must_not_assert"), "held").when(c("sources") == 0, "empty").otherwise("model")
    )


def ask(
    questions: DataFrame, local: DataFrame, web: DataFrame, pages: DataFrame, weights: list[tuple[str, int]],
    config: EngineConfig = EngineConfig(), make: Callable[[], models.Generator] = models.Extractive, evidence_only: bool = False,
    once: Callable[[DataFrame], DataFrame] = _once,
) -> DataFrame:
    """(qid, branch, answer) of each question (qid, question, search_query, resource_intent, answer_intent).

    local and web: hits with ``pos`` as ``rank_hits`` takes them (without question and intent); pages: fetched ones
    by url.  Local hits are left out in mode online, web hits in mode local and, in auto, where the local ones are
    enough.  A question without any hit still gets a row; no questions give no rows.  once: how a table that
    several branches read is written and read again.
    """
    c = F.col
    enough = local_is_enough(local.withColumnRenamed("kb_score", "score"), config.kb_enough_results, config.kb_enough_score)
    counts = local.groupBy("qid").agg(F.count("*").alias("local_count"))
    q = questions.join(enough, "qid", "left").join(counts, "qid", "left").fillna(0, ["local_count"])
    q = q.withColumns({"_flags": source_flags(F.lit(config.search_mode), c("enough")), "task": detect_task_type(c("question"))})
    hits = merge_sources(local.join(q.where("_flags.use_local").select("qid"), "qid", "left_semi"), web.join(q.where("_flags.use_web").select("qid"), "qid", "left_semi"))
    depth = config.depth("fast")
    ranked = rank_hits(hits.join(questions.select("qid", "question", "resource_intent"), "qid"), weights, config.min_relevance, depth["final_results"], config.default_site_weight)
    ranked = once(E.enrich(ranked, pages, depth["fetch_top_n"]))
    cards, audit = once(E.audited(ranked)), once(E.audit(ranked, questions))
    local_cards = once(E.local_cards(ranked, config.evidence_max_total))
    web_cards = once(E.web_cards(ranked, config.evidence_max_total, config.evidence_per_source))
    direct = direct_answers(ranked).select("qid", c("answer").alias("direct"))
    sources = ranked.groupBy("qid").agg(F.count("*").alias("sources"))
    q = q.join(direct, "qid", "left").join(sources, "qid", "left").fillna(0, ["sources"]).join(audit.select("qid", "must_not_assert"), "qid", "left")
    q = once(q.withColumn("branch", _branch(evidence_only)))
    searched = F.array_distinct(F.filter(F.array(filled(c("search_query")), filled(c("question"))), lambda x: x != ""))
    of = lambda branch: q.where(c("branch") == branch)
    prompts = answer_prompts(of("model").select("qid", "question", "search_query", "answer_intent"), ranked, audit, config.answer_style)
    said = models.generate(prompts, make).select("qid", clean_model_answer(c("answer")).alias("said"))
    resources = of("resource").select("qid", "question", "resource_intent", searched.alias("queries"))
    bodies = (
        said.select("qid", F.when(c("said") == "", NO_ANSWER).otherwise(c("said")).alias("body"))
        .union(of("direct").select("qid", "direct"))
        .union(R.resource_report(resources, cards.join(resources.select("qid"), "qid", "left_semi")).select("qid", "report"))
        .union(R.insufficient_answer(audit.join(of("held").select("qid"), "qid", "left_semi")).select("qid", "answer"))
        .union(of("empty").select("qid", R.say(NO_RESULTS, c("question"), c("search_query"))))
        .union(R.evidence_only(of("evidence").select("qid", "question"), local_cards, web_cards).select("qid", "report"))
    )
    out = q.join(bodies, "qid", "left")
    for chain, kind, letter, numbered in ((R.local_chain(local_cards), "本地", "L", local_cards), (R.web_chain(web_cards), "网页", "E", web_cards)):
        valid = numbered.groupBy("qid").agg(F.collect_list("evidence_id").alias("_valid"))  # at most evidence_max_total
        out = out.join(chain, "qid", "left").join(valid, "qid", "left")
        noted = R.citation_note(c("body"), E.citations(c("body"), c("_valid"), letter), c("chain"), kind)
        skip = c("branch") == "evidence" if letter == "L" else c("branch").isin("evidence", "direct")
        out = out.withColumn("body", F.when(skip, c("body")).otherwise(noted)).drop("chain", "_valid")
    strict = F.lit(config.answer_style not in PLAIN_STYLES)
    shown = R.scored_sources(cards.join(of("direct").select("qid", F.lit(3).alias("_most")), "qid", "left").where("rank <= coalesce(_most, rank)"))
    out = out.join(shown.withColumnRenamed("sources", "sources_text"), "qid", "left")
    listed = (c("branch") == "direct") | (strict & c("branch").isin("held", "model"))
    out = out.withColumn("body", F.concat_ws("\n\n", F.coalesce("body", F.lit(NO_ANSWER)), F.when(listed, c("sources_text"))))
    note = R.mode_note(F.lit(config.search_mode), c("_flags.use_local") & (c("local_count") > 0), c("_flags.use_web"), c("local_count"))
    note = F.when(strict & (c("branch") != "evidence"), note).otherwise("")
    tail = F.when(c("branch").isin("evidence", "direct", "resource"), "").otherwise(F.concat(F.lit("\n\n"), R.search_list(searched)))
    return out.select("qid", "branch", F.concat(note, c("body"), tail).alias("answer"))
