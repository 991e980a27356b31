"""Direct answers from quiz blocks, and model answers with their guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.rewrite import looks_like_answer, preserving_query, rule_translate
from lodestone.functions.classify import is_bad_query
from lodestone.functions.score import overlap_score
from lodestone.functions.text import WS, clean_answer_block, clean_one_line, filled, let, strip, sub
from lodestone.operators.split import options, question_blocks

# Patterns and sentences of a direct answer.
CORRECT_IS = "根据本地知识库，正确答案是："
CORRECT_KEY = "根据本地知识库，正确答案是 "
OTHERS_ARE = "该题题干问的是“不包括”，因此除正确选项外，其余选项可作为题干所指的基本要素："
EXPLAINED = "这是从本地知识库中的结构化“正确答案”字段直接抽取的结果，未调用模型生成长回答。"
CORRECT = rf"(?i)正确答案{WS}*[:：]{WS}*([A-H]|对|错|正确|错误){WS}*(?:[:：]{WS}*([^;；\n]+))?"
STEM_END = rf"(?i)(?:\n|{WS}|·){WS}*A{WS}*[.．、:：]|我的答案|正确答案"


def correct_key(block: Column) -> Column:
    return F.upper(F.regexp_extract(block, CORRECT, 1))


def correct_text(block: Column) -> Column:
    return clean_answer_block(F.regexp_extract(block, CORRECT, 2))


def stem(block: Column) -> Column:
    head = sub(F.element_at(F.split(block, STEM_END, 2), 1), rf"^{WS}*\d+\.{WS}*")
    return F.substring(clean_answer_block(head), 1, 260)


def direct_answers(hits: DataFrame) -> DataFrame:
    """(qid, answer, source_title, source_url, score) where a hit's quiz block states the correct answer.

    hits: qid, question, rank, title, url, content.  The block with most terms of the question
    counts, the first of equals; one without any is no answer to a longer question.
    """
    blocks = hits.select("qid", "question", "rank", "title", "url", F.posexplode(question_blocks(F.col("content"))).alias("n", "block")).where(F.contains("block", F.lit("正确答案")))
    blocks = blocks.withColumn("score", overlap_score(F.col("question"), F.col("block")))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "rank", "n")
    b = blocks.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    b = b.where((F.col("score") > 0) | (F.length(strip(F.col("question"))) <= 10))
    b = b.withColumn("key", correct_key(F.col("block"))).where("key <> ''").withColumn("options", options(F.col("block")))
    stated = correct_text(F.col("block"))
    b = b.withColumn("text", F.when(stated != "", stated).otherwise(F.coalesce(F.try_element_at("options", F.col("key")), F.lit(""))))
    truth = F.when(F.col("key").isin("对", "正确"), "对").otherwise("错")
    verdict = (
        F.when(F.col("key").isin("对", "错", "正确", "错误"), F.concat(F.lit(CORRECT_IS), truth, F.lit("。")))
        .when(F.col("text") != "", F.concat(F.lit(CORRECT_KEY), F.col("key"), F.lit("："), F.col("text"), F.lit("。")))
        .otherwise(F.concat(F.lit(CORRECT_KEY), F.col("key"), F.lit("。")))
    )
    entries = F.map_entries("options")
    rest = F.slice(F.transform(F.filter(entries, lambda e: e["key"] != F.col("key")), lambda e: F.concat(F.lit("- "), e["value"])), 1, 6)
    asks_rest = F.col("question").rlike("三个|三.*要素|哪些|哪三") & F.contains("block", F.lit("不包括")) & F.map_contains_key("options", F.col("key")) & (F.size(rest) > 0)
    included = F.when(asks_rest, F.concat(F.lit(f"\n\n{OTHERS_ARE}\n"), F.array_join(rest, "\n"))).otherwise("")
    head, listed = stem(F.col("block")), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "；")
    source = F.concat(F.lit("来源："), filled(F.col("title")), F.when(filled(F.col("url")) != "", F.concat(F.lit("（"), F.col("url"), F.lit("）"))).otherwise(""))
    lines = F.array_compact(F.array(
        F.lit("【依据】"), F.when(head != "", F.concat(F.lit("命中的题目："), head)), F.when(F.size("options") > 0, F.concat(F.lit("选项："), listed)), source,
        F.lit(""), F.lit("【说明】"), F.lit(EXPLAINED)))
    answer = F.concat(F.lit("【直接答案】\n"), verdict, included, F.lit("\n\n"), F.array_join(lines, "\n"))
    return b.select("qid", answer.alias("answer"), F.col("title").alias("source_title"), F.col("url").alias("source_url"), F.col("score").cast("int").alias("score"))


def guarded_query(question: Column, model_output: Column) -> Column:
    """A model's search query, or the question where the query lost it."""
    return let(lambda query, q: _unless_bad(q, F.when(query != "", query).otherwise(q)), clean_one_line(model_output), strip(question))


def _unless_bad(question: Column, query: Column) -> Column:
    return let(lambda x: F.when(is_bad_query(question, x), question).otherwise(x), query)


def guarded_english_query(question: Column, model_output: Column) -> Column:
    """A rule's English query, else a model's unless it answers or loses the question."""

    def of(q: Column, said: Column, ruled: Column, kept: Column) -> Column:
        query = let(lambda x: F.when(looks_like_answer(q, x) & (kept != ""), kept).otherwise(x), F.when(said != "", said).otherwise(q))
        return F.when(ruled != "", ruled).otherwise(_unless_bad(q, query))

    return strip(F.substring(let(of, strip(question), clean_one_line(model_output), rule_translate(question, True), preserving_query(question, True)), 1, 220))


def guarded_translation(text: Column, model_output: Column) -> Column:
    """A rule's translation, else a model's unless it answers; then a rule's with all constraints, else the text."""

    def of(t: Column, ruled: Column, said: Column, kept: Column) -> Column:
        fallback = F.when(kept != "", kept).otherwise(t)
        return F.when(ruled != "", ruled).when(looks_like_answer(t, said), fallback).otherwise(said)

    t = strip(filled(text))
    return let(of, t, rule_translate(t), clean_one_line(model_output, 500), preserving_query(t))
