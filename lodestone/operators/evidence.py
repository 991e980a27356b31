"""Evidence of ranked hits: passages, numbered cards, metrics, audit, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import score as S
from lodestone.functions.classify import PRIMARY_TYPES, evidence_role, is_timely
from lodestone.functions.text import clean_snippet, clean_web, evidence_quote, filled, let
from lodestone.functions.tokens import relevance_tokens
from lodestone.functions.urls import text_fragment_url
from lodestone.operators.split import normalize_blocks, passages, text_blocks

MOST_BLOCKS, MOST_PASSAGES = 260, 220
# Warnings of the audit.
NO_SOURCE = "没有进入最终回答的来源。"
NO_PRIMARY = "缺少官方文档、论文、官方仓库或高权威技术来源。"
NO_DATE = "问题具有时效性/版本性，但未检测到明确发布日期或版本页。"
NO_PAGE = "没有成功抓取正文，只能依赖搜索摘要，结论必须保守。"
CAUTION = "检索到可能的限制、反例、报错或不支持信息，需要在结论中保留条件。"
ONE_DOMAIN = "来源域名过于集中，独立性不足。"


def relevant_passages(question: Column, text: Column, most: int = 4) -> Column:
    """The best passages of a text for a question: those that score, best first, no two alike."""

    def of(tokens: Column, parts: Column) -> Column:
        scored = F.transform(F.slice(parts, 1, MOST_PASSAGES), lambda p, i: F.struct((-S.passage_score(tokens, p)).alias("s"), i.alias("i"), p.alias("p")))
        best = F.transform(F.array_sort(F.filter(scored, lambda x: x["s"] < 0)), lambda x: x["p"])
        return let(first_alike, best)

    def first_alike(best: Column) -> Column:
        heads = F.transform(best, lambda p: F.substring(p, 1, 90))
        return F.slice(let(lambda h: F.filter(best, lambda p, i: F.array_position(h, F.substring(p, 1, 90)) == i + 1), heads), 1, most)

    return let(of, relevance_tokens(question), passages(text))


def enrich(ranked: DataFrame, pages: DataFrame, top_n: int = 3) -> DataFrame:
    """Ranked hits with page text and passages: local ones from their content, the first top_n positions from pages by url.

    A page's first two passages replace the content; relevance stays as it was ranked.
    """
    p = pages.select(F.col("url").alias("_u"), "ok", "error", F.col("title").alias("_t"), F.col("published_at").alias("_d"), F.col("text").alias("_x"), "raw_blocks").dropDuplicates(["_u"])
    local = (F.col("source_type") == "local_kb") | F.startswith(filled(F.col("url")), F.lit("file:"))
    ranked = ranked if "published_at" in ranked.columns else ranked.withColumn("published_at", F.lit(None).cast("string"))
    h = ranked.withColumn("_local", local).withColumn("_fetch", ~F.col("_local") & (F.col("rank") <= top_n))
    h = h.join(p, F.col("_fetch") & (F.col("url") == F.col("_u")), "left")
    text = F.when(F.col("_local"), filled(F.col("content"))).when(F.col("_fetch") & F.coalesce("ok", F.lit(False)), filled(F.col("_x"))).otherwise("")
    h = h.withColumn("fetched_text", text).withColumn("_p", relevant_passages(F.col("question"), F.col("fetched_text")))
    found = F.when((F.size("_p") == 0) & F.col("_local"), F.array(F.substring(filled(F.col("content")), 1, 760))).otherwise(F.col("_p"))
    h = h.withColumn("fetched_passages", found)
    short = clean_snippet(F.array_join(F.slice("fetched_passages", 1, 2), " "))
    replaced = F.when(F.col("_fetch") & (F.size("fetched_passages") > 0) & (short != ""), short).otherwise(F.col("content"))
    return h.withColumns({
        "content": replaced, "fetched_ok": F.col("_local") | (F.col("_fetch") & F.coalesce("ok", F.lit(False))), "fetch_error": F.when(F.col("_fetch"), F.coalesce("error", F.when(F.col("_u").isNull(), F.lit("not found")), F.lit(""))).otherwise(""),
        "fetched_title": F.when(F.col("_local"), F.col("title")).otherwise(filled(F.col("_t"))),
        "published_at": F.when(F.col("_fetch"), filled(F.col("_d"))).otherwise(F.col("published_at")),
        "raw_blocks": F.when(F.col("_fetch") & F.coalesce("ok", F.lit(False)), F.col("raw_blocks")),
    }).drop("_local", "_fetch", "_u", "ok", "error", "_t", "_d", "_x", "_p")


def web_cards(enriched: DataFrame, max_total: int = 8, per_source: int = 2) -> DataFrame:
    """Numbered evidence (E1, E2, ...) from page blocks: the best of each source, then in rank order up to max_total."""
    web = enriched.where(filled(F.col("url")).rlike("^https?://") & (F.col("source_type") != "local_kb"))
    plain = F.when(filled(F.col("fetched_text")) != "", F.col("fetched_text")).otherwise(F.array_join(F.coalesce("fetched_passages", F.array().cast("array<string>")), " "))
    from_text = normalize_blocks(text_blocks(plain, entities=False))
    from_page = normalize_blocks(F.coalesce("raw_blocks", F.expr("cast(array() as array<struct<tag:string,text:string>>)")))
    rows = web.withColumn("_title", F.when(filled(F.col("fetched_title")) != "", F.col("fetched_title")).otherwise(F.col("title"))).withColumn("_blocks", from_page)
    rows = rows.withColumn("_blocks", F.slice(F.when(F.size("_blocks") > 0, F.col("_blocks")).otherwise(from_text), 1, MOST_BLOCKS))
    b = rows.select("qid", "rank", "question", "url", "domain", F.col("_title").alias("title"), F.explode("_blocks").alias("b"))
    b = b.withColumn("score", S.block_score(F.col("question"), F.col("b.text"), F.col("b.tag"), F.col("title"), F.col("url"))).where("score > 0")
    b = b.withColumn("quote", clean_web(F.col("b.text"), 520, entities=False))
    source = ["qid", "rank"]
    alike = Window.partitionBy(*source, F.lower(F.substring("quote", 1, 120))).orderBy(F.desc("score"), "b.block_index")
    best = Window.partitionBy(*source).orderBy(F.desc("score"), "b.block_index")
    b = b.withColumn("_a", F.row_number().over(alike)).where("_a = 1").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= max(1, per_source))
    b = b.withColumn("_e", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "_n"))).where(F.col("_e") <= max_total)
    return b.select(
        "qid", F.concat(F.lit("E"), F.col("_e").cast("string")).alias("evidence_id"), F.lit("web").alias("source_type"), "title", "url", "domain", F.col("b.location").alias("location"),
        F.col("b.block_index").alias("block_start"), F.col("b.block_index").alias("block_end"), F.col("b.paragraph_index").alias("paragraph_index"), F.col("b.block_id").alias("block_id"), F.col("b.tag").alias("tag"),
        "quote", F.round("score", 2).alias("score"), text_fragment_url(F.col("url"), F.col("quote"), entities=False).alias("text_fragment_url"),
    )


def local_cards(ranked: DataFrame, max_total: int = 8) -> DataFrame:
    """Numbered evidence (L1, L2, ...) from local hits in rank order, each chunk once."""
    local = ranked.where((F.col("source_type") == "local_kb") | F.startswith(filled(F.col("url")), F.lit("file:")))
    key = F.coalesce(F.concat_ws("#", F.col("kb_doc_id").cast("string"), F.col("kb_chunk_index").cast("string")), F.lit(""))
    key = F.when(key != "", key).otherwise(F.concat(filled(F.col("url")), F.substring(filled(F.col("content")), 1, 100)))
    once = local.withColumn("_k", key).withColumn("_n", F.row_number().over(Window.partitionBy("qid", "_k").orderBy("rank"))).where("_n = 1")
    once = once.withColumn("_l", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("_l") <= max_total)
    some = lambda *c: F.coalesce(*(F.when(filled(F.col(x)) != "", F.col(x)) for x in c), F.lit(""))
    return once.select(
        "qid", F.concat(F.lit("L"), F.col("_l").cast("string")).alias("evidence_id"), F.lit("local_kb").alias("source_type"), "title", "url", some("kb_location", "kb_path", "title").alias("location"),
        evidence_quote(some("kb_quote", "content")).alias("quote"), F.coalesce("kb_score", F.lit(0.0)).alias("score"), F.col("kb_chunk_index").alias("chunk_id"), F.col("kb_paragraph_start").alias("paragraph_start"), F.col("kb_paragraph_end").alias("paragraph_end"),
    )


def citations(answer: Column, valid: Column, letter: str) -> Column:
    """Which evidence an answer cites, and whether all of it exists."""

    def judged(valid: Column, cited: Column) -> Column:
        wrong = F.array_sort(F.array_except(cited, valid))
        ok = (F.size(valid) == 0) | ((F.size(cited) > 0) & (F.size(wrong) == 0))
        return F.struct((F.size(valid) > 0).alias("has_evidence"), valid.alias("valid_ids"), cited.alias("cited_ids"), wrong.alias("invalid_ids"), (F.size(cited) > 0).alias("has_any_citation"), ok.alias("ok"))

    none = F.expr("cast(array() as array<string>)")
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(filled(answer), F.lit(rf"\[({letter}\d+)\]"), F.lit(1))))
    return let(judged, F.array_sort(F.array_distinct(F.coalesce(valid, none))), found)


def audited(ranked: DataFrame) -> DataFrame:
    """Ranked hits with evidence metrics and an excerpt.  A blank domain is counted as unknown and looked up as none."""
    r = ranked
    for name, kind in (("fetched_passages", "array<string>"), ("fetched_text", "string"), ("published_at", "string"), ("fetched_ok", "boolean")):
        r = r if name in r.columns else r.withColumn(name, F.lit(None).cast(kind))
    known = F.when(filled(F.col("domain")) != "", F.col("domain")).otherwise("unknown")
    n = F.when(filled(F.col("domain")) == "", 1).otherwise(F.count("*").over(Window.partitionBy("qid", known)))
    r = r.withColumn("_n", n)
    m = S.evidence_metrics(F.col("question"), F.col("source_type"), F.col("relevance"), F.col("title"), F.col("content"), F.col("fetched_passages"), F.col("url"), F.col("published_at"), F.col("_n"))
    excerpt = F.when(F.size(F.coalesce("fetched_passages", F.expr("cast(array() as array<string>)"))) > 0, F.try_element_at("fetched_passages", F.lit(1))).otherwise(F.substring(clean_snippet(F.col("content")), 1, 360))
    return r.withColumn("evidence", m).withColumn("role", evidence_role(F.col("title"), F.col("content"), F.col("fetched_text"), F.col("source_type"))).withColumn("excerpt", excerpt).drop("_n")


def audit(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """One row for each (qid, question): how strong its evidence is, what to warn of, and whether to hold back."""
    a = audited(ranked)
    label = F.col("evidence.label")
    n = a.groupBy("qid").agg(
        F.count("*").alias("cards"), F.count_if(label == "强").alias("strong_count"), F.count_if(label == "中").alias("medium_count"),
        F.count_if(F.col("source_type").isin(*PRIMARY_TYPES)).alias("primary_count"), F.count_if(F.col("role") == "限制/反证").alias("caution_count"),
        F.count_if(F.coalesce("fetched_ok", F.lit(False))).alias("fetched_count"), F.count_distinct(F.when(filled(F.col("domain")) != "", F.col("domain"))).alias("unique_domains"),
        F.count_if(filled(F.col("published_at")) != "").alias("dated_count"))
    counts = ["cards", "strong_count", "medium_count", "primary_count", "caution_count", "fetched_count", "unique_domains", "dated_count"]
    q = questions.select("qid", "question").join(n, "qid", "left").fillna(0, counts).withColumn("_timely", is_timely(F.col("question")))
    c = F.col
    strength = (
        F.when((c("strong_count") >= 2) & (c("primary_count") >= 2) & (c("unique_domains") >= 2), "高")
        .when(((c("strong_count") >= 1) | (c("medium_count") >= 2)) & (c("primary_count") >= 1), "中").when(c("cards") > 0, "低").otherwise("不足")
    )
    warnings = F.array_compact(F.array(
        F.when(c("cards") == 0, F.lit(NO_SOURCE)),
        F.when(c("primary_count") == 0, F.lit(NO_PRIMARY)),
        F.when(c("_timely") & (c("dated_count") == 0), F.lit(NO_DATE)),
        F.when((c("fetched_count") == 0) & (c("cards") > 0), F.lit(NO_PAGE)),
        F.when(c("caution_count") > 0, F.lit(CAUTION)),
        F.when((c("unique_domains") <= 1) & (c("cards") >= 3), F.lit(ONE_DOMAIN)),
    ))
    q = q.withColumn("strength", strength).withColumn("warnings", warnings)
    hold = (c("strength").isin("低", "不足") & c("_timely")) | ((c("primary_count") == 0) & (c("cards") <= 2))
    return q.withColumn("must_not_assert", hold).drop("_timely")
