"""Queries over pages: reading, ranking, evidence, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.config import EngineConfig
from lodestone.functions import classify as C
from lodestone.functions import score as S
from lodestone.functions import text as X
from lodestone.functions.rewrite import resource_queries
from lodestone.functions.tokens import RELEVANCE_STOPWORDS
from lodestone.functions.urls import extract_domain, github_repo, normalize_domain, text_fragment_url
from lodestone.models import generate
from lodestone.operators import evidence as E
from lodestone.operators import render
from lodestone.operators.ranking import parse_weights, rank_hits, site_weight
from lodestone.operators.split import normalize_blocks
from lodestone.plans import duck as D
from lodestone.plans.catalog import register
from lodestone.plans.dialogue import core, query_tokens_sql, search_plan_sql
from lodestone.plans.inputs import asked, page_hits, seen_pages, table
from lodestone.sources.html import described_column, index_text_column, raw_blocks_column, readable_text_column
from lodestone.sources.web import fetch_refusal, fetched_pages, merge_hits

# Weights of the hosts that the tables have; a parent stands before its child, so the child's own never counts.
WEIGHTS = parse_weights("""
example.org 5
# pages of a farm
spam-farm.example.org 0
www.cheap-pills.example.com 0
example.com 3
blog.example.net 4
example.net 2
""")

_WEIGHT = "CASE WHEN domain = '' THEN 1 " + " ".join(f"WHEN domain = {D.q(n)} OR ends_with(domain, {D.q('.' + n)}) THEN {w}" for n, w in WEIGHTS) + " ELSE 1 END"
_TYPE = "CASE WHEN ends_with(domain, '.gov') OR ends_with(domain, '.edu') THEN 'official' " + " ".join(f"WHEN domain IN {D.listed(v)} THEN {D.q(k)}" for k, v in C.DOMAIN_TYPES.items()) + " WHEN contains(domain, '.wikipedia.org') THEN 'community' ELSE 'general' END"


@register("page_domains", f"""WITH seen AS ({D.SEEN}), d AS (SELECT page_id, {D.domain('url')} AS domain FROM seen)
SELECT page_id, domain, {_TYPE} AS source_type, {_WEIGHT} AS site_weight, {D.lookup(_TYPE, S.TYPE_BONUS, 0)} AS type_bonus, {D.lookup(_TYPE, S.TECHNICAL_PROJECT, 0)} AS project_bonus, {D.lookup(_TYPE, S.TECHNICAL_OTHER, 0)} AS technical_bonus FROM d""")
def page_domains(spark, sf_dir):
    d = F.col("domain")
    p = seen_pages(spark, sf_dir).select("page_id", extract_domain(F.col("url")).alias("domain")).withColumn("source_type", C.source_type(d))
    t = F.col("source_type")
    return p.select("page_id", normalize_domain(d).alias("domain"), "source_type", site_weight(d, WEIGHTS).alias("site_weight"), C.lookup(t, S.TYPE_BONUS, 0).alias("type_bonus"), S.technical_bonus(t, F.lit("project")).alias("project_bonus"), S.technical_bonus(t, F.lit("docs")).alias("technical_bonus"))


_TITLE = f"substr({D.snippet(D.sub(f'regexp_extract(html, {D.q("(?is)<title[^>]*>(.*?)</title>")}, 1)', '<[^>]+>', chr(39) + ' ' + chr(39)))}, 1, 180)"


def _date(x: str) -> str:
    e = lambda i: f"regexp_extract({x}, {D.q(X.DATE_TEXT)}, {i})"
    return f"CASE WHEN regexp_matches({x}, {D.q(X.DATE_TEXT)}) THEN {e(1)} || '-' || lpad({e(2)}, 2, '0') || CASE WHEN {e(3)} <> '' THEN '-' || lpad({e(3)}, 2, '0') ELSE '' END END"


_STATED = ", ".join(f"CASE WHEN regexp_matches(html, {D.q(p)}) THEN substr({D.snippet(f'regexp_extract(html, {D.q(p)}, 1)')}, 1, 40) END" for p in X.DATE_META)


@register("page_titles", f"WITH seen AS ({D.SEEN}) SELECT page_id, {_TITLE} AS title, coalesce({_STATED}, {_date('url')}, {_date('substr(html, 1, 5000)')}, '') AS published_at FROM seen")
def page_titles(spark, sf_dir):
    h = F.col("html")
    return seen_pages(spark, sf_dir).select("page_id", X.html_title(h, False).alias("title"), X.publication_date(h, F.col("url")).alias("published_at"))


@register("repo_urls", f"""WITH u AS (SELECT page_id, replace(url, regexp_extract(url, '://([^/?#]*)', 1), 'github.com') AS url FROM pages),
p AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM u)
SELECT page_id, parts[1] AS owner, {D.sub('parts[2]', '[.]git$')} AS repo FROM p WHERE len(parts) >= 2 AND {D.sub('parts[2]', '[.]git$')} <> ''""")
def repo_urls(spark, sf_dir):
    """Page urls as repository urls of one host."""
    url = F.expr("replace(url, regexp_extract(url, '://([^/?#]*)', 1), 'github.com')")
    return table(spark, sf_dir, "pages").select("page_id", github_repo(url).alias("r")).where("r is not null").select("page_id", "r.owner", "r.repo")


_PCT = "replace(replace(replace(url_encode({x}), '+', '%20'), '*', '%2A'), '%7E', '~')"
_FRAGMENT = f"""WITH b AS (SELECT item_id, {D.clean_web('text')} AS q FROM benchmark),
f AS (SELECT item_id, q, list_filter(list_transform({D.sentences('q')}, lambda p: {D.clean_web('p')}), lambda p: length(p) BETWEEN 24 AND 120) AS fits, {D.strip('substr(q, 1, 100)')} AS head FROM b),
s AS (SELECT item_id, q, coalesce(fits[1], CASE WHEN regexp_matches(head, '[A-Za-z]') AND contains(head, ' ') THEN regexp_replace(head, ' [^ ]*$', '') ELSE head END) AS s FROM f)
SELECT item_id, CASE WHEN length(q) < 12 THEN 'https://example.org/a#b' WHEN length(s) < 12 THEN 'https://example.org/a' ELSE 'https://example.org/a#:~:text=' || {_PCT.format(x='s')} END AS url FROM s"""


@register("text_fragments", _FRAGMENT)
def text_fragments(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text_fragment_url(F.lit("https://example.org/a#b"), F.col("text"), False).alias("url"))


@register("page_texts")
def page_texts(spark, sf_dir):
    """Three plain-text views of each page."""
    h = F.col("html")
    d = described_column(h)
    return table(spark, sf_dir, "pages").select("page_id", index_text_column(h).alias("index_text"), readable_text_column(h).alias("readable_text"), d.alias("d")).select("page_id", "index_text", "readable_text", "d.title", "d.body")


@register("page_blocks")
def page_blocks(spark, sf_dir):
    """Numbered evidence blocks of each page."""
    return table(spark, sf_dir, "pages").select("page_id", F.inline(normalize_blocks(raw_blocks_column(F.col("html")))))


@register("fetched_pages")
def fetched_pages_query(spark, sf_dir):
    return fetched_pages(seen_pages(spark, sf_dir)).drop("raw_blocks")


@register("merged_hits", f"""WITH h AS (SELECT page_id // 5 AS qid, page_id % 7 = 0 AS is_direct, page_id % 3 AS query_index, page_id AS position, trim({D.sub('url', '[?#].*$')}) AS url FROM pages WHERE url IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY qid, url ORDER BY is_direct DESC, query_index, position) AS n FROM h WHERE url <> '')
SELECT qid, position, url, CAST(row_number() OVER (PARTITION BY qid ORDER BY is_direct DESC, query_index, position, url) AS INTEGER) AS pos FROM k WHERE n = 1""")
def merged_hits(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where("url is not null")
    h = p.select(F.expr("page_id div 5").alias("qid"), (F.col("page_id") % 7 == 0).alias("is_direct"), (F.col("page_id") % 3).alias("query_index"), F.col("page_id").alias("position"), F.trim(F.regexp_replace("url", "[?#].*$", "")).alias("url"))
    return merge_hits(h).select("qid", "position", "url", "pos")


_HITS = f"""questions AS ({D.ASKED}), seen AS ({D.SEEN}),
raw AS (SELECT page_id // 5 AS qid, page_id AS pos, {_TITLE} AS title, url, {D.snippet(D.sub('html', '<[^>]+>', chr(39) + ' ' + chr(39)))} AS content, {D.domain('url')} AS domain FROM seen),
hits AS (SELECT raw.*, question, lower({D.strip(D.filled('question'))}) AS q, lower(title) AS lt, lower(content) AS lc, lower(url) AS lu, {D.relevance_tokens('question', RELEVANCE_STOPWORDS)} AS tokens,
  {D.first_kind('lower(question)', C.RESOURCE_WORDS, 'general')} AS intent, {D.any_of('lower(question)', C.TECHNICAL_WORDS)} AS technical, {_TYPE} AS source_type, {_WEIGHT} AS site_weight, {D.domains('question')} AS asked FROM raw JOIN questions USING (qid))"""
_RELEVANCE = f"""CASE WHEN len(tokens) = 0 THEN CASE WHEN q = '' THEN 0 WHEN contains(lt, q) THEN 10 WHEN contains(lc, q) THEN 5 WHEN contains(lu, q) THEN 2 ELSE 0 END
ELSE (CASE WHEN length(q) < 2 THEN 0 WHEN contains(lt, q) THEN 20 WHEN contains(lc, q) THEN 12 ELSE 0 END) + {D.total('tokens', 'CASE WHEN contains(lt, x) THEN 5 WHEN contains(lc, x) THEN 2 WHEN contains(lu, x) THEN 1 ELSE 0 END')} END"""
_QUERY = f"""CASE WHEN q = '' THEN 0 ELSE (CASE WHEN contains(lt, q) THEN 12 WHEN contains(lc, q) THEN 6 WHEN contains(lu, q) THEN 3 ELSE 0 END) + {D.total('list_slice(' + D.relevance_tokens('q', RELEVANCE_STOPWORDS) + ', 1, 8)', 'CASE WHEN contains(lt, x) THEN 2 WHEN contains(lc, x) THEN 1 ELSE 0 END')} END"""
_SOURCE = f"{D.lookup('source_type', S.TYPE_BONUS, 0)} + CASE WHEN NOT technical THEN 0 WHEN intent = 'project' THEN {D.lookup('source_type', S.TECHNICAL_PROJECT, 0)} ELSE {D.lookup('source_type', S.TECHNICAL_OTHER, 0)} END"
_INTENT = "CASE intent " + " ".join(
    f"WHEN {D.q(k)} THEN " + " + ".join(f"(CASE WHEN contains(lower(title || ' ' || url || ' '), {D.q(p)}) THEN 10 ELSE 0 END)" for p in ps) + (f" + {D.lookup('source_type', S.INTENT_TYPES[k], 0)}" if k in S.INTENT_TYPES else "")
    for k, ps in S.INTENT_PATTERNS.items()) + " ELSE 0 END"
def _ranked(least: int) -> str:
    return f"""{_HITS},
scored AS (SELECT *, {_RELEVANCE} AS relevance, {_QUERY} AS query_bonus, {_SOURCE} AS source_bonus, {_INTENT} AS intent_bonus FROM hits WHERE site_weight <> 0 AND (len(asked) = 0 OR domain = '' OR list_contains(asked, domain)) AND NOT {D.any_of("lower(title || ' ' || content || ' ' || url)", C.NOISE_WORDS)}),
final AS (SELECT *, relevance * 6 + query_bonus + source_bonus + intent_bonus + site_weight * 6 + 0.0::DOUBLE AS final_score FROM scored WHERE relevance >= {least}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, pos) AS rank FROM final)"""


_RANKED = _ranked(1)



@register("ranked_hits", f"WITH {_RANKED} SELECT qid, CAST(rank AS INTEGER) AS rank, pos, domain, source_type, site_weight, CAST(relevance AS INTEGER) AS relevance, CAST(query_bonus AS INTEGER) AS query_bonus, CAST(source_bonus AS INTEGER) AS source_bonus, CAST(intent_bonus AS INTEGER) AS intent_bonus, final_score FROM ranked WHERE rank <= 6")
def ranked_hits(spark, sf_dir):
    ranked = rank_hits(page_hits(spark, sf_dir), WEIGHTS)
    return ranked.select("qid", "rank", "pos", "domain", "source_type", "site_weight", "relevance", "query_bonus", "source_bonus", "intent_bonus", "final_score")


_METRICS = f"""top AS (SELECT *, {D.any_of('lower(question)', C.TIMELY_WORDS)} AS timely, count(*) OVER (PARTITION BY qid, domain) AS same_domain, lower(title || ' ' || content || ' ' || '' || ' ' || url) AS every FROM ranked WHERE rank <= 6),
hit AS (SELECT *, {D.total(core('tokens', 10), 'CASE WHEN contains(every, x) THEN 1 ELSE 0 END')} AS found FROM top),
parts AS (SELECT *, {D.lookup('source_type', S.AUTHORITY, 2)} AS authority, CASE WHEN relevance >= 20 THEN 5 WHEN relevance >= 12 THEN 4 WHEN relevance >= 6 THEN 3 WHEN relevance >= 2 THEN 2 ELSE 1 END AS relevant,
  CASE WHEN found >= 5 THEN 5 WHEN found >= 3 THEN 4 WHEN found >= 2 THEN 3 WHEN found >= 1 THEN 2 ELSE 1 END AS specific, CASE WHEN timely THEN 2 ELSE 3 END AS fresh, CASE WHEN content <> '' THEN 3 ELSE 1 END AS depth,
  CASE WHEN same_domain <= 1 OR domain = '' THEN 5 WHEN same_domain = 2 THEN 3 ELSE 2 END AS independent FROM hit),
metrics AS (SELECT *, authority * 2 + relevant * 2 + specific + fresh + depth + independent AS total,
  CASE WHEN {D.any_of("lower(title || ' ' || content || '  ')", C.NEGATIVE_WORDS)} THEN '限制/反证' WHEN source_type IN {D.listed(C.PRIMARY_TYPES)} THEN '支持证据' ELSE '背景资料' END AS role FROM parts)"""


@register("evidence_metrics", f"WITH {_RANKED}, {_METRICS} SELECT qid, CAST(rank AS INTEGER) AS rank, authority, relevant AS relevance, specific AS specificity, fresh AS freshness, depth AS content_depth, independent AS independence, total, CASE WHEN total >= 29 THEN '强' WHEN total >= 22 THEN '中' ELSE '弱' END AS label, role FROM metrics")
def evidence_metrics(spark, sf_dir):
    a = E.audited(rank_hits(page_hits(spark, sf_dir), WEIGHTS))
    parts = ("authority", "relevance", "specificity", "freshness", "content_depth", "independence", "total", "label")
    return a.select("qid", "rank", *(F.col(f"evidence.{p}").alias(p) for p in parts), "role")


_AUDIT = f"""{_RANKED}, {_METRICS},
n AS (SELECT qid, count(*) AS cards, count(*) FILTER (total >= 29) AS strong, count(*) FILTER (total BETWEEN 22 AND 28) AS medium, count(*) FILTER (source_type IN {D.listed(C.PRIMARY_TYPES)}) AS prim, count(*) FILTER (role = '限制/反证') AS caution, count(DISTINCT domain) AS domains FROM metrics GROUP BY qid),
j AS (SELECT q.qid, {D.any_of('lower(question)', C.TIMELY_WORDS)} AS timely, coalesce(cards, 0) AS cards, coalesce(strong, 0) AS strong, coalesce(medium, 0) AS medium, coalesce(prim, 0) AS prim, coalesce(caution, 0) AS caution, coalesce(domains, 0) AS domains FROM questions q LEFT JOIN n USING (qid)),
s AS (SELECT *, CASE WHEN strong >= 2 AND prim >= 2 AND domains >= 2 THEN '高' WHEN (strong >= 1 OR medium >= 2) AND prim >= 1 THEN '中' WHEN cards > 0 THEN '低' ELSE '不足' END AS strength FROM j),
audit AS (SELECT *, (strength IN ('低', '不足') AND timely) OR (prim = 0 AND cards <= 2) AS held, list_filter([CASE WHEN cards = 0 THEN {D.q(E.NO_SOURCE)} END, CASE WHEN prim = 0 THEN {D.q(E.NO_PRIMARY)} END, CASE WHEN timely THEN {D.q(E.NO_DATE)} END, CASE WHEN cards > 0 THEN {D.q(E.NO_PAGE)} END,
  CASE WHEN caution > 0 THEN {D.q(E.CAUTION)} END, CASE WHEN domains <= 1 AND cards >= 3 THEN {D.q(E.ONE_DOMAIN)} END], lambda x: x IS NOT NULL) AS warnings FROM s),
summaries AS (SELECT *, '【反证/限制】' || chr(10) || CASE WHEN len(warnings) > 0 THEN {D.numbered('warnings')} ELSE {D.q(render.NO_WARNING)} END || chr(10) || chr(10) || '【证据强度】' || chr(10)
  || {D.say(render.AUDIT_COUNTS, 'strength', '0', 'domains', 'prim', 'caution')} || CASE WHEN held THEN {D.q(render.HELD)} ELSE '' END AS summary FROM audit)"""


@register("evidence_audit", f"WITH {_AUDIT} SELECT qid, strength, cards, prim AS primary_count, caution AS caution_count, domains AS unique_domains, held AS must_not_assert, CAST(len(warnings) AS INTEGER) AS n_warnings FROM audit")
def evidence_audit(spark, sf_dir):
    a = E.audit(rank_hits(page_hits(spark, sf_dir), WEIGHTS), asked(spark, sf_dir))
    return a.select("qid", "strength", "cards", "primary_count", "caution_count", "unique_domains", "must_not_assert", F.size("warnings").alias("n_warnings"))


def _enriched(spark, sf_dir):
    ranked = rank_hits(page_hits(spark, sf_dir), WEIGHTS)
    return E.enrich(ranked, fetched_pages(seen_pages(spark, sf_dir)), EngineConfig().fast_fetch)


@register("enriched_hits")
def enriched_hits(spark, sf_dir):
    """Ranked hits with page text and the passages that fit the question."""
    return _enriched(spark, sf_dir).select("qid", "rank", "url", "content", "fetched_ok", "fetch_error", "fetched_title", "published_at", "fetched_passages")


@register("web_evidence")
def web_evidence(spark, sf_dir):
    return E.web_cards(_enriched(spark, sf_dir))


@register("block_scores", f"""WITH {_RANKED}, top AS (SELECT qid, rank, question AS text, lower(title || ' ' || url || ' ' || content) AS every, lower(content) AS low, content FROM ranked WHERE rank <= 6),
t AS (SELECT *, {query_tokens_sql(20)} AS terms FROM top)
SELECT qid, CAST(rank AS INTEGER) AS rank, CASE WHEN len(terms) = 0 THEN 0 ELSE coalesce(list_sum(list_transform(terms, lambda t: CASE WHEN contains(low, lower(t)) THEN (CASE WHEN length(t) >= 4 THEN 5.0 ELSE 3.0 END + CASE WHEN regexp_matches(t, '[A-Za-z]') THEN 2.5 ELSE 0.0 END)::DOUBLE WHEN contains(every, lower(t)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)), 0)
+ (CASE WHEN length(content) BETWEEN 40 AND 600 THEN 2 WHEN length(content) > 1200 THEN -2 ELSE 0 END) + (CASE WHEN regexp_matches(content, {D.q(S.EVIDENCE_WORDS)}) THEN 2 ELSE 0 END) END::DOUBLE AS score FROM t""")
def block_scores(spark, sf_dir):
    """Each ranked hit's content scored as one block."""
    r = rank_hits(page_hits(spark, sf_dir), WEIGHTS)
    return r.select("qid", "rank", S.block_score(F.col("question"), F.col("content"), F.lit("p"), F.col("title"), F.col("url")).alias("score"))


_PASSAGE_ROWS = f"""said AS (SELECT qid, pos, content, {D.relevance_tokens('question', RELEVANCE_STOPWORDS)} AS tokens FROM raw JOIN questions USING (qid)),
sentences AS (SELECT qid, pos, tokens, unnest(s) AS part, generate_subscripts(s, 1) AS i FROM (SELECT qid, pos, tokens, list_transform({D.sentences(D.one_spaced(D.filled('content')))}, lambda p: {D.snippet('p')}) AS s FROM said)),
cut AS (SELECT qid, pos, tokens, i, 0 AS off, part AS p FROM sentences WHERE length(part) BETWEEN 40 AND 900
  UNION ALL SELECT qid, pos, tokens, i, off, {D.snippet('substr(part, CAST(off + 1 AS BIGINT), 620)')} FROM (SELECT *, unnest(range(0, least(length(part), 2600), 520)) AS off FROM sentences WHERE length(part) > 900)),
listed AS (SELECT *, row_number() OVER (PARTITION BY qid, pos ORDER BY i, off) AS k FROM cut WHERE length(p) >= 40),
scored AS (SELECT qid, pos, k, p, {D.total('list_slice(tokens, 1, 16)', 'CASE WHEN contains(lower(p), lower(x)) THEN CASE WHEN length(x) >= 4 THEN 4 ELSE 2 END ELSE 0 END')} + CASE WHEN regexp_matches(lower(p), {D.q(S.PASSAGE_WORDS)}) THEN 2 ELSE 0 END + CASE WHEN regexp_matches(p, {D.q(S.PASSAGE_WORDS_HAN)}) THEN 2 ELSE 0 END AS s FROM listed WHERE k <= 220),
unlike AS (SELECT *, row_number() OVER (PARTITION BY qid, pos, substr(p, 1, 90) ORDER BY s DESC, k) AS a FROM scored WHERE s > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY qid, pos ORDER BY s DESC, k) AS n FROM unlike WHERE a = 1)"""


@register("relevant_passages", f"WITH {_HITS}, {_PASSAGE_ROWS} SELECT qid, pos, CAST(n - 1 AS INTEGER) AS n, p AS passage FROM best WHERE n <= 4")
def relevant_passages(spark, sf_dir):
    """The best passages of each page for its question."""
    h = page_hits(spark, sf_dir)
    return h.select("qid", "pos", F.posexplode(E.relevant_passages(F.col("question"), F.col("content"))).alias("n", "passage"))


@register("noise_pages", f"SELECT page_id, {D.any_of(f'lower({_TITLE} || chr(32) || html || chr(32) || url)', C.NOISE_WORDS)} AS noise FROM pages")
def noise_pages(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", C.is_noise(X.html_title(h, False), h, F.lit(""), F.col("url")).alias("noise"))


@register("fetch_refusals", """WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '.ZIP' WHEN 2 THEN replace(url, 'http', 'ftp') ELSE ' ' || url END AS url, CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/png' ELSE NULL END AS kind FROM pages)
SELECT page_id, CASE WHEN NOT regexp_matches(lower(trim(coalesce(url, ''))), '^https?://') THEN 'not http' WHEN regexp_matches(lower(trim(url)), '[.](zip|tar|gz|7z|rar|exe|dmg|whl)$') THEN 'archive'
WHEN kind = 'image/png' THEN 'content type' END AS refusal FROM u""")
def fetch_refusals(spark, sf_dir):
    """Why page urls in four spellings would not be fetched."""
    i, u = F.col("page_id"), F.col("url")
    url = F.when(i % 4 == 0, u).when(i % 4 == 1, F.concat(u, F.lit(".ZIP"))).when(i % 4 == 2, F.replace(u, F.lit("http"), F.lit("ftp"))).otherwise(F.concat(F.lit(" "), u))
    kind = F.when(i % 3 == 0, "text/html").when(i % 3 == 1, "image/png")
    return table(spark, sf_dir, "pages").select("page_id", fetch_refusal(url, kind).alias("refusal"))


_ABOUT = "CASE WHEN content <> '' THEN '摘要：' || substr(content, 1, {n}) || chr(10) ELSE '' END"


@register("short_reports", f"""WITH {_ranked(0)}, items AS (SELECT qid, string_agg({D.say(render.SHORT_ITEM, 'rank', 'title', 'domain', 'site_weight', 'relevance', 'final_score', 'url')} || {_ABOUT.format(n=180)}, chr(10) ORDER BY rank) AS body FROM ranked WHERE rank <= 6 GROUP BY qid)
SELECT qid, CASE WHEN body IS NULL THEN {D.say(render.SHORT_NONE, 'question')} ELSE {D.say(render.SHORT_SOME, 'question')} || body || {D.q(render.SHORT_END)} END AS report FROM questions LEFT JOIN items USING (qid)""")
def short_reports(spark, sf_dir):
    """Reports that only list hits, as for inputs too short to interpret."""
    return render.short_query_report(asked(spark, sf_dir), rank_hits(page_hits(spark, sf_dir), WEIGHTS, 0))


@register("model_contexts")
def model_contexts(spark, sf_dir):
    """Sources as a prompt shows them, and the stub model's answer to it."""
    context = render.model_context(E.audited(_enriched(spark, sf_dir)))
    answers = generate(context.select("qid", F.col("context").alias("prompt")))
    return context.join(answers, "qid").select("qid", "context", X.clean_model_answer(F.col("answer")).alias("answer"))


@register("audit_summaries", f"WITH {_AUDIT} SELECT qid, summary FROM summaries")
def audit_summaries(spark, sf_dir):
    return render.audit_summary(E.audit(rank_hits(page_hits(spark, sf_dir), WEIGHTS), asked(spark, sf_dir)))


_LABEL = D.lookup("intent", C.RESOURCE_LABELS, C.RESOURCE_LABELS["general"])


@register("resource_reports", f"""WITH {_AUDIT}, items AS (SELECT qid, string_agg({D.say(render.RESOURCE_ITEM, 'rank', 'title', 'url', 'domain', 'source_type', 'site_weight', 'relevance', 'final_score')} || {_ABOUT.format(n=260)}, chr(10) ORDER BY rank) AS body,
  '【来源评分】' || chr(10) || chr(10) || string_agg({D.say(render.SCORED_ITEM, 'rank', 'title', 'domain', 'source_type', 'site_weight', 'relevance', 'final_score', "CASE WHEN total >= 29 THEN '强' WHEN total >= 22 THEN '中' ELSE '弱' END", 'total', 'url')}, chr(10) || chr(10) ORDER BY rank) AS sources FROM metrics GROUP BY qid),
plans AS ({search_plan_sql('questions')}), asked_for AS (SELECT q.*, p.searches, p.suggestions, {D.first_kind('lower(question)', C.RESOURCE_WORDS, 'general')} AS intent FROM questions q JOIN plans p USING (qid))
SELECT qid, CASE WHEN body IS NULL THEN {D.say(render.RESOURCE_NONE, _LABEL, 'question')} ELSE concat_ws(chr(10), {D.say(render.RESOURCE_SOME, _LABEL, 'question')}, body, '【使用建议】',
  {D.numbered("string_split(suggestions, chr(10))")}, '', sources, '', searches) END AS report FROM asked_for LEFT JOIN items USING (qid)""")
def resource_reports(spark, sf_dir):
    ranked = E.audited(rank_hits(page_hits(spark, sf_dir), WEIGHTS))
    q = asked(spark, sf_dir).withColumn("resource_intent", C.detect_resource_intent(F.col("question")))
    return render.resource_report(q.withColumn("queries", resource_queries(F.col("question"), F.col("resource_intent"))), ranked)


@register("evidence_reports")
def evidence_reports(spark, sf_dir):
    """Cards alone, as the evidence-only mode prints them."""
    enriched = _enriched(spark, sf_dir)
    local = E.local_cards(enriched.withColumns({c: F.lit(None).cast(t) for c, t in (("kb_doc_id", "long"), ("kb_chunk_index", "int"), ("kb_location", "string"), ("kb_path", "string"), ("kb_quote", "string"), ("kb_score", "double"), ("kb_paragraph_start", "int"), ("kb_paragraph_end", "int"))}))
    return render.evidence_only(asked(spark, sf_dir), local, E.web_cards(enriched))


@register("held_answers", f"WITH {_AUDIT} SELECT qid, {D.say(render.INSUFFICIENT, 'strength', 'prim', '0')} || chr(10) || chr(10) || summary AS answer FROM summaries WHERE held")
def held_answers(spark, sf_dir):
    """What is said where the audit forbids an assertion."""
    return render.insufficient_answer(E.audit(rank_hits(page_hits(spark, sf_dir), WEIGHTS), asked(spark, sf_dir)))


