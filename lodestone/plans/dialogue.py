"""Queries over the questions and answers of conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import rewrite as R
from lodestone.functions import text as X
from lodestone.functions import tokens as N
from lodestone.functions.score import overlap_score
from lodestone.functions.urls import direct_domains, extract_urls
from lodestone.operators.answers import CORRECT_IS, CORRECT_KEY, EXPLAINED, OTHERS_ARE, direct_answers, guarded_english_query, guarded_query, guarded_translation
from lodestone.operators.evidence import citations
from lodestone.operators.render import COMMON, SUGGESTIONS, answer_label, resource_label, search_list, suggestions
from lodestone.operators.split import options, question_blocks
from lodestone.plans import duck as D
from lodestone.plans.catalog import register
from lodestone.plans.inputs import asked, in_turn, questions, table

_Q = f"WITH questions AS ({D.ASKED})"
_STRIPPED = D.strip(D.filled("question"))
_LOW = f"lower({D.filled('question')})"
_TOKENS = D.relevance_tokens("question", N.RELEVANCE_STOPWORDS)
_ENTITIES = D.distinct(
    f"list_filter(list_transform(regexp_extract_all({D.filled('question')}, {D.q('[A-Za-z][A-Za-z0-9_.:@/+-]{1,}')}), lambda x: {D.sub('x', '^[.,;:!?，。；：！？()' + chr(92) + '[' + chr(92) + ']{}<>《》' + chr(34) + chr(39) + ']+|[.,;:!?，。；：！？()' + chr(92) + '[' + chr(92) + ']{}<>《》' + chr(34) + chr(39) + ']+$')}), "
    f"lambda x: x <> '' AND lower(x) NOT IN {D.listed(N.ENTITY_STOPWORDS)})"
)
# Core terms: by falling score, then position; zero-padded keys sort like the numbers they stand for.
_CORE = (
    "list_transform(list_sort(list_transform(list_filter({t}, lambda x: NOT regexp_matches(x, '" + "|".join(N.CORE_BAD_FRAGMENTS) + "')), "
    "lambda x, i: {{'s': -(length(x) + CASE WHEN regexp_matches(x, '[0-9]') THEN 3 ELSE 0 END + CASE WHEN x IN " + D.listed(N.CORE_KNOWN) + " THEN 3 ELSE 0 END), 'i': i, 'x': x}})), lambda v: v.x)"
)


def core(tokens: str, most: int) -> str:
    return f"list_slice({_CORE.format(t=tokens)}, 1, {most})"


@register("question_classes", f"""{_Q} SELECT qid, CASE WHEN {D.any_of(f'lower({_STRIPPED})', C.TASK_WORDS)} THEN 'resource' ELSE 'answer' END AS task_type, intent AS resource_intent, {D.first_kind(_LOW, C.ANSWER_WORDS, 'concept')} AS answer_intent,
CASE WHEN intent IN ('project', 'docs', 'tutorial', 'troubleshooting') THEN 'it' WHEN intent = 'paper' THEN 'science' ELSE 'general' END AS category,
{D.any_of(_LOW, C.TECHNICAL_WORDS)} AS technical, {D.any_of(_LOW, C.TIMELY_WORDS)} AS timely, regexp_matches(question, '[a-zA-Z]{{3,}}') OR {D.any_of(_LOW, C.TECHNICAL_WORDS)} AS wants_english,
regexp_matches({D.sub('question', '[。！？!?，,' + D.WS[1:-1] + ']+')}, '^([一-鿿]{{1,6}}|[a-zA-Z0-9_.+#/-]{{1,12}})$') AS short_ambiguous, regexp_matches(question, '[一-鿿]') AS has_han
FROM (SELECT *, {D.first_kind(_LOW, C.RESOURCE_WORDS, 'general')} AS intent FROM questions)""")
def question_classes(spark, sf_dir):
    q, intent = F.col("question"), C.detect_resource_intent(F.col("question"))
    return asked(spark, sf_dir).select(
        "qid", C.detect_task_type(q).alias("task_type"), intent.alias("resource_intent"), C.detect_answer_intent(q).alias("answer_intent"), C.search_category(intent).alias("category"), C.is_technical(q).alias("technical"),
        C.is_timely(q).alias("timely"), C.wants_english_query(q).alias("wants_english"), C.is_short_ambiguous(q).alias("short_ambiguous"), X.contains_han(q).alias("has_han"))


@register("relevance_tokens", f"{_Q} SELECT qid, array_to_string({_TOKENS}, ' ') AS tokens FROM questions")
def relevance_tokens(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", F.array_join(N.relevance_tokens(F.col("question")), " ").alias("tokens"))


_LATIN = f"list_filter(regexp_extract_all(text, {D.q('[A-Za-z][A-Za-z0-9_+.-]{1,}|[0-9]+(?:[.][0-9]+)?')}), lambda x: length(x) >= 2 AND lower(x) NOT IN {D.listed(N.QUERY_STOPWORDS_LATIN)})"
_HAN = f"list_filter(regexp_extract_all(text, '[一-鿿]{{2,12}}'), lambda x: x NOT IN {D.listed(N.QUERY_STOPWORDS_HAN)})"
_SYNONYMS = " || ".join(f"CASE WHEN contains(lower(text), {D.q(k)}) THEN [{', '.join(map(D.q, v))}] ELSE [] END" for k, v in N.QUERY_SYNONYMS.items())


def query_tokens_sql(most: int) -> str:
    """Tokens of ``text``, first of each spelling regardless of case."""
    return f"list_slice(list_extract(list_transform([{_LATIN} || {_HAN} || {_SYNONYMS}], lambda l: list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)), 1), 1, {most})"


@register("query_tokens", f"SELECT conv_id, turn, array_to_string({query_tokens_sql(16)}, '|') AS tokens FROM conversations WHERE text IS NOT NULL")
def query_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.array_join(N.query_tokens(F.col("text")), "|").alias("tokens"))


@register("answer_terms", f"""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, {D.q('[A-Za-z][A-Za-z0-9_-]{1,}|[0-9]+|[一-鿿]{2,}')}), lambda x: lower(x)) || {D.grams("regexp_replace(text, '[^一-鿿]', '', 'g')", 2)}, lambda x: x <> {D.q(N.ANSWER_STOPWORD)}))), '|') AS terms
FROM conversations WHERE text IS NOT NULL""")
def answer_terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.array_join(F.array_sort(N.answer_terms(F.col("text"))), "|").alias("terms"))


def _answer_terms(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, {D.q('[A-Za-z][A-Za-z0-9_-]{1,}|[0-9]+|[一-鿿]{2,}')}), lambda y: lower(y)) || {D.grams(f"regexp_replace({x}, '[^一-鿿]', '', 'g')", 2)}, lambda y: y <> {D.q(N.ANSWER_STOPWORD)}))"


@register("overlap_scores", f"""{_Q}, c AS (SELECT conv_id AS qid, turn, text FROM conversations WHERE text IS NOT NULL)
SELECT qid, turn, text, CAST(len(list_intersect({_answer_terms('question')}, {_answer_terms('text')})) AS INTEGER) AS overlap FROM c JOIN questions USING (qid)""")
def overlap_scores(spark, sf_dir):
    """Terms that each turn shares with the question of its conversation."""
    c = table(spark, sf_dir, "conversations").where("text is not null").withColumnRenamed("conv_id", "qid")
    return c.join(asked(spark, sf_dir), "qid").select("qid", "turn", "text", overlap_score(F.col("question"), F.col("text")).alias("overlap"))


@register("core_terms", f"{_Q} SELECT qid, array_to_string({core(_TOKENS, 8)}, '|') AS terms FROM questions")
def core_terms(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", F.array_join(N.core_terms(F.col("question")), "|").alias("terms"))


@register("ascii_entities", f"{_Q} SELECT qid, array_to_string({_ENTITIES}, '|') AS entities FROM questions")
def ascii_entities(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", F.array_join(N.ascii_entities(F.col("question")), "|").alias("entities"))


@register("unique_words", f"""SELECT conv_id, array_to_string(list_extract(list_transform([list_filter(string_split(text, ' '), lambda x: x <> '')], lambda l: list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i)), 1), ' ') AS words
FROM (SELECT conv_id, {D.one_spaced("string_agg(text, ' ' ORDER BY turn, text)")} AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)""")
def unique_words(spark, sf_dir):
    """Words of each conversation, first of each spelling regardless of case."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda v: v["text"]), " ")  # one conversation
    return c.groupBy("conv_id").agg(text.alias("t")).select("conv_id", F.array_join(N.unique_keep_order(F.split("t", X.WS)), " ").alias("words"))


_ONE_LINE = D.strip(D.filled("text"))
for _mark in ('"', "'", "`"):
    _ONE_LINE = D.sub(_ONE_LINE, f"^{_mark}+|{_mark}+$")
for _label in X.QUERY_LABELS:
    _ONE_LINE = f"(SELECT CASE WHEN starts_with(t, {D.q(_label)}) THEN {D.strip(f'substr(t, {len(_label) + 1})')} ELSE t END FROM (SELECT {_ONE_LINE} AS t))"


@register("one_line", f"SELECT conv_id, turn, {D.strip(f'substr({D.sub(_ONE_LINE, X.WS + chr(43), chr(39) + chr(32) + chr(39))}, 1, 240)')} AS line FROM conversations")
def one_line(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.clean_one_line(F.col("text")).alias("line"))


@register("model_answers", f"""SELECT conv_id, turn, {D.strip(D.sub("array_to_string(list_filter(list_transform(regexp_split_to_array(" + D.strip(D.filled('text')) + ", '" + chr(92) + "r" + chr(92) + "n|[" + chr(92) + "n" + chr(92) + "r]'), lambda x: replace(" + D.sub(D.sub('x', X.WS + '+$'), '^' + X.WS + '{0,3}#{1,6}' + X.WS + '*') + ", '**', '')), lambda x: NOT regexp_matches(x, '^" + X.WS + "*[-=_]{3,}" + X.WS + "*$')), chr(10))", chr(92) + 'n{3,}', 'chr(10) || chr(10)'))} AS answer
FROM conversations WHERE role = 'assistant'""")
def model_answers(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", X.clean_model_answer(F.col("text")).alias("answer"))


_FILLED = _STRIPPED
for _word in R.FILLERS:
    _FILLED = f"replace({_FILLED}, {D.q(_word)}, ' ')"
_BASE = D.sub(D.sub(D.sub(D.one_spaced(_FILLED), R.FILLERS_ENGLISH, "' '"), X.WS + "+", "' '"), r"^[ \-:：]+|[ \-:：]+$")
_BASE_ROWS = f"SELECT qid, question, {_STRIPPED} AS s, CASE WHEN {_BASE} <> '' THEN {_BASE} ELSE {_STRIPPED} END AS base FROM questions"
_BASED = f"{_Q}, based AS ({_BASE_ROWS})"
_SUFFIXED = "CASE intent " + " ".join(
    f"WHEN {D.q(k)} THEN [base, " + ", ".join("s" if v is None else f"{D.strip(f'base || {D.q(chr(32) + v)}')}" for v in vs) + "]" for k, vs in R.INTENT_SUFFIXES.items()) + " END"


@register("resource_queries", f"{_BASED}, kinds AS (SELECT *, {D.first_kind(_LOW, C.RESOURCE_WORDS, 'general')} AS intent FROM based) SELECT qid, base, array_to_string({D.distinct(f'list_filter({_SUFFIXED}, lambda x: x <> chr(0))')}, '|') AS queries FROM kinds")
def resource_queries(spark, sf_dir):
    q = F.col("question")
    return asked(spark, sf_dir).select("qid", R.resource_query(q).alias("base"), F.array_join(R.resource_queries(q, C.detect_resource_intent(q)), "|").alias("queries"))


def _when(condition: str, *tails: str) -> list[str]:
    return [f"CASE WHEN {condition} THEN stem || {D.q(' ' + t)} END" for t in tails]


_ASK = {k: D.any_of("lower(s)", v) for k, v in R.ASKS.items()}
_CANDIDATES = ", ".join([
    "CASE WHEN base <> '' THEN base END", *_when("TRUE", "official documentation"), *_when("TRUE", "docs"), *_when(_ASK["version"], "release notes changelog", "compatibility support unsupported"),
    *_when(f"({_ASK['issue']} OR answer_intent = 'troubleshooting')", "error issue fix", "site:github.com issue"), *_when("TRUE", "limitation unsupported deprecated", "not supported issue"),
    *_when(f"({_ASK['paper']} OR intent = 'paper')", "arxiv paper", "openreview"), *_when("(intent = 'project' OR contains(lower(s), 'github'))", "site:github.com")])
_CLEANED = D.strip(f"substr({D.sub('c', X.WS + '+', chr(39) + chr(32) + chr(39))}, 1, 220)")


@register("query_templates", f"""{_BASED},
kinds AS (SELECT *, {D.first_kind(_LOW, C.RESOURCE_WORDS, 'general')} AS intent, {D.first_kind(_LOW, C.ANSWER_WORDS, 'concept')} AS answer_intent, {_TOKENS} AS tokens FROM based),
stems AS (SELECT *, CASE WHEN len(tokens) > 0 AND len({core('tokens', 7)}) > 0 THEN array_to_string({core('tokens', 7)}, ' ') ELSE base END AS stem FROM kinds),
listed AS (SELECT qid, s, base, tokens, list_filter(list_transform(list_filter([{_CANDIDATES}], lambda c: c IS NOT NULL), lambda c: {_CLEANED}), lambda c: c <> '') AS cs FROM stems),
good AS (SELECT qid, list_filter(cs, lambda c: c = base OR NOT (
  len({D.relevance_tokens('c', N.RELEVANCE_STOPWORDS)}) = 0 OR (length(s) <= 4 AND NOT contains(c, s))
  OR (len(list_filter(tokens, lambda t: regexp_matches(t, '[a-zA-Z0-9]'))) > 0 AND NOT list_has_any(list_filter(tokens, lambda t: regexp_matches(t, '[a-zA-Z0-9]')), {D.relevance_tokens('c', N.RELEVANCE_STOPWORDS)})))) AS cs FROM listed)
SELECT qid, array_to_string(list_slice({D.distinct('cs')}, 1, 5), '|') AS queries FROM good""")
def query_templates(spark, sf_dir):
    q = F.col("question")
    return asked(spark, sf_dir).select("qid", F.array_join(R.query_templates(q, R.resource_query(q), C.detect_answer_intent(q), C.detect_resource_intent(q), 5), "|").alias("queries"))


_MAPPED = "[" + ", ".join(f"CASE WHEN contains(lower({_STRIPPED}), {D.q(k)}) THEN {D.q(v)} END" for k, v in R.KB_TRANSLATIONS.items()) + "]"


@register("kb_query_expansion", f"{_Q} SELECT qid, nullif(array_to_string({D.distinct(f'list_filter({_MAPPED}, lambda x: x IS NOT NULL)')}, ' '), '') AS expanded FROM questions")
def kb_query_expansion(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", R.expand_kb_query(F.col("question")).alias("expanded"))


@register("bad_queries", f"""WITH a AS (SELECT conv_id, arg_min(text, (turn, text)) AS question FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY 1), b AS (SELECT conv_id, arg_max(text, (turn, text)) AS query FROM conversations WHERE text IS NOT NULL GROUP BY 1),
t AS (SELECT conv_id, question, query, {_TOKENS} AS x, {D.relevance_tokens('query', N.RELEVANCE_STOPWORDS)} AS y FROM a JOIN b USING (conv_id))
SELECT conv_id, len(y) = 0 OR (length({_STRIPPED}) <= 4 AND NOT contains(query, {_STRIPPED})) OR (len(list_filter(x, lambda t: regexp_matches(t, '[a-zA-Z0-9]'))) > 0 AND NOT list_has_any(list_filter(x, lambda t: regexp_matches(t, '[a-zA-Z0-9]')), y)) AS bad FROM t""")
def bad_queries(spark, sf_dir):
    """Whether the last turn of a conversation would do as a query for its question."""
    c = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "text")).alias("query"))
    return questions(spark, sf_dir).withColumnRenamed("qid", "conv_id").join(c, "conv_id").select("conv_id", C.is_bad_query(F.col("question"), F.col("query")).alias("bad"))


#: Translations that the guards are to judge, in turn.
SAID = ("Codex is a tool for coding", "what is Codex", "find an open source project for Deep Research usage with its latest commit three weeks ago", "", "papers about transformer", "ChatGPT service status risk and Codex quota of an open source repository, last commit 3 weeks ago")
_HAS = {k: D.any_of("c", words) for k, words in {
    "open_": ("开源",), "project": ("项目", "仓库", "源码", "代码"), "level": ("服务降级风险等级", "降级风险等级"), "degraded": ("服务降级", "降级风险"), "research": ("深度研究",), "used": ("用量", "使用量", "额度"),
    "fetch_": ("获取", "查询", "查看"), "info": ("信息", "数据"), "latest": ("最新一次提交", "最后一次提交", "最近一次提交"), "commit_": ("提交",), "three": ("三周之前", "3周之前", "三周前", "3周前"),
    "two": ("两周之前", "2周之前", "两周前", "2周前"), "month_": ("一个月之前", "1个月之前", "一个月前", "1个月前"), "find_": ("找", "搜索", "查找", "需要")}.items()}
_GIVES = " || ".join(f"CASE WHEN {when} THEN {given} ELSE [] END" for when, given in (
    ("open_", "['open source']"), ("project", "['project', 'GitHub repository']"), ("TRUE", "names"), ("level", "['service degradation risk level']"), ("NOT level AND degraded", "['service degradation risk']"), ("research", "['Deep Research']"),
    ("used", "['usage']"), ("fetch_", "['fetch']"), ("info", "['information']"), ("latest", "['latest commit']"), ("NOT latest AND commit_", "['commit']"), ("three", "['three weeks ago']"), ("NOT three AND two", "['two weeks ago']"), ("NOT three AND NOT two AND month_", "['one month ago']")))
_DETAILS = "array_to_string(list_filter([CASE WHEN list_contains(names, 'ChatGPT') AND degraded THEN 'ChatGPT service degradation risk level' END, CASE WHEN research THEN 'Deep Research' END, CASE WHEN list_contains(names, 'Codex') AND used THEN 'Codex usage' WHEN used THEN 'usage' END], lambda x: x IS NOT NULL), ', ')"
_TAIL = "CASE WHEN three THEN ', with its latest commit three weeks ago' WHEN two THEN ', with its latest commit two weeks ago' WHEN month_ THEN ', with its latest commit one month ago' WHEN latest THEN ', with its latest commit matching the query' ELSE '' END"
_RULES = (
    ("contains(c, '工具') AND (contains(c, '什么样') OR contains(c, '是什么') OR contains(c, '什么'))", "%s tool", "what kind of tool is %s"), ("contains(c, '是什么') OR contains(c, '是啥')", "%s what is", "what is %s"),
    ("contains(c, '怎么用') OR contains(c, '如何使用') OR contains(c, '怎么使用')", "%s how to use", "how to use %s"), ("contains(c, '安装') OR contains(c, '部署')", "%s install setup", "how to install and set up %s"),
    ("contains(c, '报错') OR contains(c, '错误') OR contains(c, '异常') OR contains(c, '失败')", "%s error fix", "how to fix errors in %s"), ("contains(c, '论文') OR contains(lower(c), 'paper')", "%s paper", "papers about %s"),
    (f"{D.any_of('c', ('项目', '仓库', '源码', '代码'))} AND length(c) <= 24", "%s GitHub repository", "GitHub repository for %s"))


def _ruled(kept: str, form: int) -> str:
    long = f"{kept} <> '' AND (length(c) >= 28 OR len(names) >= 2 OR contains(c, '开源') OR contains(c, '最新') OR contains(c, '用量'))"
    rules = " ".join(f"WHEN {r[0]} THEN {D.say(r[form], 'names[1]')}" for r in _RULES)
    return f"CASE WHEN NOT han THEN '' WHEN len(names) = 0 OR ({long}) THEN {kept} ELSE CASE {rules} ELSE {kept} END END"


_LOST = " OR ".join(["len(list_filter(names, lambda e: NOT contains(lower(said), lower(e)))) > 0", *(f"({D.any_of('c', had)} AND NOT {D.any_of('lower(said)', needs)})" for had, needs in R.REQUIRED), f"(length(c) >= 35 AND length({D.strip('said')}) < 35)"])
_TOLD = f"{D.strip('said')}"
_STATES = f"len(names) > 0 AND regexp_matches(lower({_TOLD}), {D.q(chr(92) + 'bis' + X.WS + '+(a|an|the)' + chr(92) + 'b')}) AND NOT contains({_TOLD}, '?') AND NOT regexp_matches(lower({_TOLD}), '^(what|how|why|when|where|which|whether)')"


@register("rule_translations", f"""{_Q}, t AS (SELECT qid, {D.sub(_STRIPPED, X.WS + '+')} AS c, {_ENTITIES} AS names, regexp_matches(question, '[一-鿿]') AS han, {D.in_turn('qid', SAID)} AS said FROM questions),
s AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _HAS.items())} FROM t),
g AS (SELECT *, {D.first_spelling(_GIVES)} AS terms FROM s),
d AS (SELECT *, array_to_string(terms, ' ') AS joined, {_DETAILS} AS details FROM g),
k AS (SELECT *, CASE WHEN han AND len(terms) >= 3 THEN joined ELSE '' END AS searched,
  CASE WHEN han AND len(terms) >= 3 THEN CASE WHEN find_ AND open_ AND project THEN 'Find an open-source project that fetches ' || CASE WHEN details <> '' THEN details ELSE joined END || ' information' || {_TAIL} WHEN find_ THEN 'Find ' || joined ELSE joined END ELSE '' END AS kept FROM d),
l AS (SELECT *, han AND ({_LOST}) AS loses FROM k)
SELECT qid, {_ruled('kept', 2)} AS plain, {_ruled('searched', 1)} AS for_search, kept AS preserved, {_TOLD} = '' OR (han AND (({_STATES}) OR {D.any_of(f'lower({_TOLD})', R.EXPLAINS)} OR loses)) AS answers, loses FROM l""")
def rule_translations(spark, sf_dir):
    """Rule translations of questions in Chinese round latin names, and what the guards say of translations."""
    q, said = F.col("question"), in_turn(F.col("qid"), SAID)
    made = {"plain": R.rule_translate(q), "for_search": R.rule_translate(q, True), "preserved": R.preserving_query(q), "answers": R.looks_like_answer(q, said), "loses": R.loses_information(q, said)}
    return asked(spark, sf_dir).select("qid", *(v.alias(k) for k, v in made.items()))


_TURNS = "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN text || ' see https://Docs.Python.org:8080/3/?a=' || conv_id || '。 and (http://www.github.com/x/y).' ELSE 'https://a.b/c,https://a.b/c;' || text || ' HTTPS://user@WWW.Example.org' END AS text FROM conversations WHERE text IS NOT NULL"


@register("turn_urls", f"WITH turns AS ({_TURNS}) SELECT conv_id, turn, array_to_string({D.urls('text')}, ' ') AS urls, array_to_string({D.domains('text')}, ' ') AS domains FROM turns")
def turn_urls(spark, sf_dir):
    """Urls of turns, some of which are given urls in several spellings."""
    t, i = F.col("text"), F.col("turn") % 3
    more = F.concat(t, F.lit(" see https://Docs.Python.org:8080/3/?a="), F.col("conv_id").cast("string"), F.lit("。 and (http://www.github.com/x/y)."))
    odd = F.concat(F.lit("https://a.b/c,https://a.b/c;"), t, F.lit(" HTTPS://user@WWW.Example.org"))
    turns = table(spark, sf_dir, "conversations").where("text is not null").withColumn("text", F.when(i == 0, t).when(i == 1, more).otherwise(odd))
    return turns.select("conv_id", "turn", F.array_join(extract_urls(F.col("text")), " ").alias("urls"), F.array_join(direct_domains(F.col("text")), " ").alias("domains"))


@register("citation_check", r"""WITH a AS (SELECT conv_id, turn, text || ' [E' || (turn % 5) || '] [E2]' AS answer FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
c AS (SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(answer, '\[(E\d+)\]', 1))) AS cited FROM a)
SELECT conv_id, turn, array_to_string(cited, ' ') AS cited, array_to_string(list_sort(list_filter(cited, lambda x: x NOT IN ('E1', 'E2', 'E3'))), ' ') AS invalid, len(cited) > 0 AND len(list_filter(cited, lambda x: x NOT IN ('E1', 'E2', 'E3'))) = 0 AS ok FROM c""")
def citation_check(spark, sf_dir):
    """Citations that each answer is given; E1 to E3 exist."""
    a = table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null")
    answer = F.concat("text", F.lit(" [E"), (F.col("turn") % 5).cast("string"), F.lit("] [E2]"))
    c = citations(answer, F.array(F.lit("E1"), F.lit("E2"), F.lit("E3")), "E")
    return a.select("conv_id", "turn", c.alias("c")).select("conv_id", "turn", F.array_join("c.cited_ids", " ").alias("cited"), F.array_join("c.invalid_ids", " ").alias("invalid"), F.col("c.ok").alias("ok"))


@register("intent_labels", f"""{_Q}, k AS (SELECT qid, {D.first_kind(_LOW, C.RESOURCE_WORDS, 'general')} AS r, {D.first_kind(_LOW, C.ANSWER_WORDS, 'concept')} AS a FROM questions)
SELECT qid, {D.lookup('r', C.RESOURCE_LABELS, '通用资料')} AS resource_label, {D.lookup('a', C.ANSWER_LABELS, '概念解释')} AS answer_label FROM k""")
def intent_labels(spark, sf_dir):
    q = F.col("question")
    return asked(spark, sf_dir).select("qid", resource_label(C.detect_resource_intent(q)).alias("resource_label"), answer_label(C.detect_answer_intent(q)).alias("answer_label"))


@register("source_modes", """WITH m AS (SELECT item_id, lower(list_extract(['offline', 'KB', 'web', 'both', 'hybrid', 'nonsense', '', 'online'], CAST(item_id % 8 + 1 AS BIGINT))) AS mode, item_id % 3 = 0 AS enough FROM benchmark),
n AS (SELECT item_id, enough, CASE WHEN mode IN ('offline', 'kb') THEN 'local' WHEN mode IN ('web', 'online') THEN 'online' WHEN mode IN ('both', 'hybrid') THEN 'hybrid' ELSE 'auto' END AS mode FROM m)
SELECT item_id, mode, mode <> 'online' AS use_local, CASE mode WHEN 'local' THEN FALSE WHEN 'auto' THEN NOT enough ELSE TRUE END AS use_web FROM n""")
def source_modes(spark, sf_dir):
    words = F.array(*map(F.lit, ["offline", "KB", "web", "both", "hybrid", "nonsense", "", "online"]))
    mode = F.element_at(words, (F.col("item_id") % 8 + 1).cast("int"))
    flags = C.source_flags(mode, F.col("item_id") % 3 == 0)
    return table(spark, sf_dir, "benchmark").select("item_id", C.source_mode(mode).alias("mode"), flags["use_local"].alias("use_local"), flags["use_web"].alias("use_web"))


_OPTION = f"(?i)(?:^|\\n|{X.WS}|·){X.WS}*([A-H]){X.WS}*[.．、:：]{X.WS}*([^\\n;；]+)"


def _options(block: str) -> str:
    """Pairs (k, v) of a block, the last of each letter, in the order of first appearance."""
    text = f"{D.sub(D.answer_block('v'), X.WS + '*我的答案.*$')}"
    letters = f"list_transform(regexp_extract_all({block}, {D.q(_OPTION)}, 1), lambda k: upper(k))"
    values = f"list_transform(regexp_extract_all({block}, {D.q(_OPTION)}, 2), lambda v: {D.strip(text)})"
    pairs = f"list_filter(list_transform({letters}, lambda k, i: {{'k': k, 'v': list_extract({values}, i)}}), lambda p: p.v <> '')"
    return f"list_extract(list_transform([{pairs}], lambda l: list_transform(list_filter(l, lambda p, i: list_position(list_transform(l, lambda r: r.k), p.k) = i), lambda p: {{'k': p.k, 'v': list_extract(list_filter(l, lambda r: r.k = p.k), -1).v}})), 1)"


#: Quiz texts in turn: a choice, two questions with true or false, one that asks for the rest, one without an answer.
QUIZ = (
    "1. (单选题) {t}\nA. {t}\nB. other; extra\nA、 again 我的答案：B\n正确答案:A", "1. 单选题 {t}\nA. yes\nB: no\n2. 判断题 {t} true or not? 正确答案:对", "前言不计\n1、 x\n3. (多选题) 下列哪些不包括 {t} ?\nA. 劳动\nB．资料\nC、{t}\n正确答案：C：工具; 解析", "no answer here {t}")


def _quiz(spark, sf_dir):
    """(conv_id, turn, question, content): a quiz text made from each turn, and what is asked in its conversation."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    one = F.substring(X.one_spaced(F.regexp_replace("text", "[;；·:：.．、0-9]", " ")), 1, 80)
    content = F.replace(in_turn(F.col("conv_id") + F.col("turn"), QUIZ), F.lit("{t}"), one)
    first = Window.partitionBy("conv_id").orderBy("turn", "text")
    asks = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("三个要素有哪些 "), one)).otherwise(one)
    return c.select("conv_id", "turn", F.first(asks).over(first).alias("question"), content.alias("content"), F.row_number().over(first).alias("rank"))


_ONE = "substr(" + D.one_spaced("regexp_replace(text, '[;；·:：.．、0-9]', ' ', 'g')") + ", 1, 80)"
_QUIZ = f"""quiz AS (SELECT conv_id, turn, first_value(CASE WHEN conv_id % 2 = 0 THEN '三个要素有哪些 ' || {_ONE} ELSE {_ONE} END) OVER w AS question, replace({D.in_turn('(conv_id + turn)', QUIZ)}, '{{t}}', {_ONE}) AS content, row_number() OVER w AS rank FROM conversations WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
marked AS (SELECT *, regexp_replace({D.answer_block('content')}, {D.q('(' + chr(92) + 'n?' + X.WS + '*[0-9]+[.]' + X.WS + '*[(（]?(?:单选题|判断题|多选题)[)）]?)')}, chr(1) || '\\1', 'g') AS m FROM quiz),
blocks AS (SELECT conv_id, turn, question, rank, unnest(b) AS block, generate_subscripts(b, 1) - 1 AS n FROM (SELECT *, list_filter(list_transform(string_split(m, chr(1)), lambda x: {D.answer_block('x')}), lambda x: length(x) >= 20) AS b0, CASE WHEN len(b0) > 0 THEN b0 ELSE [{D.answer_block('content')}] END AS b FROM marked))"""


@register("quiz_blocks", f"WITH {_QUIZ} SELECT conv_id, turn, CAST(n AS INTEGER) AS n, block, array_to_string(list_transform({_options('block')}, lambda p: p.k || '=' || p.v), '|') AS options FROM blocks")
def quiz_blocks(spark, sf_dir):
    """Blocks and options of quiz texts."""
    b = _quiz(spark, sf_dir).select("conv_id", "turn", F.posexplode(question_blocks(F.col("content"))).alias("n", "block"))
    return b.withColumn("options", F.array_join(F.transform(F.map_entries(options(F.col("block"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|"))


_CORRECT = f"(?i)正确答案{X.WS}*[:：]{X.WS}*([A-H]|对|错|正确|错误){X.WS}*(?:[:：]{X.WS}*([^;；\\n]+))?"
_STEM_END = f"(?i)(?:\\n|{X.WS}|·){X.WS}*A{X.WS}*[.．、:：]|我的答案|正确答案"


@register("quiz_answers", f"""WITH {_QUIZ},
judged AS (SELECT *, len(list_intersect({_answer_terms('question')}, {_answer_terms('block')})) AS score FROM blocks WHERE contains(block, '正确答案')),
best AS (SELECT *, upper(regexp_extract(block, {D.q(_CORRECT)}, 1)) AS key, {D.answer_block(f"regexp_extract(block, {D.q(_CORRECT)}, 2)")} AS stated, {_options('block')} AS opts, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, rank, n) AS k FROM judged),
chosen AS (SELECT *, CASE WHEN stated <> '' THEN stated ELSE coalesce(list_extract(list_filter(opts, lambda p: p.k = key), 1).v, '') END AS said, list_slice(list_transform(list_filter(opts, lambda p: p.k <> key), lambda p: '- ' || p.v), 1, 6) AS others,
  substr({D.answer_block(D.sub(f"string_split(regexp_replace(block, {D.q(_STEM_END)}, chr(2)), chr(2))[1]", '^' + X.WS + '*[0-9]+[.]' + X.WS + '*'))}, 1, 260) AS stem FROM best WHERE k = 1 AND (score > 0 OR length({D.strip('question')}) <= 10) AND key <> '')
SELECT conv_id AS qid, '【直接答案】' || chr(10) || CASE WHEN key IN ('对', '错', '正确', '错误') THEN {D.q(CORRECT_IS)} || CASE WHEN key IN ('对', '正确') THEN '对' ELSE '错' END || '。' WHEN said <> '' THEN {D.q(CORRECT_KEY)} || key || '：' || said || '。' ELSE {D.q(CORRECT_KEY)} || key || '。' END
  || CASE WHEN regexp_matches(question, '三个|三.*要素|哪些|哪三') AND contains(block, '不包括') AND len(list_filter(opts, lambda p: p.k = key)) > 0 AND len(others) > 0 THEN chr(10) || chr(10) || {D.q(OTHERS_ARE)} || chr(10) || array_to_string(others, chr(10)) ELSE '' END || chr(10) || chr(10)
  || array_to_string(list_filter(['【依据】', CASE WHEN stem <> '' THEN '命中的题目：' || stem END, CASE WHEN len(opts) > 0 THEN '选项：' || array_to_string(list_transform(opts, lambda p: p.k || '. ' || p.v), '；') END, '来源：kb', '', '【说明】', {D.q(EXPLAINED)}], lambda x: x IS NOT NULL), chr(10)) AS answer,
  'kb' AS source_title, CAST(score AS INTEGER) AS score FROM chosen""")
def quiz_answers(spark, sf_dir):
    """Direct answers of the quiz texts of each conversation."""
    hits = _quiz(spark, sf_dir).select(F.col("conv_id").alias("qid"), "question", "rank", F.lit("kb").alias("title"), F.lit("").alias("url"), "content")
    return direct_answers(hits).drop("source_url")


@register("guarded_rewrites")
def guarded_rewrites(spark, sf_dir):
    """What the guards keep when the next turn stands for a model's rewrite."""
    c = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "text")).alias("said"))
    q, s = F.col("question"), F.col("said")
    j = asked(spark, sf_dir).withColumnRenamed("qid", "conv_id").join(c, "conv_id")
    return j.select("conv_id", guarded_query(q, s).alias("query"), guarded_english_query(q, s).alias("english_query"), guarded_translation(q, s).alias("translation"))


_SUGGESTED = "CASE intent " + " ".join(f"WHEN {D.q(k)} THEN {D.q(chr(10).join(v + COMMON))}" for k, v in SUGGESTIONS.items()) + f" ELSE {D.q(chr(10).join(COMMON))} END"


def search_plan_sql(rows: str) -> str:
    """(qid, searches, suggestions) of a table of questions."""
    return f"""WITH based AS ({_BASE_ROWS.replace('FROM questions', f'FROM {rows}')}), kinds AS (SELECT *, {D.first_kind(_LOW, C.RESOURCE_WORDS, 'general')} AS intent FROM based),
listed AS (SELECT qid, intent, {D.distinct(f"list_filter(list_transform({D.distinct(f'list_filter({_SUFFIXED}, lambda x: x IS NOT NULL)')}, lambda x: trim(x)), lambda x: x <> '')")} AS qs FROM kinds)
SELECT qid, '【实际搜索】' || CASE WHEN len(qs) > 0 THEN chr(10) || {D.numbered('qs')} ELSE '' END AS searches, {_SUGGESTED} AS suggestions FROM listed"""


@register("search_plan", f"{_Q} SELECT * FROM ({search_plan_sql('questions')})")
def search_plan(spark, sf_dir):
    """Queries and suggestions of each question as a report lists them."""
    q = F.col("question")
    intent = C.detect_resource_intent(q)
    return asked(spark, sf_dir).select("qid", search_list(R.resource_queries(q, intent)).alias("searches"), F.array_join(suggestions(intent), "\n").alias("suggestions"))
