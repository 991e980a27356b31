"""Expressions against plain readings of their rules, with the Chinese texts that the driver's tables lack."""

import hashlib
import html
import re
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from lodestone.config import EngineConfig, parse_bool, parse_cfg
from lodestone.functions import classify as C
from lodestone.functions import rewrite as R
from lodestone.functions import score as S
from lodestone.functions import text as X
from lodestone.functions import tokens as N
from lodestone.functions import urls as U


def values(spark, texts, make, *more):
    rows = [(i, t, *m) for i, (t, *m) in enumerate(zip(texts, *more))]
    names = "i int, t string" + "".join(f", x{j} string" for j in range(len(more)))
    return [r[0] for r in spark.createDataFrame(rows, names).orderBy("i").select(make(*(F.col(c) for c in ["t", *(f"x{j}" for j in range(len(more)))]))).collect()]


TEXTS = [None, "", "  a b \t\n\n\n\n c &amp; d &lt;e&gt; \x00 f ", "中文　文本\n \n第二段。 第三！", "x&copy y && z &#65; &notit;", "a\r\nb\fc\x0bd", "Missing: foo bar Show results with: baz qux", "trailing 　"]


def test_cleaners(spark):
    def kb(t):
        t = re.sub(r"[ \t\r\f\v]+", " ", html.unescape(t or "").replace("\0", " "))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", t)).strip()

    def web(t):
        return re.sub(r"\n\s*\n+", "\n", re.sub(r"[ \t\r\f\v]+", " ", html.unescape(t or ""))).strip()

    assert values(spark, TEXTS, X.clean_kb) == [kb(t) for t in TEXTS]
    assert values(spark, TEXTS, X.clean_web) == [web(t) for t in TEXTS]
    assert values(spark, TEXTS, lambda t: X.clean_web(t, 5)) == [w if len(w := web(t)) <= 5 else w[:5].rstrip() + "…" for t in TEXTS]
    assert values(spark, TEXTS, X.clean_direct) == [" ".join(html.unescape(t or "").split()) for t in TEXTS]
    assert values(spark, TEXTS[6:7], X.clean_snippet) == ["qux"]
    assert values(spark, ["# T\n**b** x\n---\n\n\n\ny", None], X.clean_model_answer) == ["T\nb x\n\ny", ""]
    assert values(spark, ['"搜索词： Search query: a\nb"', "`x`", None], X.clean_one_line) == ["a b", "x", ""]
    assert values(spark, TEXTS, X.content_hash) == [hashlib.sha256((t or "").encode()).hexdigest() for t in TEXTS]


def test_locations_titles_dates(spark):
    pages = ["<title>A &amp; <b>B</b></title>", '<meta name="date" content="2024-05-06T1">', "text 2023年7月9日", "2021/12", None, '{"datePublished" : "2020-01-02"}']
    assert values(spark, pages[:1], X.html_title) == ["A & B"]
    assert values(spark, pages, lambda p: X.publication_date(p, F.lit("http://x/"))) == ["", "2024-05-06T1", "2023-07-09", "2021-01", "", "2020-01-02"]
    assert values(spark, ["[PDF 第 12 页]\nx", "x", None], X.pdf_page_number) == [12, None, None]
    df = spark.createDataFrame([("p", 1, 1, None), ("p", 1, 3, None), ("p", None, None, None), ("p", 1, 2, 7)], "p string, a int, b int, n int")
    assert [r[0] for r in df.select(X.format_location(*(F.col(c) for c in "pabn"))).collect()] == ["p，第 1 段", "p，第 1–3 段", "p", "p，PDF 第 7 页"]


def plain_kb_terms(t):
    t = (t or "").lower()
    out = [x for x in (m.strip(".-:/#") for m in re.findall(r"[a-z0-9_][a-z0-9_\-.:/#]{1,}", t)) if len(x) >= 2]
    for run in re.findall("[一-鿿]+", t):
        for n in (1, 2, 3) if len(run) > 1 else (1,):
            out += [run[i : i + n] for i in range(len(run) - n + 1)]
    return list(dict.fromkeys(out))


MIXED = ["劳动过程 the Labor-process, v2.0 of C# http://a.b/c 是", "的", "ChatGPT 服务降级风险等级 chatgpt 用量", None, "开源项目 GitHub repo?", "Qwen3.5 3.14 a1"]


def test_tokenizers(spark):
    assert values(spark, MIXED, N.kb_terms) == [plain_kb_terms(t) for t in MIXED]
    got = values(spark, MIXED, N.relevance_tokens)
    assert got[0] == ["the", "labor-process", "v2.0", "of", "c#", "http", "a.b/c", "劳动过程", "劳动", "动过", "过程", "劳动过", "动过程"]
    assert got[1] == [] and got[3] == [] and got[4] == ["github", "repo", "开源项目", "开源", "源项", "项目", "开源项", "源项目"]
    assert values(spark, MIXED[2:3], N.query_tokens) == [["ChatGPT", "服务降级风险等级", "用量", "degradation", "degraded", "服务降级", "risk", "risk level", "风险等级", "usage", "quota", "limit"]]
    assert values(spark, ["的", "劳动过程x", None], lambda t: F.array_sort(N.answer_terms(t))) == [[], sorted(["劳动", "劳动过程", "动过", "过程"]), []]
    assert values(spark, ["python3 error on cuda at x1"], N.core_terms) == [["python3", "error", "cuda", "x1", "on", "at"]]
    assert values(spark, ["用 GitHub 查 Foo-kit, (Foo-kit) 和 Codex."], N.ascii_entities) == [["Foo-kit", "Codex"]]
    df = spark.createDataFrame([([" A", "a", "b ", "", "B", "c"],)], "t array<string>")
    assert df.select(N.unique_keep_order(F.col("t"))).first()[0] == ["A", "b", "c"]


def test_urls(spark):
    urls = ["https://www.A.com:80/x", "http://u@b.org?q", "ftp", None, "https://GitHub.com/o/r.git/x"]
    assert values(spark, urls, U.extract_domain) == ["a.com:80", "u@b.org", "", "", "github.com"]
    assert values(spark, ["see https://a.com/x. and (http://B.org/y) https://a.com/x。", None], U.extract_urls) == [["https://a.com/x", "http://B.org/y"], []]
    assert values(spark, urls, lambda u: F.to_json(U.github_repo(u)))[-1] == '{"owner":"o","repo":"r"}'
    text = "第一句足够长，用来做片段定位，一共要超过二十四个字才行。 Second ~ part * + here."
    got = values(spark, [text], lambda t: U.text_fragment_url(F.lit("https://a.com/p#old"), t))[0]
    assert got == "https://a.com/p#:~:text=" + quote("第一句足够长，用来做片段定位，一共要超过二十四个字才行。", safe="")
    assert U.normalize_api_base("http://h/v1") == "http://h/v1/chat/completions" and U.normalize_api_base("") == ""


def test_classifiers(spark):
    qs = ["CUDA 报错怎么修复", "推荐几篇论文", "GitHub 开源项目", "A vs B 区别", "你好", "最新 license", None]
    assert values(spark, qs, C.detect_resource_intent) == ["troubleshooting", "paper", "project", "general", "general", "general", "general"]
    assert values(spark, qs, C.detect_answer_intent) == ["troubleshooting", "recommendation", "concept", "comparison", "concept", "concept", "concept"]
    assert values(spark, qs, C.detect_task_type) == ["answer", "resource", "answer", "answer", "answer", "answer", "answer"]
    assert values(spark, qs, C.is_short_ambiguous) == [False, True, False, False, True, False, False]
    assert values(spark, qs, C.is_timely)[5] is True
    domains = ["x.gov", "arxiv.org", "www.github.com", "x.github.com", "docs.python.org", "python.org", "de.wikipedia.org", "zhihu.com", "a.edu.cn", ""]
    assert values(spark, domains, C.source_type) == ["official", "paper", "repo", "general", "doc", "official", "community", "community", "general", "general"]
    assert values(spark, ["kb", "WEB", "all", "x", None], C.source_mode) == ["local", "online", "hybrid", "auto", "auto"]
    flags = values(spark, ["kb", "web", "auto"], lambda m: F.to_json(C.source_flags(m, F.lit(True))))
    assert flags == ['{"use_local":true,"use_direct":false,"use_web":false}', '{"use_local":false,"use_direct":true,"use_web":true}', '{"use_local":true,"use_direct":false,"use_web":false}']
    assert values(spark, ["什么是 RAG", "abc", "abcd efg"], C.is_bad_query, ["RAG 定义", "xyz", "efg"]) == [False, True, False]


def test_rewrites(spark):
    assert values(spark, ["帮我找论文 transformer 资料", "find articles about rag", "论文"], R.resource_query) == ["transformer", "rag", "论文"]
    assert values(spark, ["marx labor process tool", "x"], R.expand_kb_query) == ["马克思 劳动过程 劳动 工具", None]
    asked = ["Foo-kit 是一个什么样的工具", "vLLM 怎么安装", "找一个开源项目，获取 ChatGPT 服务降级风险等级和 Codex 用量，最新一次提交在三周之前", "plain english", "深度研究"]
    assert values(spark, asked, R.rule_translate) == [
        "what kind of tool is Foo-kit", "how to install and set up vLLM",
        "Find an open-source project that fetches ChatGPT service degradation risk level, Codex usage information, with its latest commit three weeks ago", "", ""]
    assert values(spark, asked[:2], lambda t: R.rule_translate(t, True)) == ["Foo-kit tool", "vLLM install setup"]
    said = ["Foo-kit is a tool", "How to install vLLM?", "GitHub project", "x", "deep research"]
    assert values(spark, asked, R.looks_like_answer, said) == [True, False, True, False, False]
    queries = values(spark, ["pytorch 报错"], lambda q: R.resource_queries(q, F.lit("troubleshooting")))[0]
    assert queries == ["pytorch 报错", "pytorch 报错 error fix", "pytorch 报错 报错"]
    templates = values(spark, ["pytorch version support"], lambda q: R.query_templates(q, q, F.lit("concept"), F.lit("general"), 5))[0]
    assert templates == ["pytorch version support", "pytorch version support official documentation", "pytorch version support docs", "pytorch version support release notes changelog", "pytorch version support compatibility support unsupported"]


def test_chunk_score(spark):
    def plain(terms, phrase, title, path, text, blob):
        phrase, score, matched = phrase.strip().lower(), 0.0, 0
        if len(phrase) >= 3:
            score += 9.0 * (phrase in text) + 8.0 * (phrase in title or phrase in path)
        for t in terms:
            n = text.count(t)
            hit = 5 * (t in title) + 3 * (t in path) + 2 * (t in blob) + (min(6, 1 + n) if n else 0)
            matched += bool(hit)
            score += hit * (1 + min(len(t), 12) / 18)
        return round(score + matched / len(terms) * 8, 3)

    cases = [(["aa", "劳动", "xyz"], "劳动 aa", "aaa t", "p/aa", "aaaa 劳动过程 劳动", "aa 劳动"), (["q"], "zz", "t", "p", "text", "blob"), (["anan", "b"], "anan", "t", "anan", "ananan b banan", "x")]
    df = spark.createDataFrame(cases, "a array<string>, b string, c string, d string, e string, f string")
    got = [r[0] for r in df.select(S.chunk_score(*(F.col(c) for c in "abcdef"))).collect()]
    assert got == [plain(*c) for c in cases]
    from lodestone.operators.search import Scorer

    for c, want in zip(cases, got):
        assert abs(Scorer([(1, c[1].lower(), c[0])]).score(*c[2:6])[0] - want) < 1e-9


def test_evidence_totals(spark):
    """Totals that a report printed for a technical question: authority 2, relevance 5, depth 3, freshness 3, independence 5."""
    words = ["pytorch", "cuda", "install", "linux", "docker"]
    for hits, total, label in ((2, 28, "中"), (3, 29, "强"), (1, 27, "中")):
        df = spark.createDataFrame([(" ".join(words), "general", 25, " ".join(words[:hits]), "x", "", "")], "q string, k string, r int, t string, c string, u string, p string")
        m = df.select(S.evidence_metrics(F.col("q"), F.col("k"), F.col("r"), F.col("t"), F.col("c"), F.lit(None).cast("array<string>"), F.col("u"), F.col("p"), F.lit(1)).alias("m")).first().m
        assert (m.total, m.label) == (total, label)


def test_config():
    assert parse_cfg("A=1\n# B=2\nC = 'x'\n") == {"A": "1", "C": "x"}
    assert EngineConfig.load("CHUNK_SIZE=500\nKB_LIMIT=3", {"KB_LIMIT": "4"}).kb_limit == 4
    assert EngineConfig().depth("precise")["final_results"] == 10 and EngineConfig().depth("x")["fetch_top_n"] == 3
    assert parse_bool("on") and not parse_bool("0") and parse_bool(None, True)


@pytest.mark.parametrize("name", ["paper", "project"])
def test_intent_bonus(spark, name):
    df = spark.createDataFrame([("arXiv paper", "https://github.com/a/b.pdf")], "t string, u string")
    got = df.select(S.intent_bonus(F.lit(name), F.col("t"), F.col("u"), F.lit(""), F.lit("repo"))).first()[0]
    assert got == {"paper": 30 + 20, "project": 10 + 90}[name]
