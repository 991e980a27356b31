"""Search and page sources behind small interfaces, with deterministic table-backed ones.

Adapters run on the driver or inside ``mapInPandas``; the engine itself only sees DataFrames.
"""

from __future__ import annotations

import html
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import clean_snippet, filled, html_title, publication_date
from lodestone.functions.urls import extract_urls, github_repo
from lodestone.sources.html import described, raw_blocks_column, readable_text_column

ARCHIVES = (".zip", ".tar", ".gz", ".7z", ".rar", ".exe", ".dmg", ".whl")
READABLE_TYPES = ("text/", "html", "xml", "json")


class SearchBackend(Protocol):
    def search(self, query: str, limit: int, category: str) -> list[dict]: ...


@dataclass
class Cache:
    """Answers by key for a while; the oldest go when it is full."""

    ttl: float = 600.0
    size: int = 10_000
    clock: Callable[[], float] = time.monotonic
    held: dict = field(default_factory=dict)

    def get(self, key):
        at, value = self.held.get(key, (None, None))
        if at is None or self.clock() - at > self.ttl:
            self.held.pop(key, None)
            return None
        return value

    def put(self, key, value) -> None:
        self.held.pop(key, None)
        self.held[key] = (self.clock(), value)
        while len(self.held) > self.size:
            del self.held[next(iter(self.held))]


@dataclass
class CachedSearch:
    """A backend with a cache and quiet errors."""

    backend: SearchBackend
    cache: Cache = field(default_factory=Cache)
    language: str = "zh"

    def search(self, query: str, limit: int, category: str = "general") -> list[dict]:
        key = (query, self.language, limit, category)
        found = self.cache.get(key)
        if found is None:
            try:
                found = self.backend.search(query, limit, category)[:limit]
            except Exception:  # noqa: BLE001  a search engine that is down gives no hits
                return []
            self.cache.put(key, found)
        return found


@dataclass
class TableSearch:
    """Hits that are known beforehand, by query."""

    hits: dict[str, list[dict]]

    def search(self, query: str, limit: int, category: str = "general") -> list[dict]:
        return self.hits.get(query, [])[:limit]


@dataclass
class DirectSource:
    """An adapter for urls in a question: which it takes, and what it makes of them."""

    name: str
    matches: Callable[[str], bool]
    fetch: Callable[[str], list[dict]]


def resolve_direct(urls: Iterable[str], sources: list[DirectSource]) -> list[dict]:
    """Each url goes to the first source that takes it; an error gives a row that says so; the first row of a url stays."""
    rows, seen = [], set()
    waiting = list(dict.fromkeys(urls))
    for source in sources:
        mine, waiting = [u for u in waiting if source.matches(u)], [u for u in waiting if not source.matches(u)]
        for url in mine:
            try:
                found = source.fetch(url)
            except Exception as e:  # noqa: BLE001
                found = [{"title": f"{source.name}: {url}", "url": url, "content": str(e)[:160], "_direct_source": source.name}]
            for row in found:
                if row.get("url") and row["url"] not in seen:
                    seen.add(row["url"])
                    rows.append(row | {"_matched_query": url})
    return rows


def one_line(text: str, most: int) -> str:
    text = " ".join(html.unescape(text or "").split())
    return text if len(text) <= most else text[:most].rstrip() + "..."


def page_hit(url: str, body: str, is_html: bool = True) -> dict:
    """A hit from a page that was asked for by its url."""
    title, about, text = described(body) if is_html else (url, "", body)
    content = "\n".join(filter(None, (one_line(about, 800), one_line(text, 4000))))
    return {"title": one_line(title, 220) or url, "url": url, "content": content or "已成功访问该 URL，但未能提取到足够正文。", "_direct_source": "generic_url"}


def github_hit(owner: str, repo: str, data: dict | None, readme: str = "") -> dict:
    """A hit from a repository's API answer; None stands for not found."""
    url = f"https://github.com/{owner}/{repo}"
    if data is None:
        return {"title": f"GitHub 仓库不存在或不可访问：{owner}/{repo}", "url": url, "content": "GitHub API 返回 404。可能原因：仓库不存在、私有仓库、拼写错误，或当前 token 没有访问权限。", "_direct_source": "github_api"}
    name, licence = data.get("full_name") or f"{owner}/{repo}", data.get("license") or {}
    facts = {
        "仓库": name, "简介": data.get("description") or "", "语言": data.get("language") or "未知", "Stars": data.get("stargazers_count", 0), "Forks": data.get("forks_count", 0),
        "License": licence.get("spdx_id") or licence.get("name") or "未知", "Topics": ", ".join(data.get("topics") or []), "创建时间": data.get("created_at") or "", "最近推送": data.get("pushed_at") or "",
    }
    content = "\n".join([*(f"{k}：{v}" for k, v in facts.items()), "README 摘录：", one_line(readme, 3000)])
    return {"title": f"{name} - GitHub repository", "url": data.get("html_url") or url, "content": one_line(content, 5000), "_direct_source": "github_api"}


def direct_requests(questions: DataFrame) -> DataFrame:
    """(qid, position, url, source, owner, repo): the urls of each question and which adapter takes them."""
    urls = questions.select("qid", F.posexplode(extract_urls(F.col("question"))).alias("position", "url"))
    repo = github_repo(F.col("url"))
    return urls.select("qid", "position", "url", F.when(repo.isNotNull(), "github").otherwise("page").alias("source"), repo["owner"].alias("owner"), repo["repo"].alias("repo"))


def fetch_refusal(url: Column, content_type: Column | None = None) -> Column:
    """Why a page is not fetched, or null."""
    low = F.lower(F.trim(filled(url)))
    out = F.when(~low.rlike("^https?://"), "not http").when(low.rlike("(" + "|".join(a.replace(".", r"\.") for a in ARCHIVES) + ")$"), "archive")
    if content_type is None:
        return out
    kind = F.lower(filled(content_type))
    readable = F.lit(False)
    for t in READABLE_TYPES:
        readable = readable | F.contains(kind, F.lit(t))
    return out.when((kind != "") & ~readable, "content type")


def fetched_pages(pages: DataFrame, most: int = 6000) -> DataFrame:
    """(page_id, url, ok, error, title, published_at, text, raw_blocks) from (page_id, url, html)."""

    read = pages.withColumn("_text", readable_text_column(F.col("html"))).withColumn("raw_blocks", raw_blocks_column(F.col("html")))
    text = F.substring(clean_snippet(F.col("_text")), 1, most)
    rows = read.select("page_id", "url", html_title(F.col("html")).alias("title"), publication_date(F.col("html"), F.col("url")).alias("published_at"), text.alias("text"), "raw_blocks", fetch_refusal(F.col("url")).alias("refusal"))
    error = F.coalesce("refusal", F.when(F.length("text") < 80, F.lit("too short")))
    return rows.withColumn("error", error).withColumn("ok", F.col("error").isNull()).drop("refusal")


def merge_hits(hits: DataFrame) -> DataFrame:
    """One row a url and question: direct hits first, then by query and position; hits without a url go.

    hits: qid, is_direct, query_index, position, url and more.
    """
    first = Window.partitionBy("qid", F.trim("url")).orderBy(F.desc("is_direct"), "query_index", "position")
    order = Window.partitionBy("qid").orderBy(F.desc("is_direct"), "query_index", "position", "url")
    kept = hits.where(F.trim(filled(F.col("url"))) != "").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return kept.withColumn("pos", F.row_number().over(order))


def search_queries(questions: DataFrame, extra: Column | None = None) -> DataFrame:
    """(qid, query_index, query): search query, question and extra queries, distinct, in order."""
    t = lambda c: F.trim(filled(c))
    every = F.array(t(F.col("search_query")), t(F.col("question")))
    every = F.concat(every, F.transform(extra, t)) if extra is not None else every
    return questions.select("qid", F.posexplode(F.array_distinct(F.filter(every, lambda q: q != ""))).alias("query_index", "query"))


