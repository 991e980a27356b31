"""Text cleaning and extraction as column expressions.

Six cleaners differ on purpose: each belongs to one kind of input.  ``WS`` is the Unicode
white space that ``str.split`` knows, spelled so that both Java and RE2 read it.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_SPACES = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{_SPACES}]"
NOT_WS = f"[^{_SPACES}]"
HAN = r"[\x{4E00}-\x{9FFF}]"
SENTENCE_END = r"(?<=[。！？!?.])" + WS + "+"


@pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else html.unescape(t))


def unescape(text: Column) -> Column:
    """HTML entities resolved; only texts that may hold one travel to Python."""
    return F.coalesce(_unescape(F.when(text.rlike("&[#a-zA-Z]"), text)), text)


def let(body, *values: Column) -> Column:
    """body(*values) with each value computed once, however often the body or its lambdas use it."""
    bound = F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values)))
    return F.element_at(F.transform(F.array(bound), lambda b: body(*(b[f"v{i}"] for i in range(len(values))))), 1)


def sub(text: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(to))


def strip(text: Column) -> Column:
    return sub(text, f"^{WS}+|{WS}+$")


def one_spaced(text: Column) -> Column:
    """All white space runs become one space, none at the ends."""
    return strip(sub(text, f"{WS}+", " "))


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def cut(text: Column, n: int, mark: str) -> Column:
    """At most n characters; a cut text loses its trailing space and gets the mark."""
    return let(lambda t: F.when(F.length(t) > n, F.concat(sub(F.substring(t, 1, n), f"{WS}+$"), F.lit(mark))).otherwise(t), text)


def clean_kb(text: Column, entities: bool = True) -> Column:
    """Knowledge-base text: paragraph breaks stay, spaces inside lines collapse."""
    t = unescape(filled(text)) if entities else filled(text)
    t = F.translate(t, "\0", " ")
    t = sub(sub(t, r"[ \t\r\f\x0B]+", " "), r" *\n *", "\n")
    return strip(sub(t, r"\n{3,}", "\n\n"))


def clean_web(text: Column, max_len: int | None = None, entities: bool = True) -> Column:
    """Page text: spaces collapse, blank lines go."""
    t = unescape(filled(text)) if entities else filled(text)
    t = strip(sub(sub(t, r"[ \t\r\f\x0B]+", " "), rf"\n{WS}*\n+", "\n"))
    return cut(t, max_len, "…") if max_len else t


def clean_snippet(text: Column) -> Column:
    """Search snippets: one line, without the engine's 'Missing' and 'Show results with' notes."""
    t = one_spaced(filled(text))
    t = sub(t, rf"(?i)\bMissing:{WS}*.*?(?=(?:Show results with:|$))")
    return one_spaced(sub(t, rf"(?i)\bShow results with:{WS}*{NOT_WS}+"))


def clean_answer_block(text: Column) -> Column:
    t = sub(sub(filled(text), r"[\t\r\f\x0B]+", " "), rf"\n{WS}*\n+", "\n")
    return strip(sub(t, " {2,}", " "))


def clean_direct(text: Column, max_chars: int = 4000, entities: bool = True) -> Column:
    t = one_spaced(unescape(filled(text)) if entities else filled(text))
    return cut(t, max_chars, "...")


# Labels that models put before a query, tried in this order.
QUERY_LABELS = ("搜索词：", "搜索词:", "关键词：", "关键词:", "查询：", "查询:", "English search query:", "Search query:")


def clean_one_line(text: Column, max_len: int = 240) -> Column:
    t = strip(filled(text))
    for quote in ('"', "'", "`"):
        t = sub(t, f"^{quote}+|{quote}+$")
    for label in QUERY_LABELS:
        t = let(lambda x, label=label: F.when(F.startswith(x, F.lit(label)), strip(F.substr(x, F.lit(len(label) + 1)))).otherwise(x), t)
    t = sub(t, f"{WS}+", " ")
    return strip(F.substring(t, 1, max_len))


def clean_model_answer(text: Column) -> Column:
    """Model output without heading marks, bold marks and rules."""
    lines = F.split(strip(filled(text)), r"\r\n|[\n\r\x0B\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]", -1)
    lines = F.transform(lines, lambda x: F.replace(sub(sub(x, f"{WS}+$"), rf"^{WS}{{0,3}}#{{1,6}}{WS}*"), F.lit("**"), F.lit("")))
    kept = F.filter(lines, lambda x: ~x.rlike(rf"^{WS}*[-=_]{{3,}}{WS}*$"))
    return strip(sub(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def evidence_quote(text: Column, max_len: int = 520) -> Column:
    return cut(clean_snippet(text), max_len, "…")


def html_title(page: Column, entities: bool = True) -> Column:
    inner = sub(F.regexp_extract(filled(page), r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]+>", " ")
    return F.substring(clean_snippet(unescape(inner) if entities else inner), 1, 180)


# Where pages state their date.
_DATE_NAMES = "article:published_time|date|datePublished|dc.date|dc.date.issued|citation_publication_date|og:updated_time"
DATE_META = (
    rf"""(?is)<meta[^>]+(?:property|name)=["'](?:{_DATE_NAMES})["'][^>]+content=["']([^"']+)["']""",
    rf"""(?is)<meta[^>]+content=["']([^"']+)["'][^>]+(?:property|name)=["'](?:{_DATE_NAMES})["']""",
    rf"""(?is)"(?:datePublished|dateModified|uploadDate)"{WS}*:{WS}*"([^"']+)\"""",
)
DATE_TEXT = r"(20\d{2}|19\d{2})[-/年](0?[1-9]|1[0-2])(?:[-/月](0?[1-9]|[12]\d|3[01]))?"


def publication_date(page: Column, url: Column) -> Column:
    """The date that a page states, else one in its url or head as ``YYYY-MM[-DD]``, else ''."""
    page, url = filled(page), filled(url)
    stated = [F.when(page.rlike(p), F.substring(clean_snippet(F.regexp_extract(page, p, 1)), 1, 40)) for p in DATE_META]

    def seen(text: Column) -> Column:
        part = lambda i: F.regexp_extract(text, DATE_TEXT, i)
        day = F.when(part(3) != "", F.concat(F.lit("-"), F.lpad(part(3), 2, "0"))).otherwise("")
        return F.when(text.rlike(DATE_TEXT), F.concat(part(1), F.lit("-"), F.lpad(part(2), 2, "0"), day))

    return F.coalesce(*stated, seen(url), seen(F.substring(page, 1, 5000)), F.lit(""))


def content_hash(text: Column) -> Column:
    return F.sha2(filled(text), 256)


def pdf_page_number(text: Column) -> Column:
    return F.regexp_extract(text, r"^\[PDF 第 (\d+) 页\]", 1).try_cast("int")


def format_location(path: Column, start: Column, end: Column, page: Column) -> Column:
    paged = F.concat(path, F.lit("，PDF 第 "), page.cast("string"), F.lit(" 页"))
    single = F.concat(path, F.lit("，第 "), start.cast("string"), F.lit(" 段"))
    span = F.concat(path, F.lit("，第 "), start.cast("string"), F.lit("–"), end.cast("string"), F.lit(" 段"))
    has = lambda c: F.coalesce(c, F.lit(0)) != 0
    return F.when(has(page), paged).when(has(start) & has(end) & (start == end), single).when(has(start) & has(end), span).otherwise(path)


def contains_han(text: Column) -> Column:
    return filled(text).rlike(HAN)


def contains_any(text: Column, words) -> Column:
    """Any of the words as a substring."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty part."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")
