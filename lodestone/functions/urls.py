"""URLs: domains, extraction from text, text-fragment links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import SENTENCE_END, clean_web, filled, let, strip, sub

URL = r"(?i)https?://[^" + r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{3000}" + r"<>'\"`]+"
URL_TAIL = r"[.,;:!?，。；：！？）)\]}>'\"]+$"


def authority(url: Column) -> Column:
    """What stands between ``//`` and the path, with user and port, lower-cased."""
    return F.lower(F.coalesce(F.regexp_extract(filled(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def without_www(domain: Column) -> Column:
    return sub(domain, r"^www\.")


def extract_domain(url: Column) -> Column:
    return without_www(authority(url))


def normalize_domain(value: Column) -> Column:
    """A domain, or the domain of an http(s) url."""
    v = F.lower(strip(filled(value)))
    return without_www(F.when(v.rlike("^https?://"), authority(v)).otherwise(v))


def extract_urls(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(filled(text), F.lit(URL), F.lit(0)), lambda u: sub(strip(u), URL_TAIL))
    return F.array_distinct(F.filter(found, lambda u: u != ""))


def direct_domains(text: Column) -> Column:
    """Domains of the urls in a text."""
    return F.array_distinct(F.filter(F.transform(extract_urls(text), lambda u: normalize_domain(authority(u))), lambda d: d != ""))


def github_repo(url: Column) -> Column:
    """(owner, repo) of a repository url, else null."""
    parts = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda p: p != "")
    owner, repo = F.try_element_at(parts, F.lit(1)), sub(F.try_element_at(parts, F.lit(2)), r"\.git$")
    return F.when((extract_domain(url) == "github.com") & (repo != ""), F.struct(owner.alias("owner"), repo.alias("repo")))


def fragment_snippet(clean: Column) -> Column:
    """A short passage of a cleaned text that a browser can find: the first sentence of 24 to 120 characters, else the start."""

    def of(t: Column) -> Column:
        fits = F.filter(F.transform(F.split(t, SENTENCE_END), lambda p: clean_web(p, entities=False)), lambda p: F.length(p).between(24, 120))
        whole = lambda s: F.when(s.rlike("[A-Za-z]") & F.contains(s, F.lit(" ")), sub(s, " [^ ]*$")).otherwise(s)
        return F.coalesce(F.try_element_at(fits, F.lit(1)), let(whole, strip(F.substring(t, 1, 100))))

    return let(of, clean)


def percent_encode(text: Column) -> Column:
    """Every byte but letters, digits and ``_.-~``."""
    t = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def text_fragment_url(url: Column, quote: Column, entities: bool = True) -> Column:
    base = sub(filled(url), "(?s)#.*$")
    linked = lambda s: F.when(F.length(s) < 12, base).otherwise(F.concat(base, F.lit("#:~:text="), percent_encode(s)))
    of = lambda q: F.when(~filled(url).rlike("^https?://") | (F.length(q) < 12), filled(url)).otherwise(let(linked, fragment_snippet(q)))
    return let(of, clean_web(quote, entities=entities))


def normalize_api_base(base: str) -> str:
    """The chat endpoint of an OpenAI-compatible server."""
    base = (base or "").strip().rstrip("/")
    if not base:
        return ""
    if base.endswith("/chat/completions"):
        return base
    return base + ("/chat/completions" if base.endswith("/v1") else "/v1/chat/completions")


