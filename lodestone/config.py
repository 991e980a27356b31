"""Engine settings: an immutable value passed to plans, never a global that workers cannot see."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    chunk_size: int = 1000
    chunk_overlap: int = 160
    max_text_chars: int = 1_200_000
    kb_limit: int = 8
    kb_min_score: float = 1.0
    kb_enough_results: int = 4
    kb_enough_score: float = 8.0
    kb_queries: int = 4
    min_relevance: int = 1
    default_site_weight: int = 1
    fast_per_query: int = 6
    precise_per_query: int = 10
    fast_results: int = 6
    precise_results: int = 10
    fast_fetch: int = 3
    precise_fetch: int = 5
    fast_tokens: int = 256
    precise_tokens: int = 512
    fast_templates: int = 3
    precise_templates: int = 5
    page_text_chars: int = 6000
    evidence_max_total: int = 8
    evidence_per_source: int = 2
    search_mode: str = "auto"
    answer_style: str = "plain"
    strict_decode: bool = False
    sync_interval_seconds: float = 5.0
    cache_ttl_seconds: float = 600.0

    def depth(self, depth: str) -> dict:
        """The bundle of limits of a search depth: ``precise``, or else fast."""
        kind = "precise" if depth == "precise" else "fast"
        named = {"per_query": "per_query", "final_results": "results", "final_tokens": "tokens", "fetch_top_n": "fetch", "query_template_limit": "templates"}
        return {"depth": kind, "use_rewrite": kind == "precise"} | {k: getattr(self, f"{kind}_{v}") for k, v in named.items()}

    @classmethod
    def load(cls, text: str = "", env: dict[str, str] | None = None) -> EngineConfig:
        """From ``KEY=VALUE`` lines; the environment wins over the lines, the lines over defaults."""
        found = parse_cfg(text) | {k: v for k, v in (os.environ if env is None else env).items()}
        made = cls()
        for f in fields(cls):
            value = found.get(f.name.upper())
            if value is not None:
                made = replace(made, **{f.name: _typed(value, getattr(made, f.name))})
        return made


def parse_cfg(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        key, equals, value = line.strip().partition("=")
        if equals and key.strip() and not key.startswith("#"):
            out[key.strip()] = value.strip().strip("\"'")
    return out


def parse_bool(value: str | None, default: bool = False) -> bool:
    return default if value is None or not value.strip() else value.strip().lower() in {"1", "true", "yes", "on", "y"}


def _typed(value: str, like):
    if isinstance(like, bool):
        return parse_bool(value, like)
    return type(like)(value)
