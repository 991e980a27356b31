"""URL filter by rules and by trust that spreads over the host link graph.

Rules decide the pages they fit.  For the rest, trust flows from hosts with allowed pages
along links (personalised PageRank), and distrust flows from hosts with blocked pages
against the links (who links to a bad host becomes suspect).  A host is blocked when its
distrust exceeds its trust.  Links are counted per page and summed per pair of hosts before
anything is joined, so a page-rich host is a row of the graph like any other.  Everything
runs as built-in SQL functions.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule
and is judged like a host without evidence (allowed); null html has no links; rows that
repeat are judged alike; no pages give no rows; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.kit import Scratch

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (verdict, rule), or null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links): pages of src that link to dst, another host."""
    linked = pages.select(host_of(F.col("url")).alias("src"), F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), lower_ascii)).alias("to"))
    pairs = linked.where("src <> '' and size(to) > 0").select("src", F.explode("to").alias("dst")).where("src <> dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("links"))


def spread(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float, tolerance: float, rounds: int) -> DataFrame:
    """(host, score): seeds' weights plus what flows over (src, dst, share), damped, in so many rounds.

    What is still missing then is at most damping ** rounds of the total weight.  Ends before
    where a round changes no more than ``tolerance`` of it (0: nothing at all).
    """
    score = scratch.table(seeds.select("host", (F.col("weight") * (1 - damping)).alias("score")), "score")
    base, total = score, score.agg(F.sum("score")).first()[0] or 0.0
    for _ in range(rounds):
        flow = score.withColumnRenamed("host", "src").join(edges, "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share") * damping).alias("score"))
        nxt = scratch.table(base.union(flow).groupBy("host").agg(F.sum("score").alias("score")), "score")
        change = nxt.alias("n").join(score.alias("o"), "host", "left").agg(F.sum(F.abs(F.col("n.score") - F.coalesce("o.score", F.lit(0.0))))).first()[0] or 0.0
        score = nxt
        if change <= tolerance * total:
            break
    return score


def judge_pages(pages: DataFrame, rules=RULES, damping: float = 0.85, threshold: float = 1.0, tolerance: float = 0.0, rounds: int = 60) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page.

    threshold: a host is blocked when distrust > threshold * trust.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = named.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
    edges = scratch.table(host_edges(pages), "edges")
    share = lambda v: F.count_if(F.col("found.verdict") == v) / F.count("*")
    hosts = scratch.table(ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")), "hosts")
    out = edges.join(edges.groupBy("src").agg(F.sum("links").alias("all")), "src").select("src", "dst", (F.col("links") / F.col("all")).alias("share"))
    back = edges.join(edges.groupBy("dst").agg(F.sum("links").alias("all")), "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("links") / F.col("all")).alias("share"))
    trust = spread(scratch.table(out, "out"), hosts.where("good > 0").select("host", F.col("good").alias("weight")), scratch, damping, tolerance, rounds)
    distrust = spread(scratch.table(back, "back"), hosts.where("bad > 0").select("host", F.col("bad").alias("weight")), scratch, damping, tolerance, rounds)
    scored = hosts.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left").fillna(0.0)
    judged = ruled.join(scored, "host", "left")
    of_host = F.when(F.coalesce("distrust", F.lit(0.0)) > threshold * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), of_host).alias("verdict"),
        F.round(F.coalesce("trust", F.lit(0.0)), 9).alias("trust"), F.round(F.coalesce("distrust", F.lit(0.0)), 9).alias("distrust"),
    )
