import random
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from common import documents
from lodestone.llm import sharding, url_graph


def plain_permute(x, n, seed):
    a, b = sharding.domain(n)

    def hashed(*v):
        seed_ = 42
        for i in v:
            seed_ = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed_)
        return seed_ - 2**64 if seed_ >= 2**63 else seed_

    def once(x):
        left, right = divmod(x, b)
        for i in range(sharding.ROUNDS):
            if i % 2 == 0:
                left = (left + hashed(seed, i, right) % a) % a
            else:
                right = (right + hashed(seed, i, left) % b) % b
        return left * b + right

    x = once(x)
    while x >= n:
        x = once(x)
    return x


def test_permutation(spark):
    for n in (1, 2, 3, 5, 11, 257, 1000):
        got = [r[0] for r in spark.range(n).orderBy("id").select(sharding.permute(F.col("id"), n, 7)).collect()]
        assert got == [plain_permute(x, n, 7) for x in range(n)]
        assert sorted(got) == list(range(n))


def test_shards(spark):
    texts = ["same"] * 40 + [f"text {i} é" for i in range(60)] + [None, ""]
    ids = [*range(100), None, 50]
    docs = documents(spark, texts, ids).withColumn("row_number", F.lit("x")).withColumn("_part", F.lit(1))
    rows = sharding.shard_rows(docs).collect()
    assert len(rows) == 102
    for s in range(24):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (4, 5)
    assert sorted(r.row_number for r in rows) == list(range(102))
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    again = sharding.shard_rows(docs.orderBy(F.rand(3)).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert sharding.shard_rows(documents(spark, [])).count() == 0


def test_write_shards(spark, tmp_path):
    out = sharding.write_shards(documents(spark, ["a", "b", "c"]), f"{tmp_path}/s", 2)
    assert sorted(r.text for r in out.collect()) == ["a", "b", "c"]


def test_write_shards_keeps_every_row(spark, tmp_path):
    texts, ids = ["a", "b", "b", "c", "d", None], [None, 1, 1, 1, None, 2]
    out = sharding.write_shards(documents(spark, texts, ids), f"{tmp_path}/s", 2).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in out))) == sorted(map(str, zip(ids, texts)))
    assert sorted((r.shard, r.slot) for r in out) == [(s, i) for s in range(2) for i in range(3)]


def page(i, url, links=()):
    return (i, url, "<p>x</p>" + "".join(f'<li><a class=x href="{x}">y</a></li>' for x in links) if links is not None else None)


def brute_spread(edges, seeds, damping):
    hosts = sorted({*seeds, *(x for e in edges for x in e[:2])})
    at = {h: i for i, h in enumerate(hosts)}
    m, s = np.zeros((len(hosts), len(hosts))), np.zeros(len(hosts))
    out = {}
    for a, b, w in edges:
        out[a] = out.get(a, 0) + w
    for a, b, w in edges:
        m[at[b], at[a]] += w / out[a]
    for h, w in seeds.items():
        s[at[h]] = w
    return dict(zip(hosts, np.linalg.solve(np.eye(len(hosts)) - damping * m, (1 - damping) * s)))


def test_rules_and_parts(spark):
    cases = [
        ("http://a.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
        ("https://badexample.org/en/17", "badexample.org", "/en/17", "org/", "allow"),
        ("x://site.com/de/#a", "site.com", "/de/", "com/de/", "block"),
        ("x://site.com/fr/a://b", "site.com", "/fr/a://b", "com/fr/", "allow"),
        ("x://é.org?q", "é.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("://", "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], None) for i, c in enumerate(cases)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_graph.judge_pages(df).collect()}
    for i, c in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule) == c[1:4], c
        assert c[3] is None or got[i].verdict == c[4]
    empty = url_graph.judge_pages(df.limit(0))
    assert empty.count() == 0


def test_spread_equals_linear_algebra(spark):
    rng = random.Random(4)
    names = [f"h{i}.net" for i in range(12)] + ["good.org", "bad.com"]
    pages = [page(0, "http://good.org/a", ["http://h0.net/x", "//H1.net", "/rel"]), page(1, "http://bad.com/de/1", [])]
    for i in range(2, 60):
        pages.append(page(i, f"http://{rng.choice(names)}/p{i}", [f"http://{rng.choice(names)}/q" for _ in range(rng.randrange(4))] if i % 9 else None))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    edges = [tuple(r) for r in url_graph.host_edges(df).collect()]
    rows = {r.host: r for r in url_graph.judge_pages(df, tolerance=1e-10, rounds=200).collect()}
    n_bad = sum("//bad.com/" in p[1] for p in pages)
    n_good = sum("//good.org/" in p[1] for p in pages)
    trust = brute_spread(edges, {"good.org": n_good / n_good}, 0.85)
    distrust = brute_spread([(b, a, w) for a, b, w in edges], {"bad.com": 1 / n_bad}, 0.85)
    for h, r in rows.items():
        assert abs(r.trust - trust.get(h, 0)) < 1e-6 and abs(r.distrust - distrust.get(h, 0)) < 1e-6
        if not r.rule:
            assert r.verdict == ("block" if r.distrust > r.trust else "allow")
