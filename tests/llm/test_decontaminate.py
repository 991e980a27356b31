import random

import numpy as np
from pyspark.sql import functions as F

from common import documents, prose
from lodestone.llm import decontaminate as dc


def brute_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(50):
        a = [rng.randrange(5) for _ in range(rng.randrange(20))]
        b = [rng.randrange(5) for _ in range(rng.randrange(20))]
        used = dc.common_subsequence(np.array(a, int), np.array(b, int))
        assert used.sum() == brute_lcs(a, b)


def corpus():
    rng = random.Random(2)
    items = [prose(rng.randrange(15, 60), 500 + i, 900) for i in range(25)]
    texts = [prose(rng.randrange(5, 400), i, 3000) for i in range(150)]
    leaks = set()
    for d in range(0, 60, 3):
        i = rng.randrange(25)
        leak = list(items[i])
        if d % 2:  # paraphrased: some words changed, one dropped, some added
            for p in range(2, len(leak), 6):
                leak[p] = f"other{p}"
            del leak[4]
            leak[9:9] = ["added", "words"]
        at = rng.randrange(len(texts[d]) + 1)
        texts[d][at:at] = leak
        leaks.add((d, i))
    return [" ".join(x) for x in texts], [" ".join(x) + "." for x in items], leaks


def test_matches_equal_brute_force(spark):
    texts, items, leaks = corpus()
    bench = spark.createDataFrame([*enumerate(items), (99, None), (98, ""), (None, "x y z")], "item_id long, text string").withColumn("lang", F.lit("x"))
    rows = dc.matches(documents(spark, texts), bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    brute = set()
    for d, t in enumerate(texts):
        w = t.split()
        for i, x in enumerate(items):
            b = x.rstrip(".").split()
            width = 16 * (-(-len(b) // 16) + 1)
            if any(brute_lcs(b, w[s : s + width]) >= 0.6 * len(b) for s in range(0, len(w), 16)):
                brute.add((d, i))
    assert leaks <= brute
    assert got == brute
    for r in rows:
        if r.doc_id % 2 == 0:
            words = texts[r.doc_id].split()[r.start_word : r.end_word]
            assert r.lcs == 1 and (words == items[r.item_id].rstrip(".").split() or len(words) > len(items[r.item_id].split()))


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    texts, items, leaks = corpus()
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = lambda: sorted(tuple(r) for r in dc.matches(documents(spark, texts), bench).drop("cosine").collect())
    whole = rows()
    assert leaks <= {r[:2] for r in whole}
    monkeypatch.setattr(dc, "BLOCK_WORDS", 100)
    assert len(dc.blocks_of(bench)[1]) > 5
    assert rows() == whole


def test_latent_space_equals_a_plain_svd(spark):
    """Singular values and leading vectors of the weighted matrix, against numpy's SVD of the whole of it."""
    texts = [" ".join(prose(200, i, 60)) for i in range(40)]
    terms = np.unique(dc.Words([" ".join(f"w{i}" for i in range(60))]).hashes)
    posted = documents(spark, texts).select("doc_id", "text").mapInArrow(dc._postings(terms), "doc_id long, segments long, terms binary, positions binary, term int, df long")
    idf = np.linspace(1, 2, 60) ** 4
    basis, values = dc.latent_space(posted.where("df is null"), idf, 50)
    a, size = np.zeros((40 * 13, 60)), np.zeros(40 * 13)
    for d, t in enumerate(texts):
        for i, h in enumerate(dc.Words([t]).hashes):
            j = int(np.searchsorted(terms, h))
            a[13 * d + i // 16, j] += idf[j]
            size[13 * d + i // 16] += idf[j] ** 2
    a /= np.sqrt(size)[:, None]
    u, s, v = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values[:40], s[:40], rtol=1e-3)
    assert np.abs(v[0] @ basis).max() > 0.99


def test_odd_rows(spark):
    item = " ".join(prose(30, 9))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents(spark, [None, "", "one", item, item, "pre " + item], [1, 2, 3, None, 7, 7])
    found = dc.matches(docs, bench)
    assert sorted((str(r.doc_id), r.item_id) for r in found.collect()) == [("7", 1), ("7", 1), ("None", 1)]
    assert dc.matches(documents(spark, []), bench).count() == 0
    assert dc.matches(docs, bench.limit(0)).count() == 0
    assert dc.remove_leaks(documents(spark, []), bench).count() == 0


def test_only_the_leaking_text_of_an_id_goes(spark):
    item = " ".join(prose(30, 9))
    clean = [" ".join(prose(40, 20 + i)) for i in range(4)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents(spark, [item, clean[0], clean[1], clean[2], "pre " + item, clean[3]], [None, None, None, 7, 7, 8])
    docs = docs.withColumn("text_key", F.lit(1)).withColumn("item_id", F.lit("clash"))
    left = dc.remove_leaks(docs, bench)
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == sorted(clean)


def test_long_texts_and_ties(spark):
    item = prose(30, 9)
    long = " ".join(prose(50_000, 1, 9000) + item + prose(50_000, 2, 9000) + item)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item))], "item_id long, text string")
    rows = dc.matches(documents(spark, [long]), bench).collect()
    assert sorted((r.item_id, r.lcs, r.start_word) for r in rows) == [(1, 1.0, 50_000), (2, 1.0, 50_000)]
