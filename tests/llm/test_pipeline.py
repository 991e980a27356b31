import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from common import documents, prose
from lodestone.llm import decontaminate, jaccard_join, substring_dedup
from lodestone.llm.kit import Scratch, components, contracted


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def similarity(a, b):
    return 1.0 if a == b else len(a & b) / max(1, len(a | b))


def near_corpus():
    rng = random.Random(11)
    texts = []
    for g in range(12):
        base = prose(rng.randrange(8, 150), g)
        texts.append(" ".join(base))
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [None, "", "?!", "one", "One.", "one two three", "one two three", "x " * 50, "x " * 80]
    return texts


def brute(texts, threshold=0.8):
    sets = sets_of(texts)
    n = len(texts)
    linked = [[j for j in range(n) if j != i and (sets[i] == sets[j] or sets[i] and sets[j] and similarity(sets[i], sets[j]) >= threshold)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in linked[i])]) for i in range(n)]
    copy = [min(j for j in range(n) if sets[j] == sets[i]) for i in range(n)]
    return [(i, copy[i], root[i], len(linked[i])) for i in range(n)]


@pytest.mark.parametrize("node,block", [(4096, 1024), (4, 3)])
def test_join_equals_brute_force(spark, monkeypatch, node, block):
    monkeypatch.setattr(jaccard_join, "NODE", node)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    texts = near_corpus()
    docs = documents(spark, texts).withColumn("n", F.lit("clash")).withColumn("sig1", F.lit(1))
    rows = sorted(tuple(r) for r in jaccard_join.jaccard_join(docs).collect())
    assert rows == brute(texts)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[2] for r in brute(texts)})


def test_join_odd_rows(spark):
    long, other = " ".join(prose(60)), " ".join(prose(70, 9))
    docs = documents(spark, [long, long, long, other, "alone"], [None, 5, 5, 5, 9])
    rows = sorted(((r.doc_id, r.copy_of, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect()), key=str)
    assert [r[0] for r in rows] == [5, 5, 5, 9, None]
    assert rows[3] == (9, 9, 9, 0)
    # One text of 5 keeps the id, the other and the text without one are numbered above 9.
    classes = {r[2] for r in rows if r[3] == 2}
    assert len(classes) == 1 and sum(r[3] == 2 for r in rows) == 3 and rows[4][3] == 2
    assert len({r[2] for r in rows}) == 3 and {r[2] for r in rows} - {5, 9} <= set(range(10, 12))
    kept = jaccard_join.keep_one(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("5", long), ("5", other), ("9", "alone")])
    assert jaccard_join.jaccard_join(documents(spark, [])).count() == 0
    assert jaccard_join.keep_one(documents(spark, [])).count() == 0


def test_keep_one_loses_no_text_of_a_null_or_repeated_id(spark):
    texts = [" ".join(prose(40, i)) for i in range(5)]
    docs = documents(spark, texts, [None, None, None, 5, 5])
    assert jaccard_join.jaccard_join(docs).count() == 5
    assert sorted(r.text for r in jaccard_join.keep_one(docs).collect()) == sorted(texts)
    # 1 = X, 5 = X and Y: the copy of X goes, Y stays, whatever the hashes are.
    for i in range(4):
        x, y = " ".join(prose(40, 50 + i)), " ".join(prose(40, 60 + i))
        kept = jaccard_join.keep_one(documents(spark, [x, x, y], [1, 5, 5])).collect()
        assert sorted((r.doc_id, r.text) for r in kept) in ([(1, x), (5, y)], [(5, x), (5, y)])


def test_long_texts(spark):
    base = prose(60_000, 3, 10**6)
    near = base[:30_000] + ["changed"] + base[30_001:]
    rows = {r.doc_id: r for r in jaccard_join.jaccard_join(documents(spark, [" ".join(base), " ".join(near), " ".join(prose(50_000, 4, 10**6))])).collect()}
    assert [rows[i].class_id for i in range(3)] == [0, 0, 2] and rows[0].n_links == 1


def pair_corpus(pairs, groups, rng):
    """Pairs of texts at a similarity of 0.8 whose shared words hold a line that a whole group has."""
    texts = []
    for i in range(pairs):
        line = prose(24, 70_000 + i % groups, 10**9)
        common = line + [f"c{rng.randrange(10**12)}" for _ in range(160)]
        for _ in range(2):
            texts.append(" ".join(common + [f"x{rng.randrange(10**12)}" for _ in range(20)]))
    return texts


@pytest.mark.parametrize("node", [1024, 8])
def test_recall_end_to_end(spark, monkeypatch, node):
    """Pairs just above the threshold, in nodes that must be descended, with all steps after the paths."""
    monkeypatch.setattr(jaccard_join, "NODE", node)
    texts = pair_corpus(300, 6, random.Random(4))
    sets = sets_of(texts[:2])
    assert 0.8 <= similarity(*sets) < 0.83
    rows = {r.doc_id: r.class_id for r in jaccard_join.jaccard_join(documents(spark, texts)).collect()}
    assert sum(rows[2 * i + 1] == 2 * i for i in range(300)) >= 299


def test_large_nodes_of_near_copies(spark, monkeypatch):
    """A node that no path splits: near copies round a pivot, and others that share a line with them."""
    monkeypatch.setattr(jaccard_join, "NODE", 8)
    rng = random.Random(6)
    base = prose(120, 1, 10**9)
    texts = []
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(40, 120)] = f"edit{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(base[:30] + prose(60, 100 + i, 10**9)) for i in range(40)]
    rows = sorted(tuple(r) for r in jaccard_join.jaccard_join(documents(spark, texts)).collect())
    assert rows == brute(texts)


def test_runs_hold_at_any_depth():
    miss, runs = 0.0, jaccard_join.runs_for(0.9999, 0.8)
    for _ in range(1000):  # levels
        miss = np.exp(jaccard_join.SPREAD * (miss - 1))
        assert miss**runs <= 1e-4 / 2
    a = np.arange(1, 65, dtype=np.uint8)[None, :]
    b = a.copy()
    b[0, 36:] += 100  # 36 of 64 bins alike: a chance of 1e-5 at 0.8
    assert jaccard_join._near(a, np.array([100]), b, np.array([100]), 0.8).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_contracted_edges_connect_the_same():
    rng = np.random.default_rng(3)
    for _ in range(100):
        n, m = rng.integers(1, 40), rng.integers(0, 40)
        a, b = rng.integers(0, n, m) * 7 - 50, rng.integers(0, n, m) * 7 - 50
        up = {}

        def find(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            x, y = find(x), find(y)
            up[max(x, y)] = min(x, y)
        node, root = contracted(a, b)
        got = dict(zip(node.tolist(), root.tolist()))
        assert all(got.get(x, x) == find(x) for x in {*a.tolist(), *b.tolist()}) and (node > root).all()


def test_few_rounds(spark, monkeypatch):
    """Nodes that stay large, as below a line that many documents have, cost few rounds of shuffles; a path within one task costs one."""
    made, table = [], Scratch.table

    def counted(self, df, name="t"):
        made.append(name)
        return table(self, df, name)

    monkeypatch.setattr(Scratch, "table", counted)
    path = spark.range(0, 3000, 1, 1).selectExpr("id + 1 AS a", "id AS b")
    assert {r.root for r in components(path, Scratch(spark, "t")).collect()} == {0}
    assert made.count("links") <= 2  # the stars that the task makes of it, and no more rounds
    made.clear()
    monkeypatch.setattr(jaccard_join, "NODE", 4)
    line = prose(24, 5)
    texts = [" ".join(line + prose(20, 100 + i // 2 if i < 20 else 100 + i)) + (" end" if i % 2 else "") for i in range(120)]
    sets = sets_of(texts)
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(documents(spark, texts)).collect()}
    assert all(got[i].n_links == sum(similarity(sets[i], s) >= 0.8 for j, s in enumerate(sets) if j != i) for i in range(120))
    assert got[1].class_id == 0 and made.count("entries") <= 3  # 6 before


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    clean = [prose(rng.randrange(60, 200), 100 + i, 3000) for i in range(60)]
    texts = [" ".join(x) for x in clean]
    near = list(clean[3])
    near[10] = "changed"
    texts.append(" ".join(near))  # 60: near copy of 3
    texts.append(texts[5])  # 61: copy of 5
    texts.append(" ".join(prose(50, 900) + ["you", "idiot", "moron", "scum", "idiot"]))  # 62: toxic
    texts.append(" ".join(prose(90, 901, 3000) + clean[7][:58] + prose(30, 902, 3000)))  # 63: repeats a passage of 7
    item = prose(40, 903, 500)
    texts.append(" ".join(prose(30, 904, 3000) + item + prose(30, 905, 3000)))  # 64: leak
    texts += [None, "short one"]  # 65, 66
    root = f"{tmp_path}/sf"
    docs = documents(spark, texts)
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i == 62)) for i in range(0, 64, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    want = {i: t for i, t in enumerate(texts) if i not in (60, 61, 62, 64)}
    want[63] = " ".join(prose(90, 901, 3000)) + "  " + " ".join(prose(30, 902, 3000))
    left = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, root)
        assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()} == want
    rows = corpus_pipeline.run(spark, root).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {(r.doc_id, r.length) for r in rows} == {(i, len(plain.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in want.items()}
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 4096) or len({r.sequence_id for r in rows}) <= 5


def test_pipeline_loses_no_clean_text(spark, tmp_path):
    """Null and repeated ids, empty texts, clashing columns: each stage keeps what is clean, and so does the whole."""
    import corpus_pipeline

    clean = [" ".join(prose(80, 700 + i, 3000)) for i in range(8)]
    ids = [None, None, None, 7, 7, 8, 9, 10]
    item = " ".join(prose(40, 999, 500))
    toxic = " ".join(prose(30, 998)) + " you idiot you moron scum idiot"
    docs = documents(spark, [*clean, "", None, item, toxic], [*ids, None, 7, None, 7])
    docs = docs.withColumns({c: F.lit("clash") for c in ("text_key", "score", "item_id", "class_id", "piece")})
    root = f"{tmp_path}/sf"
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(0, item), (None, "x"), (1, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(7, 1, 0), (8, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    left = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, root)
        assert left.columns == docs.columns
    texts = [r.text for r in left.collect()]
    assert sorted(t for t in texts if t) == sorted(clean) and len(texts) == 9  # and one of the two empty texts
    rows = corpus_pipeline.run(spark, root).collect()
    assert len(rows) == 9 and sum(r.doc_id is None for r in rows) >= 3
    empty = f"{tmp_path}/empty"
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{root}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
