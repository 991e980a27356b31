import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from common import documents, prose
from lodestone.llm import substring_dedup as sd
from lodestone.llm.kit import Words


def brute_chain(x, y):
    """Best chain score over all predecessors."""
    order = sorted(range(len(x)), key=lambda i: (x[i], -y[i]))
    score = {}
    for i in order:
        score[i] = sd.GAIN + max([0.0, *(score[j] - sd.SKIP * (x[i] - x[j] + y[i] - y[j]) for j in score if x[j] < x[i] and y[j] < y[i])])
    return max(score.values())


def test_chain_equals_quadratic():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 40)
        pts = sorted((rng.randrange(60), rng.randrange(60)) for _ in range(n))
        x, y = (np.array(v) for v in zip(*pts))
        chains = sd.chain(x, y)
        assert sorted(i for c in chains for i in c) == list(range(n))
        first = chains[0]
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(first, first[1:]))
        got = len(first) * sd.GAIN - sd.SKIP * sum(x[b] - x[a] + y[b] - y[a] for a, b in zip(first, first[1:]))
        assert abs(got - brute_chain(x.tolist(), y.tolist())) < 1e-6


def test_runs_chain_like_their_matches():
    """Chains of whole groups, with runs taken together, against chains of single matches."""
    import pyarrow as pa

    rng = random.Random(9)
    for _ in range(40):
        rows = set()
        for doc in range(3):
            for src in range(rng.randrange(1, 3)):
                for _ in range(rng.randrange(1, 4)):
                    x, y = rng.randrange(0, 300), rng.randrange(0, 300)
                    rows |= {(10 + doc, src, x + i, y + i) for i in range(0, rng.randrange(1, 60), rng.randrange(1, 5))}
        rows = sorted(rows)
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(4))})
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        batches = [pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(zip(*rows[a:b]), kinds)), pa.array([False] * (b - a))], names=["doc_id", "src", "pos", "src_pos", "again"]) for a, b in zip(cuts, cuts[1:])]
        got = [r for x in sd._chains(50)(iter(batches)) for r in x.to_pylist()]
        by = {}
        for d, s, x, y in rows:
            by.setdefault((d, s), []).append((x, y))
        for (d, s), points in by.items():
            x, y = (np.array(v) for v in zip(*points))
            best = sd.chain(x, y)[0]
            mine = [r for r in got if (r["doc_id"], r["src"]) == (d, s)]
            covered = {w for r in mine for w in range(r["x0"], r["x1"])}
            if len(best) > 1 and all(x[b] - x[a] <= sd.GAP and y[b] - y[a] <= sd.GAP and abs(x[b] - x[a] - y[b] + y[a]) <= sd.SHIFT for a, b in zip(best, best[1:])):
                assert {w for i in best for w in range(x[i], x[i] + sd.K)} <= covered
            for r in mine:
                assert r["x_from"] <= r["x0"] < r["x1"] <= r["x_to"] and r["y_from"] <= r["y0"] < r["y1"] <= r["y_to"] and r["again"] == 0
                turns = [r["diagonals"][i : i + 3] for i in range(0, len(r["diagonals"]), 3)]
                assert turns[0][0] == r["x0"] and turns[0][2] == r["y0"] and turns[-1][1] == r["x1"]


def test_minimisers_cover_and_are_local():
    texts = [" ".join(prose(n, n)) for n in (0, 3, 5, 6, 40, 300)]
    h, d, pos = sd.minimisers(Words(texts))
    for i, t in enumerate(texts):
        alone = sd.minimisers(Words([t]))
        assert alone[0].tolist() == h[d == i].tolist() and alone[2].tolist() == pos[d == i].tolist()
        n = len(t.split()) - sd.K + 1
        for a in range(0, n - sd.WINDOW + 1):
            assert any(a <= p < a + sd.WINDOW for p in pos[d == i])


def corpus():
    rng = random.Random(5)
    passage, other = prose(80, 1000), prose(60, 1001)
    texts = [prose(rng.randrange(60, 200), i) for i in range(30)]
    texts[3][20:20] = passage
    texts[9][0:0] = passage
    fuzzy = list(passage)
    for i in range(7, 80, 19):
        fuzzy[i] = f"edit{i}"
    texts[12] += fuzzy
    gapped = passage[:30] + ["new", "words"] + passage[30:]
    texts[15][50:50] = gapped
    texts[20][10:10] = other
    texts[21][30:30] = other
    texts[22][30:30] = other[:30]  # too short
    texts.append(list(texts[5]))  # an exact copy
    return [" ".join(t) for t in texts]


def test_passages(spark):
    texts = corpus()
    docs = documents(spark, texts).withColumn("src", F.lit("clash")).withColumn("h", F.lit(0))
    rows = sd.passages(docs).collect()
    found = {(r.doc_id, r.source_doc_id): r for r in rows}
    assert set(found) == {(9, 3), (12, 3), (15, 3), (21, 20), (30, 5)}
    assert (found[9, 3].start_word, found[9, 3].end_word) == (0, 80)
    for r in rows:
        assert r.end_word - r.start_word >= 50 and r.identity >= 0.8
    # Against brute force: every pair of documents with a common run of 50 words is found.
    words = [t.split() for t in texts]
    grams = {}
    for i, w in enumerate(words):
        for j in range(len(w) - 49):
            grams.setdefault(tuple(w[j : j + 50]), set()).add(i)
    assert {i for s in grams.values() for i in s if i > min(s)} <= {r.doc_id for r in rows}
    cleaned = {r.doc_id: r for r in sd.remove_passages(docs, sd.passages(docs)).collect()}
    assert 30 not in cleaned and len(cleaned) == 30
    assert cleaned[21].text.split() == words[21][:30] + words[21][90:]
    assert cleaned[9].text.split() == words[9][80:] and cleaned[9].n_chars == len(cleaned[9].text)
    assert all(cleaned[i].text == texts[i] for i in range(30) if i not in (9, 12, 15, 21))


def test_odd_rows(spark):
    long = " ".join(prose(300, 3))
    docs = documents(spark, [None, "", "one two", long, long, long], [1, 2, 3, None, 7, 7])
    rows = sd.passages(docs).collect()
    assert {(r.doc_id, r.source_doc_id) for r in rows} == {(None, 7)}
    assert sd.passages(documents(spark, [])).count() == 0
    left = sd.remove_passages(docs, sd.passages(docs)).collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "2", "3", "7", "7"]
    empty = documents(spark, [])
    assert sd.remove_passages(empty, sd.passages(empty)).count() == 0


def test_passages_are_cut_from_their_own_text_only(spark):
    passage = prose(80, 1)
    holder, other, third = prose(30, 2) + passage, prose(200, 3), prose(40, 4)
    texts = [passage + prose(20, 5), holder, other, third, prose(60, 6) + passage]
    docs = documents(spark, [" ".join(t) for t in texts], [1, 7, 7, None, None]).withColumn("text_key", F.lit("clash")).withColumn("a", F.lit(0))
    found = sd.passages(docs)
    assert found.count() == 2
    left = sd.remove_passages(docs, found)
    assert left.columns == docs.columns
    assert sorted(tuple(r.text.split()) for r in left.collect()) == sorted(map(tuple, [texts[0], holder[:30], other, third, texts[4][:60]]))


def test_long_texts_and_ties(spark):
    passage = prose(70, 1)
    long = prose(40_000, 2, 10**6) + passage + prose(40_000, 3, 10**6)
    texts = [" ".join(long), " ".join(prose(30, 4) + passage + prose(30, 5)), " ".join(passage + prose(10, 6) + passage)]
    rows = sd.passages(documents(spark, texts)).collect()
    assert {(r.doc_id, r.source_doc_id) for r in rows} == {(1, 0), (2, 0)}
    assert {i for r in rows if r.doc_id == 2 for i in range(r.start_word, r.end_word)} >= {*range(70), *range(80, 150)}


def groups(rows):
    """What _matched() is to give, from lists by key."""
    want, by = [], {}
    for h, salt, d, p in sorted(rows):
        by.setdefault((h, salt), []).append((d, p))
    for (h, salt), held in by.items():
        if salt:
            want.append((h, *held[0], *held[0], False))
        if len({d for d, _ in held}) == 1:
            continue
        for d, p in held:
            want.append((None, d, p, *held[0], False))
            before = [x for x in held if x[0] < d]
            if before and before[-1][0] != held[0][0]:
                want.append((None, d, p, *before[-1], True))
    return want


def test_matches_by_key_do_not_depend_on_batches():
    import pyarrow as pa

    rng = random.Random(2)
    for _ in range(60):
        rows = sorted({(rng.randrange(4), rng.choice([0, 0, 1, 2]), rng.randrange(5), rng.randrange(6)) for _ in range(rng.randrange(1, 60))})
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(rng.randrange(6)))})
        batches = [pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[a:b]), (pa.int64(), pa.int32(), pa.int64(), pa.int32()))], names=["h", "salt", "doc_id", "pos"]) for a, b in zip(cuts, cuts[1:])]
        got = [(r["h"], r["doc_id"], r["pos"], r["src"], r["src_pos"], r["again"]) for x in sd._matched(iter(batches)) for r in x.to_pylist()]
        assert sorted(got, key=str) == sorted(groups(rows), key=str)
        less = [(r["h"], r["doc_id"], r["pos"], r["src"], r["src_pos"], r["again"]) for x in sd._matched(iter(batches), False) for r in x.to_pylist()]
        assert sorted(less, key=str) == sorted((x for x in groups(rows) if x[0] is not None or not x[5] and x[1] != x[3]), key=str)


def test_hot_seeds_are_matched_in_groups(spark, monkeypatch):
    monkeypatch.setattr(sd, "HOT_LEAST", 1)
    passage = prose(80, 1)
    texts = [" ".join(prose(30, 10 + 2 * i) + passage + prose(30, 11 + 2 * i)) for i in range(400)]
    rows = sd.passages(documents(spark, texts)).collect()
    whole = {r.doc_id for r in rows if r.start_word <= 30 and r.end_word >= 110}
    assert whole == set(range(1, 400)) and all(r.source_doc_id < r.doc_id for r in rows)


def test_cut_keeps_the_rest():
    assert sd.cut("Éa, b!\nC  d.", [(1, 3)]) == "Éa,   d."
    assert sd.cut("a b c", [(0, 2), (1, 9)]) == ""


def test_one_word_over_and_over(spark):
    texts = ["alpha beta " + "The " * 70 + "omega", "x y z " + "The " * 130, "The " * 40, " ".join(prose(60, 5))]
    rows = sd.passages(documents(spark, texts)).collect()
    covered = {i for r in rows if r.doc_id == 1 for i in range(r.start_word, r.end_word)}
    assert {r.doc_id for r in rows} == {1} and {r.source_doc_id for r in rows} == {0}
    assert set(range(3, 120)) <= covered


@pytest.mark.parametrize("width", [2, 6, 12, 30])
def test_a_line_over_and_over(spark, width):
    line = prose(width, 40 + width) * (120 // width)
    texts = [" ".join(prose(40, 2 * i) + line + prose(40, 2 * i + 1)) for i in range(2)]
    rows = sd.passages(documents(spark, texts)).collect()
    covered = {i for r in rows for i in range(r.start_word, r.end_word)}
    assert {(r.doc_id, r.source_doc_id) for r in rows} == {(1, 0)} and set(range(40, 160)) <= covered


def pairs(spark, count, make):
    """How many of ``count`` passages are found; make(i) gives the two forms of one, put into different surroundings."""
    texts = []
    for i in range(count):
        texts += [" ".join(prose(60, 9_000 + 4 * i + 2 * j) + p + prose(60, 9_001 + 4 * i + 2 * j)) for j, p in enumerate(make(i))]
    rows = sd.passages(documents(spark, texts)).collect()
    return sum(any((r.doc_id, r.source_doc_id) == (2 * i + 1, 2 * i) for r in rows) for i in range(count))


def changed(n, every):
    def make(i):
        p = prose(n, 5_000 + i, 10**9)
        return p, [f"edit{j}" if j % every == every - 1 else w for j, w in enumerate(p)]

    return make


def test_fuzzy_recall(spark):
    assert pairs(spark, 40, changed(60, 10)) >= 38
    assert pairs(spark, 40, changed(60, 8)) >= 35


def test_equal_passage_of_lines_that_others_have_first(spark):
    texts, want = [], {}
    for i in range(12):
        lines = [prose(20, 700 + 10 * i + j, 10**9) for j in range(4)]
        texts += [" ".join(prose(30, 8_000 + 9 * i + j) + line + prose(30, 8_500 + 9 * i + j)) for j, line in enumerate(lines)]
        for j in range(2):
            texts.append(" ".join(prose(40, 8_900 + 4 * i + 2 * j) + sum(lines, []) + prose(40, 8_901 + 4 * i + 2 * j)))
        want[len(texts) - 1] = len(texts) - 2
    rows = sd.passages(documents(spark, texts)).collect()
    for doc, source in want.items():
        covered = {i for r in rows if (r.doc_id, r.source_doc_id) == (doc, source) for i in range(r.start_word, r.end_word)}
        assert set(range(40, 120)) <= covered


def test_word_inserted_near_an_edge(spark):
    def inserted(n, at):
        def make(i):
            p = prose(n, 6_000 + i, 10**9)
            return p, p[:at] + ["new"] + p[at:]

        return make

    assert pairs(spark, 40, inserted(60, 12)) >= 39
    assert pairs(spark, 40, inserted(52, 8)) >= 38


def mosaics(spark, count, change):
    """How many of ``count`` passages of 120 words are found whole, of which three earlier documents hold 40 words each."""
    texts, want = [], {}
    for i in range(count):
        p = prose(120, 50_000 + i, 10**9)
        texts += [" ".join(prose(30, 60_000 + 8 * i + j) + p[40 * j : 40 * j + 40] + prose(30, 70_000 + 8 * i + j)) for j in range(3)]
        for j, q in enumerate((p, change(p))):
            texts.append(" ".join(prose(40, 80_000 + 8 * i + j) + q + prose(40, 90_000 + 8 * i + j)))
        want[len(texts) - 1] = len(q)
    rows = sd.passages(documents(spark, texts)).collect()
    covered = {d: {w for r in rows if r.doc_id == d for w in range(r.start_word, r.end_word)} & set(range(40, 40 + n)) for d, n in want.items()}
    # Two-sided: nothing but the second holder of each passage has one.
    assert {r.doc_id for r in rows} <= set(want)
    return sum(len(c) >= 0.9 * want[d] for d, c in covered.items())


def test_mosaics(spark):
    assert mosaics(spark, 100, lambda p: p) == 100


def test_fuzzy_mosaics(spark):
    assert mosaics(spark, 100, lambda p: [f"edit{i}" if i % 12 == 7 else w for i, w in enumerate(p)]) >= 95


def test_sampled_seeds_without_a_window():
    words = Words([" ".join(prose(400, i)) for i in range(5)] + ["", "a b", "one two three four five six"])
    h, d, pos = sd.minimisers(words)
    few = h < np.uint64(2**64 // sd.SAMPLE)
    for a, b in zip(sd.minimisers(words, window=0), (h, d, pos)):
        assert a.tolist() == b[few].tolist() and len(a)


def test_chained_equals_a_plain_form_and_leftovers_cost_little():
    """Matches of long groups that no chain takes are told apart without numpy calls for each."""
    rng = np.random.default_rng(8)
    groups = []
    for g in range(60):
        x = np.unique(rng.integers(0, 4000, 700))
        y = np.where(rng.random(len(x)) < 0.4, x + 100 + rng.integers(0, 3), rng.integers(0, 4000, len(x)))
        groups.append(np.array([np.full(len(x), g + 1), np.zeros(len(x), np.int64), x, y, rng.integers(0, 2, len(x))]))
    rows = list(np.concatenate(groups, axis=1).astype(np.int64))
    took = lambda f: min((lambda t: (f(), time.process_time() - t)[1])(time.process_time()) for _ in range(3))
    alone = took(lambda: [sd.chain(g[2], g[3]) for g in groups])
    assert took(lambda: sd._chained(rows, 6)) < 2 * alone

    want = set()
    for doc, _, x, y, again in groups:
        first = np.flatnonzero(np.append(True, (np.diff(y) != np.diff(x)) | (np.diff(x) > sd.GAP)))
        last = np.append(first[1:], len(x)) - 1
        a, b, c, d = x[first], x[last], y[first], y[last]
        for path in sd.chain(a, c, b, d, sd.GAIN * (last - first + 1) - 2 * sd.SKIP * (b - a)):
            step = [(a[q] - b[p], c[q] - d[p]) for p, q in zip(path, path[1:])]
            cuts = [0, *(j for j, s in enumerate(step, 1) if max(s) > sd.GAP or abs(s[0] - s[1]) > sd.SHIFT), len(path)]
            for part in (path[i:j] for i, j in zip(cuts, cuts[1:])):
                all_ = np.concatenate([again[first[i] : last[i] + 1] for i in part])
                if b[part[-1]] - a[part[0]] + sd.K >= 6 and (len(all_) >= sd.AGAIN or not all_.all()):
                    want.add(tuple(map(int, (doc[0], a[part[0]], b[part[-1]] + sd.K, c[part[0]], d[part[-1]] + sd.K))))
    got = sd._chained(rows, 6)
    assert {tuple(r[c] for c in ("doc_id", "x0", "x1", "y0", "y1")) for r in got.to_pylist()} == want and len(want) > 100


def test_packed_hashes():
    h = np.random.default_rng(2).integers(0, 2**63, 50, dtype=np.uint64)
    assert (sd.unpacked(sd.packed(h)) == h % np.uint64(256**sd.BYTES)).all() and len(sd.packed(h)) == 6 * 50
    assert len(sd.unpacked(sd.packed(h[:0]))) == 0
