import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from common import documents, prose
from lodestone.llm import quality, toxicity
from lodestone.llm.toxicity import INSULT, NOT, O, SAID, TARGET, THREAT, YOU_


def brute_weight(symbols):
    """The grammar's rules, clause by clause, without machines."""
    total, since, said, target, waiting, threat = 0.0, 99, False, False, False, False
    for x in symbols:
        denied = since <= 3
        since += 1
        if x == NOT:
            since = 1
        if x == SAID:
            said = True
        if x in (TARGET, YOU_):
            if not target:
                total += 0.5 * waiting + (1.0 if x == YOU_ else 0.6) * threat
            target = True
        if x in (INSULT, THREAT):
            if denied:
                total += 0.2 if x == INSULT else 0.0
            elif said:
                total += 0.3 if x == INSULT else 0.1
            elif target:
                total += 1.5 if x == INSULT else 0.6
            elif x == INSULT:
                total += 1.0
                waiting = True
            else:
                threat = True
    return total


def test_composition_equals_the_rules():
    machine = toxicity.grammar()
    for n in range(5):
        for symbols in itertools.product([O, INSULT, THREAT, TARGET, YOU_, NOT, SAID], repeat=n):
            assert abs(machine.weight(symbols) - brute_weight(symbols)) < 1e-9, symbols
    rng = random.Random(0)
    for _ in range(500):
        s = [rng.choice([O, INSULT, THREAT, TARGET, YOU_, NOT, SAID]) for _ in range(rng.randrange(15))]
        assert abs(machine.weight(s) - brute_weight(s)) < 1e-9


def test_clauses():
    keys, kinds = toxicity.Model().lexicon()
    ev = lambda t: toxicity.evidence([t], keys, kinds, toxicity.grammar())[0][0]
    assert ev("You are an idiot.") == 1.5 and ev("He is not an idiot.") == pytest.approx(0.2)
    assert ev("They said, idiot") == 1.0 and ev("they said idiot") == pytest.approx(0.3)
    assert ev("I will kill you") == 1 and ev("you I will kill") == pytest.approx(0.6) and ev("They beat him") == pytest.approx(0.6)
    assert ev("We beat eggs, you eat") == 0 and ev("I will not kill you") == 0 and ev("he said I kill you") == pytest.approx(0.1)
    assert ev("Idiot, I will hurt you") == 2 and ev("idiot I hurt you") == pytest.approx(2.5)
    model = toxicity.Model()
    assert model.score(np.array([ev("I will kill you")]))[0] >= 0.7 > model.score(np.array([ev("They beat him")]))[0]
    assert ev("nothing here") == 0 and ev(None) == 0 and ev("scum. moron!") == 2


def labelled(spark, n=400):
    rng = random.Random(1)
    foreign = [f"zlur{i}" for i in range(6)]
    texts, toxic = [], []
    for i in range(n):
        words = prose(rng.randrange(20, 120), i, 3000)
        bad = i % 4 == 0
        for _ in range(4 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(foreign if i % 8 else ["idiot", "moron"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return documents(spark, texts), spark.createDataFrame([(i, 1 - t, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int"), toxic


def test_toxicity_learns_words(spark):
    docs, labels, toxic = labelled(spark)
    # Held-out labels are turned round: a model that learned from them would fail.
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    model = toxicity.train(docs, wrong)
    rows = toxicity.score_documents(docs.withColumn("score", F.lit("x")), model).collect()
    assert len(rows) == 400 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(r.predicted == toxic[r.doc_id] and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(toxic) if not t}


def test_toxicity_odd_rows(spark):
    docs = documents(spark, [None, "", "You idiot, you moron, you scum", "fine"], [1, None, 2, 2])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score_documents(docs, toxicity.train(docs, none)).collect()
    assert sorted((str(r.doc_id), r.predicted) for r in rows) == [("1", 0), ("2", 0), ("2", 1), ("None", 0)]
    assert toxicity.score_documents(documents(spark, []), toxicity.Model()).count() == 0


def test_toxicity_and_quality_of_long_texts_and_clashing_columns(spark):
    long = " ".join(prose(100_000, 1))
    docs = documents(spark, [long, long + " you idiot you moron you scum"]).withColumns({c: F.lit("clash") for c in ("score", "predicted", "evidence", "held_out", "label")})
    rows = {r.doc_id: r for r in toxicity.score_documents(docs, toxicity.Model()).collect()}
    assert rows[0].predicted == 0 and rows[1].predicted == 1
    assert toxicity.reject_toxic(docs, toxicity.Model()).columns == docs.columns
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_documents(docs, quality.train(docs, none)).count() == 2


def brute_features(t):
    import re

    t = t or ""
    raw = t.encode()
    words = [w.encode() for w in re.findall(r"\w+", t)]
    n, b = len(words), max(1, len(raw))
    out = {"log_words": np.log1p(n), "word_length": sum(map(len, words)) / max(1, n), "upper": sum(65 <= x <= 90 for x in raw) / b, "digits": sum(48 <= x <= 57 for x in raw) / b}
    out["bars"], out["exclamations"] = raw.count(b"|") / b, raw.count(b"!") / b
    out["distinct_words"] = len(set(words)) / max(1, n)
    out["repeated_word"] = sum(x == y for x, y in zip(words, words[1:])) / max(1, n)
    out["top_word"] = max([words.count(w) for w in words], default=0) / max(1, n)
    pairs = list(zip(words, words[1:]))
    out["repeated_pair"] = 1 - len(set(pairs)) / len(pairs) if pairs else 0
    lines = [tuple(re.findall(r"\w+", x)) for x in t.split("\n")]
    lines = [x for x in lines if x]
    out["repeated_lines"] = 1 - len(set(lines)) / len(lines) if lines else 0
    out["capitalised"] = sum(65 <= w[0] <= 90 for w in words) / max(1, n)
    return out


def test_features_equal_brute_force():
    texts = ["Aa bb bb, cc!\nxx yy\nxx yy\n\n| 12 |", None, "", "É é É", "ONE!! TWO!! $$$ ***", " ".join(prose(500))]
    got = quality.features(texts)
    for row, t in zip(got, texts):
        for k, v in brute_features(t).items():
            assert abs(row[quality.FEATURES.index(k)] - v) < 1e-9, (t, k)
    alone = np.concatenate([quality.features([t]) for t in texts])
    assert np.allclose(alone, got)


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (2, 5) in model.pairs
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


@pytest.mark.parametrize("target", ["quality", "toxic"])
def test_held_out_accuracy_on_the_tables(spark, target):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    module = quality if target == "quality" else toxicity
    rows = module.score_documents(docs, module.train(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    assert (rows["predicted"] == rows[target]).mean() > (0.97 if target == "quality" else 0.98)


def test_quality_odd_rows(spark):
    docs = documents(spark, [None, "", "x"], [1, None, 1])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(docs, quality.train(docs, none)).collect()
    assert [r.score for r in rows] == [0.5] * 3
    one_kind = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_documents(docs, quality.train(docs, one_kind)).count() == 3
    assert quality.score_documents(documents(spark, []), quality.train(docs, none)).count() == 0
