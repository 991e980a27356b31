"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols through a lexicon (insult, threat, target, negation, reported speech).
Four transducers, each a small machine over symbols, are composed into one:

* negation: an insult or threat within three words after a negation becomes a denied one;
* reported speech: after a verb of saying, what follows in the clause becomes a quoted one;
* target: an insult or threat becomes an aimed one when a person is named before it in the clause, and one that
  waits is aimed by a person named after it (a bare threat weighs nothing until it is aimed);
* insult and threat: maps what is left to weights.

A clause's score is the weight of its path.  Matched clauses add up to a document's evidence,
which a logistic curve turns into a score.  The insult lexicon has a fixed part and a part
learned from labelled rows: words that toxic texts of many different kinds share and other
texts do not.  The curve is fitted on the same rows.  Labels of held-out rows, lang, source
and doc_id are no inputs.

Defined results: null and empty texts have no clause and score the curve's value at no
evidence; a null doc_id is not held out and is returned as null; rows that repeat are
scored each; without labels the fixed lexicon and curve apply; extra columns are ignored by
score_documents() and kept by reject_toxic().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.kit import Scratch, Words, hash_words, keyed, pieces, shingles, unkeyed
from lodestone.llm.labelled import SAMPLE, held_out, training_rows

# The built-in lexicon in English, French, German and Spanish.
INSULTS = """idiot moron stupid dumb imbecile loser scum trash clown worthless pathetic disgusting filthy
    bastard bitch asshole dickhead fool jerk retard freak pig vermin crap fuck fucking shit
    imbécile crétin connard connasse salaud salope abruti débile ordure pute merde
    idiotin dummkopf trottel arschloch schwachkopf abschaum hurensohn wichser miststück scheiße
    idiota imbécil estúpido estúpida cabrón gilipollas basura asqueroso asquerosa puta mierda""".split()
THREATS = """kill murder destroy hurt strangle stab shoot beat
    tuer tuerai frapper töten umbringen schlagen matar mataré golpear""".split()
YOU = """you your yours yourself u
    tu toi vous votre ton ta du dich dir ihr euch sie tú usted ustedes te ti vos""".split()
TARGETS = """he she they him her them his their""".split()
NEGATIONS = """not no never isn aren wasn don doesn didn neither nor without
    pas jamais non ne nicht kein keine keinen nie niemals nunca jamás sin""".split()
REPORTS = """said says say wrote writes claimed claims called reported quoted according alleged
    dit écrit déclaré selon sagte sagt schrieb laut behauptete dijo dice escribió según""".split()

O, INSULT, THREAT, TARGET, YOU_, NOT, SAID, DENIED_INSULT, DENIED_THREAT, QUOTED_INSULT, QUOTED_THREAT, AIMED_INSULT, AIMED_THREAT, END = range(14)
SYMBOLS = 14


@dataclass
class Transducer:
    """Deterministic: step[state][symbol] = (next state, symbol out, weight); state 0 starts."""

    step: list[list[tuple[int, int, float]]]

    @classmethod
    def make(cls, states: int, arcs: dict[tuple[int, int], tuple[int, int, float]], otherwise) -> Transducer:
        return cls([[arcs.get((s, x)) or (otherwise(s, x), x, 0.0) for x in range(SYMBOLS)] for s in range(states)])

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: what this puts out is what other reads; weights add."""
        names, step, todo = {(0, 0): 0}, [], [(0, 0)]
        while todo:
            a, b = todo.pop(0)
            row = []
            for x in range(SYMBOLS):
                a2, y, w = self.step[a][x]
                b2, z, v = other.step[b][y]
                if (a2, b2) not in names:
                    names[a2, b2] = len(names)
                    todo.append((a2, b2))
                row.append((names[a2, b2], z, w + v))
            step.append(row)
        return Transducer(step)

    def weight(self, symbols) -> float:
        state, total = 0, 0.0
        for x in (*symbols, END):
            state, _, w = self.step[state][x]
            total += w
        return total


def grammar() -> Transducer:
    # States count the words since a negation: 3 just after it, 0 none near.
    negation = Transducer.make(4, {(s, x): (s - 1, y, 0.0) for s in (1, 2, 3) for x, y in ((INSULT, DENIED_INSULT), (THREAT, DENIED_THREAT))} | {(s, NOT): (3, NOT, 0.0) for s in range(4)}, lambda s, x: 0 if x == END else max(0, s - 1))
    reported = Transducer.make(2, {(1, x): (1, y, 0.0) for x, y in ((INSULT, QUOTED_INSULT), (THREAT, QUOTED_THREAT))} | {(0, SAID): (1, SAID, 0.0), (1, END): (0, END, 0.0)}, lambda s, x: s)
    # State 1: a target was seen in this clause; 2: an insult waits for one, 3: a threat, 4: both.
    # A threat at the person spoken to weighs more than one at others ("they beat him").
    aimed = {(1, INSULT): (1, AIMED_INSULT, 0.0), (1, THREAT): (1, AIMED_THREAT, 0.0)}
    aimed |= {(0, INSULT): (2, INSULT, 0.0), (0, THREAT): (3, THREAT, 0.0), (2, THREAT): (4, THREAT, 0.0), (3, INSULT): (4, INSULT, 0.0)}
    after = {2: (0.5, 0.5), 3: (0.6, 1.0), 4: (1.1, 1.5)}
    aimed |= {(state, x): (1, x, w) for state, both in after.items() for x, w in zip((TARGET, YOU_), both)}
    target = Transducer.make(5, aimed | {(s, END): (0, END, 0.0) for s in range(5)}, lambda s, x: 1 if x in (TARGET, YOU_) else s)
    weights = {INSULT: 1.0, AIMED_INSULT: 1.5, DENIED_INSULT: 0.2, QUOTED_INSULT: 0.3, THREAT: 0.0, AIMED_THREAT: 0.6, DENIED_THREAT: 0.0, QUOTED_THREAT: 0.1}
    scores = Transducer.make(1, {(0, x): (0, O, w) for x, w in weights.items()}, lambda s, x: 0)
    return negation @ reported @ target @ scores


@dataclass
class Model:
    """Lexicon by word hash, and the curve: score = logistic(bias + slope * log(1 + evidence))."""

    learned: list[int] = field(default_factory=list)
    bias: float = -4.0
    slope: float = 8.0

    def lexicon(self) -> tuple[np.ndarray, np.ndarray]:
        table = {}
        for kind, words in ((TARGET, TARGETS), (YOU_, YOU), (NOT, NEGATIONS), (SAID, REPORTS), (THREAT, THREATS), (INSULT, INSULTS)):
            table |= dict.fromkeys(hash_words(words).tolist(), kind)
        for h in self.learned:
            table.setdefault(int(np.int64(h).view(np.uint64)), INSULT)
        keys = np.array(sorted(table), np.uint64)
        return keys, np.array([table[int(k)] for k in keys], np.int8)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + self.slope * np.log1p(evidence))))


_BREAK = np.zeros(256, bool)
_BREAK[[ord(x) for x in ".,;:!?\n|()"]] = True


def evidence(texts: list[str | None], keys: np.ndarray, kinds: np.ndarray, machine: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """Sum of clause weights, and number of matched clauses, of each text."""
    words = Words(texts)
    h, total, clauses = words.hashes, np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    kind = np.where(keys[at] == h, kinds[at], O)
    hits = np.flatnonzero((kind == INSULT) | (kind == THREAT))
    if not len(hits):
        return total, clauses
    clause = np.cumsum(_BREAK[words.buffer])[words.starts]
    doc = words.doc
    for c in np.unique(clause[hits]):
        a, b = np.searchsorted(clause, [c, c + 1])
        w = machine.weight(kind[a:b].tolist())
        if w > 0:
            total[doc[a]] += w
            clauses[doc[a]] += 1
    return total, clauses


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each training text with its label and kind (least shingle: near copies share it)."""
    for batch in pieces(batches):
        words = Words(batch["text"].to_pylist())
        n = len(words.counts)
        values, owner = shingles(words)
        kind = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(kind, owner, values)
        order = np.lexsort((words.hashes, words.doc))
        h, d = words.hashes[order], words.doc[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[first], d[first]
        label = np.asarray(batch["label"])
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(label[d].astype(np.int32)), pa.array(kind[d].view(np.int64))], names=["word", "label", "kind"])


def _evidence_rows(model: Model, columns: list[str]):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, kinds = model.lexicon()
        machine = grammar()
        for batch in pieces(batches):
            total, clauses = evidence(batch["text"].to_pylist(), keys, kinds, machine)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(total), pa.array(clauses), pa.array(model.score(total))], names=[*columns, "evidence", "clauses", "score"])

    return build


def _fit_curve(total: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression on log(1 + evidence) with a weak pull towards the default curve."""
    x, y = np.column_stack([np.ones(len(total)), np.log1p(total)]), label.astype(float)
    prior, w = np.array([Model.bias, Model.slope]), np.array([Model.bias, Model.slope])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.5 * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2), grad)
        w = w - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.5))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: int = 5, ratio: float = 12.0) -> Model:
    """Learn insult words and the curve from at most ``sample`` labelled rows.

    A word is learned when at least ``least`` kinds of toxic text have it (near copies are one
    kind) and its rate among toxic texts, less one deviation, is ``ratio`` times that among others.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.table(training_rows(docs, labels, "toxic", sample), "training")
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    good, bad = n.get(0, 0), n.get(1, 0)
    model = Model()
    if good and bad:
        toxic = F.col("label") == 1
        counts = rows.mapInArrow(_words_of, "word long, label int, kind long").groupBy("word").agg(F.count_distinct(F.when(toxic, F.col("kind"))).alias("kinds"), F.count_if(toxic).alias("a"), F.count_if(~toxic).alias("b"))
        sure = (F.col("kinds") - F.sqrt("kinds")) / bad >= ratio * (F.col("b") + 1) / good
        model.learned = [r["word"] for r in counts.where((F.col("kinds") >= least) & sure).select("word").collect()]  # at most a share of the sample's words
        known = rows.mapInArrow(_evidence_rows(model, ["label"]), "label int, evidence double, clauses long, score double").select("evidence", "label").toPandas()
        model.bias, model.slope = _fit_curve(known["evidence"].to_numpy(), known["label"].to_numpy())
    scratch.drop(rows)
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence, clauses) of every document."""
    out = keyed(docs).mapInArrow(_evidence_rows(model, ["doc_id"]), "doc_id long, evidence double, clauses long, score double")
    return out.withColumn("doc_id", unkeyed()).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "evidence", "clauses")


def _kept(model: Model, threshold: float):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, kinds = model.lexicon()
        machine = grammar()
        for batch in pieces(batches):
            total, _ = evidence(batch["text"].to_pylist(), keys, kinds, machine)
            yield batch.filter(pa.array(model.score(total) < threshold))

    return build


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents, with all columns, that score below the threshold; null and empty texts score as no evidence does."""
    return docs.mapInArrow(_kept(model, threshold), docs.schema)
