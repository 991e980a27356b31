"""Quality by a generalised additive model with pairwise interactions.

Each text is FEATURES numbers.  Each feature is cut into bins; boosting goes round the
features in turn, and each time fits a shallow tree on the bins of one feature to what is
left of the log loss and adds it, damped, to that feature's lookup table.  The pairs whose
joint table explains most of the rest get tables of their own by the same cyclic boosting.
A score is then a sum of table entries: one vectorised gather for each feature and pair.

Defined results: null and empty texts have all features 0 and are scored like any other; a
null doc_id is not held out and is returned as null; rows that repeat are scored each; with
labels of one kind only, or none, every score is that share (or 0.5); extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.kit import Words, keyed, mix, pieces, unkeyed
from lodestone.llm.labelled import SAMPLE, held_out, training_rows

FEATURES = [
    "log_words", "word_length", "upper", "digits", "signs", "bars", "exclamations", "full_stops", "sign_runs",
    "distinct_words", "repeated_word", "top_word", "repeated_pair", "line_length", "repeated_lines", "capitalised",
]
BINS, PAIR_BINS, PAIRS = 32, 8, 6


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = _table("0123456789")
_SIGNS = _table("!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~")
_LINE = _table("\n")


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and occurrences of the most frequent, of each text."""
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(v)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[at], many)
    return np.bincount(d[at], minlength=n), top


def features(texts: list[str | None]) -> np.ndarray:
    n = len(texts)
    words = Words(texts, lower=False)
    buffer, h, doc = words.buffer, words.hashes, words.doc
    size = np.maximum(np.diff(words.base) - 1, 0).astype(float)
    some, nw = np.maximum(size, 1), np.maximum(words.counts, 1).astype(float)
    edges = np.concatenate([words.base[:-1], [len(buffer)]]).astype(np.int64)

    def share(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (c[edges[1:]] - c[edges[:-1]]) / some

    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = np.log1p(words.counts)
    out[:, 1] = np.bincount(doc, words.ends - words.starts, n) / nw
    upper = _UPPER[buffer]
    out[:, 2] = share(upper)
    out[:, 3] = share(_DIGITS[buffer])
    signs = _SIGNS[buffer]
    out[:, 4] = share(signs)
    out[:, 5] = share(buffer == ord("|"))
    out[:, 6] = share(buffer == ord("!"))
    out[:, 7] = share(buffer == ord(".")) * some / nw
    again = np.zeros(len(buffer), bool)
    again[1:] = signs[1:] & (buffer[1:] == buffer[:-1])
    out[:, 8] = share(again)
    distinct, top = _distinct(doc, h, n)
    out[:, 9], out[:, 11] = distinct / nw, top / nw
    follows = np.zeros(len(h), bool)
    follows[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out[:, 10] = np.bincount(doc, follows, n) / nw
    if len(h) > 1:
        inner = doc[1:] == doc[:-1]
        with np.errstate(over="ignore"):
            pair = mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])
        pairs, _ = _distinct(doc[:-1][inner], pair[inner], n)
        out[:, 12] = 1 - pairs / np.maximum(words.counts - 1, 1)
        out[words.counts < 2, 12] = 0
    # Lines, as the sum of their words: how many, how long, how many twice.
    with np.errstate(over="ignore"):
        line = np.cumsum(_LINE[buffer])[words.starts]
        if len(h):
            at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            total = mix(np.add.reduceat(h, at))
            owner = doc[at]
            lines = np.maximum(np.bincount(owner, minlength=n), 1)
            kinds, _ = _distinct(owner, total, n)
            out[:, 13] = np.log1p(words.counts / lines)
            out[:, 14] = np.where(words.counts > 0, 1 - kinds / lines, 0)
    out[:, 15] = np.bincount(doc, upper[words.starts], n) / nw
    return out


@dataclass
class Additive:
    """bias, cuts of each feature, its table, and pairs with coarse cuts and tables."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return -g / (h + 1.0)


def _split_at(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of binned gradients."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of each bin of a tree with at most 2 ** depth leaves."""
    gain, at = _split_at(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([shallow_tree(g[:at], h[:at], depth - 1), shallow_tree(g[at:], h[at:], depth - 1)])


def shallow_tree_2d(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The pair of cuts, one on each axis, whose four leaves gain most."""
    if min(g.shape) < 2:
        return shallow_tree(g.reshape(-1), h.reshape(-1)).reshape(g.shape)

    def quarters(v: np.ndarray) -> np.ndarray:
        c = v.cumsum(0).cumsum(1)
        low = c[:-1, :-1]
        above, beside = c[:-1, -1:] - low, c[-1:, :-1] - low
        return np.stack([low, above, beside, c[-1, -1] - low - above - beside])

    gs, hs = quarters(g), quarters(h)
    r, c = np.unravel_index((gs**2 / (hs + 1)).sum(0).argmax(), gs.shape[1:])
    leaf = _leaf(gs[:, r, c], hs[:, r, c]).reshape(2, 2)
    return np.repeat(np.repeat(leaf, [r + 1, g.shape[0] - r - 1], axis=0), [c + 1, g.shape[1] - c - 1], axis=1)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 50, rate: float = 0.15) -> Additive:
    k = len(FEATURES)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    cuts = [quantile_cuts(x[:, j], BINS) if len(x) else np.zeros(0) for j in range(k)]
    coarse = [quantile_cuts(x[:, j], PAIR_BINS) if len(x) else np.zeros(0) for j in range(k)]
    model = Additive(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], coarse, [], [])
    if not len(y) or y.min() == y.max():
        return model
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    wide = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]
    f = np.full(len(y), model.bias)

    def gradients():
        p = 1 / (1 + np.exp(-f))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            g, h = gradients()
            size = len(model.tables[j])
            step = rate * shallow_tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size))
            model.tables[j] += step
            f += step[bins[j]]
    g, h = gradients()
    gains = []
    for i in range(k):
        for j in range(i + 1, k):
            shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            cell = wide[i] * shape[1] + wide[j]
            gg, hh = np.bincount(cell, g, shape[0] * shape[1]), np.bincount(cell, h, shape[0] * shape[1])
            gains.append((float((gg**2 / (hh + 1)).sum()), i, j, cell, shape))
    best = sorted(gains, key=lambda v: -v[0])[:PAIRS]
    model.pairs = [(i, j) for _, i, j, _, _ in best]
    model.pair_tables = [np.zeros(shape) for *_, shape in best]
    for _ in range(pair_rounds):
        for table, (_, _, _, cell, shape) in zip(model.pair_tables, best):
            g, h = gradients()
            size = shape[0] * shape[1]
            step = rate * shallow_tree_2d(np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape))
            table += step
            f += step.reshape(-1)[cell]
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        x = features(batch["text"].to_pylist())
        yield pa.RecordBatch.from_arrays([batch["label"], *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["label", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Additive:
    """Fit on at most ``sample`` labelled rows that are not held out."""
    rows = training_rows(docs, labels, "quality", sample)
    known = rows.mapInArrow(_feature_rows, "label int, " + ", ".join(f"{c} double" for c in FEATURES)).toPandas()
    known = known.sort_values(list(known.columns))  # the fit does not depend on the order of rows
    return fit(known[FEATURES].to_numpy(), known["label"].to_numpy(float))


def _scores(model: Additive):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(features(batch["text"].to_pylist())))], names=["doc_id", "score"])

    return build


def score_documents(docs: DataFrame, model: Additive, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = keyed(docs).mapInArrow(_scores(model), "doc_id long, score double").withColumn("doc_id", unkeyed())
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
