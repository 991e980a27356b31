"""Fuzzy passages that repeat across documents, by collinear chaining.

Seeds are five-word windows: those of the least 1 / SAMPLE of all hashes, whose choice does not depend on
the words around, and the minimisers of WINDOW neighbours (few more), so that any run of
WINDOW + 4 equal words shares a seed.  A seed that several documents have is matched to its
first occurrence (least doc_id, then position) and to the one in the document before: a star and a path, and
not a clique, so matches grow with the occurrences.  The matches of a document with one source are chained
in order on both sides; a chain gains for each seed and pays for the words it skips on either side, and the
best predecessor is a prefix maximum in a Fenwick tree over source positions.  Chains are then
aligned word by word and extended beyond their outer seeds; passages of at least
``min_words`` words and the given identity are returned.  Chains with the document before are only
aligned where no passage of a first source covers them: a passage put together from parts that
other documents had first singly.

Equal runs do not rest on seeds' sources: of all windows of ``min_words`` words whose sampled seeds
are shared, each is matched to the first document with the same whole window.

Seeds and windows are matched in one shuffle by hash.  A hash that a large share of all documents has is
dealt to SALTS groups by document: each matches its own first occurrence, and the firsts of the
groups are matched among themselves afterwards.

A passage is reported in every document but the one that has it first, so removing what is
reported leaves one copy.

Defined results: null, empty and short texts have no passages; texts that share an id, or have none, are
documents of their own (told apart by text_key, null where the id has no other text), which come after
the others; rows equal in id and text are one document; repeats inside one document are not
passages across documents and stay; no rows give no rows; extra columns are ignored by
passages() and kept by remove_passages().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.kit import Identity, Scratch, Words, lists, matching, mix, pieces, runs

K, WINDOW, SAMPLE = 5, 16, 4
#: A hash is hot if this share of a hundredth of the documents has it (and HOT_LEAST of them), so there are 1 / HOT at most.
HOT, HOT_LEAST, SALTS = 1e-5, 100, 64
#: Words between repeats of a seed that count as a run, and places after which a run is matched anew.
PERIOD, RUN = 64, 64
#: What a seed gains, and what each skipped word costs on either side.
GAIN, SKIP = 5.0, 0.1
#: Words between neighbouring seeds, and change of diagonal, at which a chain is cut.
GAP, SHIFT = 40, 16
#: Words beyond a chain's outer seeds that the alignment looks at.
MARGIN = 48
#: Of a word's hash, what alignments compare: two words of a pair of passages are taken for equal with a chance of 2^-48.
BYTES = 6
#: Seeds that a chain with the document before needs; one with a first source needs two.
AGAIN = 3


def minimisers(words: Words, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position) of the seeds; a text's seeds depend on that text alone.  With no window, only those of least hashes."""
    h, n = words.hashes, len(words)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = words.doc
    g = np.zeros(n - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            g = g * np.uint64(0x9FB21C651E98DF25) + h[j : n - k + 1 + j]
    at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    g, d = mix(g[at]), doc[at]
    sampled = g < np.uint64(2**64 // SAMPLE)
    if not window:
        return g[sampled], d[sampled], at[sampled] - words.first[d[sampled]]
    # Texts are set apart by ``window`` neutral places, so no window spans two of them.
    shift = np.concatenate([[0], np.cumsum(d[1:] != d[:-1])]) * window + window
    place = np.arange(len(g)) + shift
    top = np.iinfo(np.uint64).max
    line = np.full(int(place[-1]) + 1 + window, top, np.uint64)
    line[place] = g
    low = _sliding(line, window, np.minimum)  # low[i]: least of line[i : i + window]
    held = _sliding(np.where(low == top, np.uint64(0), low), window, np.maximum)  # held[i]: greatest of low[i : i + window]
    chosen = (held[place - window + 1] == g) | sampled
    pos = at[chosen] - words.first[d[chosen]]
    return g[chosen], d[chosen], pos


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """of() over x[i : i + width], by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = of(x[:-step], x[step:])
        done += step
    return x


def numbered_runs(h: np.ndarray, d: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of each seed: repeats of a seed at most PERIOD words apart are a run, as in a line over
    and over, and each is keyed by its place in the run (modulo RUN), so that runs match place by place."""
    place = np.zeros(len(h), np.int64)
    with np.errstate(over="ignore"):
        own = h ^ mix(d.astype(np.uint64) + np.uint64(1))
    line = np.sort(own)
    twice = line[1:][line[1:] == line[:-1]]
    some = np.flatnonzero(np.isin(own, twice)) if len(twice) else np.zeros(0, np.int64)  # few seeds repeat in a text
    if len(some):
        order = some[np.lexsort((pos[some], h[some], d[some]))]
        ho, do, po = h[order], d[order], pos[order]
        same = np.zeros(len(order), bool)
        same[1:] = (ho[1:] == ho[:-1]) & (do[1:] == do[:-1]) & (po[1:] <= po[:-1] + PERIOD)
        at = np.arange(len(order))
        place[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    with np.errstate(over="ignore"):
        return place, np.where(place > 0, mix(h + (place % RUN).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)), h)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        h, d, pos = minimisers(Words(batch["text"].to_pylist()))
        place, key = numbered_runs(h, d, pos)
        again = place > 0  # also under its plain key, for a source that has it once
        h, d, pos = np.concatenate([key, h[again]]), np.concatenate([d, d[again]]), np.concatenate([pos, pos[again]])
        ids = np.asarray(batch["doc_id"])
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[d]), pa.array(pos.astype(np.int32))], names=["h", "doc_id", "pos"])


def chain(x: np.ndarray, y: np.ndarray, x1: np.ndarray | None = None, y1: np.ndarray | None = None, gain: np.ndarray | None = None) -> list[list[int]]:
    """Chains of matches (x ascending) as index lists: strictly increasing in x and y, best first, each match once.

    A match may be a run of them from (x, y) to (x1, y1) with a gain of its own; runs share no x.
    """
    n = len(x)
    x1, y1 = x if x1 is None else x1, y if y1 is None else y1
    order = np.lexsort((-y, x))  # equal x: larger y first, so they never follow each other
    values = np.unique(np.concatenate([y, y1]))
    begins, ends = np.searchsorted(values, y).tolist(), np.searchsorted(values, y1).tolist()
    size = len(values)
    best, who = [-1e300] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    from_, to = (SKIP * (x + y)).tolist(), (SKIP * (x1 + y1)).tolist()
    gains = [GAIN] * n if gain is None else gain.tolist()
    for i in order.tolist():
        top, prev = 0.0, -1
        j = begins[i]  # sources strictly before
        here = from_[i]
        while j > 0:
            if best[j] - here > top:
                top, prev = best[j] - here, who[j]
            j &= j - 1
        score[i], back[i] = gains[i] + top, prev
        value, j = score[i] + to[i], ends[i] + 1
        while j <= size:
            if value > best[j]:
                best[j], who[j] = value, i
            j += j & -j
    used, found = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if path:
            found.append(path[::-1])
    return found


def grid(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The window that stands for words a to b: a text has few of them, however many chains ask for its words."""
    bits = np.frexp((b - a - 1).astype(np.float64))[1]
    step = np.maximum(32, 1 << np.maximum(bits - 2, 0).astype(np.int64))
    a = a - a % step
    return a, a + 5 * step


def _chains(min_words: int):
    least = min(min_words, K + 1)  # two seeds

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "src", "pos", "src_pos", "again")
        held = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            rows = [np.concatenate([x, np.asarray(batch[c].cast(pa.int64()))]) for x, c in zip(held, names)]
            other = np.flatnonzero((rows[0] != rows[0][-1:]) | (rows[1] != rows[1][-1:]))
            cut_ = int(other[-1]) + 1 if len(other) else 0  # the last pair of documents may go on
            yield _chained([x[:cut_] for x in rows], least)
            held = [x[cut_:] for x in rows]
        yield _chained(held, least)

    return build


def _chained(rows: list[np.ndarray], least: int) -> pa.RecordBatch:
    """Chains of whole groups of matches of two documents, sorted by (doc_id, src, pos, src_pos).

    Neighbouring matches on one diagonal are a run; a pair of documents with one run has one chain.
    """
    doc, src, x, y, again = rows
    new = _changes(doc, src)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(x)))
    if len(begin):  # one seed is no chain
        wide = (x[begin + size - 1] - x[begin] + K >= least) & ((size >= AGAIN) | (np.minimum.reduceat(again, begin) == 0))
        wide = np.repeat(wide, size)
        doc, src, x, y, again, new = (v[wide] for v in (doc, src, x, y, again, new))
    tie = np.zeros(len(x), bool)
    tie[1:] = ~new[1:] & (x[1:] == x[:-1])
    tie[:-1] |= tie[1:]
    cut_ = new | tie
    cut_[1:] |= tie[:-1] | (y[1:] - x[1:] != y[:-1] - x[:-1]) | (x[1:] - x[:-1] > GAP)
    first = np.flatnonzero(cut_)
    last = np.append(first[1:], len(x)) - 1 if len(first) else first
    x0, x1, y0, y1, many = x[first], x[last], y[first], y[last], last - first + 1
    late = np.minimum.reduceat(again, first) if len(first) else again
    group = np.flatnonzero(new[first])
    runs_ = np.diff(np.append(group, len(first)))
    lone = group[runs_ == 1]
    lone = lone[(x1[lone] - x0[lone] + K >= least) & ((many[lone] >= AGAIN) | (late[lone] == 0))]
    parts: list[list] = [[] for _ in range(7)]  # doc, src, x0, x1, y0, y1, again
    turns: list[list[int]] = []
    for g, n in zip(group[runs_ > 1].tolist(), runs_[runs_ > 1].tolist()):
        a, b, c, d, m, l = (v[g : g + n] for v in (x0, x1, y0, y1, many, late))
        paths = chain(a, c, b, d, GAIN * m - 2 * SKIP * (b - a))
        pair = int(doc[first[g]]), int(src[first[g]])
        a, b, c, d, m, l = (v.tolist() for v in (a, b, c, d, m, l))  # paths are short, and most are one run
        for path in paths:
            at = 0
            for j in range(1, len(path) + 1):
                q = path[j - 1]
                if j < len(path):
                    dx, dy = a[path[j]] - b[q], c[path[j]] - d[q]
                    if dx <= GAP and dy <= GAP and -SHIFT <= dx - dy <= SHIFT:
                        continue
                part, at = path[at:j], j
                p = part[0]
                if b[q] - a[p] + K < least:
                    continue
                late_ = min([l[i] for i in part])
                if not late_ or sum([m[i] for i in part]) >= AGAIN:
                    for held, value in zip(parts, (*pair, a[p], b[q] + K, c[p], d[q] + K, late_)):
                        held.append(value)
                    turns.append(_diagonals([(a[i], b[i], c[i]) for i in part]))
    columns = [np.concatenate([v, np.array(w, np.int64)]) for v, w in zip((doc[first[lone]], src[first[lone]], x0[lone], x1[lone] + K, y0[lone], y1[lone] + K, late[lone]), parts)]
    doc, src, x0, x1, y0, y1, late = columns
    sizes = np.concatenate([np.full(len(lone), 3), np.array([len(t) for t in turns], np.int64)])
    flat = np.concatenate([np.column_stack([v[: len(lone)] for v in (x0, x1, y0)]).reshape(-1), np.array([i for t in turns for i in t], np.int64)])
    x_from, x_to = grid(np.maximum(0, x0 - MARGIN), x1 + MARGIN)
    y_from, y_to = grid(np.maximum(0, y0 - MARGIN), y1 + MARGIN)
    values = [pa.array(v.astype(np.int64)) for v in (doc, x_from, x0, x1, x_to, src, y_from, y0, y1, y_to, late)]
    return pa.RecordBatch.from_arrays([*values, lists(flat.astype(np.int64), sizes, pa.int64())], names=[c.split()[0] for c in _CHAIN.split(", ")])


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where any of the keys differs from the row before."""
    new = np.ones(len(keys[0]), bool)
    for i, k in enumerate(keys):
        new[1:] = (k[1:] != k[:-1]) | (new[1:] if i else False)
    return new


_CHAIN = "doc_id long, x_from long, x0 long, x1 long, x_to long, src long, y_from long, y0 long, y1 long, y_to long, again long, diagonals array<long>"


def _diagonals(runs_: list[tuple[int, int, int]]) -> list[int]:
    """Runs of seeds (first, last, first in the source) by diagonals, flat: where each begins and ends in the text, and begins in the source."""
    flat: list[int] = []
    for x0, x1, y0 in runs_:
        if flat and y0 - x0 == flat[-1] - flat[-3]:
            flat[-2] = x1 + K
        else:
            flat += (x0, x1 + K, y0)
    return flat


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}[c.split()[1]] for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _candidates(words: Words, i: int, shared: np.ndarray, seeds: tuple, n: int) -> np.ndarray:
    """Where the windows of n words of text i begin that another document may have: no sampled seed in them is its alone."""
    first, pos = seeds
    own = np.zeros(int(words.first[i + 1] - words.first[i]) + 1, np.int64)
    own[1 + pos[first[i] : first[i + 1]]] = 1
    own[1 + shared] = 0
    count, before = len(own) - 1, np.cumsum(own)
    at = np.arange(max(0, count - n + 1))
    return at[before[at + max(0, n - K + 1)] == before[at]]


def _windows_of(w: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n words."""
    base = 0x9FB21C651E98DF25
    out, done, power = np.zeros(len(w) - n + 1, np.uint64), 0, w  # power: windows of ``width`` words
    width, factor = 1, base
    with np.errstate(over="ignore"):
        while True:
            if n & width:
                out = out * np.uint64(factor) + power[done : done + len(out)]
                done += width
            if 2 * width > n:
                return mix(out)
            power = power[:-width] * np.uint64(factor) + power[width:]
            width, factor = 2 * width, factor * factor % 2**64


def packed(h: np.ndarray) -> bytes:
    """The low BYTES of each hash."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpacked(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(x, np.uint8).reshape(-1, BYTES)
    return out.view(np.uint64).reshape(-1)


def _segments(min_words: int):
    """The word hashes of each wanted range of each text; with a below 0, the hashes of the windows from -1 - a on."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = Words(batch["text"].to_pylist())
            h, d, pos = minimisers(words, window=0)
            alone = numbered_runs(h, d, pos)[0] == 0
            seeds = np.searchsorted(d[alone], np.arange(batch.num_rows + 1)), pos[alone]
            hashes = words.hashes
            ids, a, b, w = [], [], [], []
            for i, (doc, wanted, shared) in enumerate(zip(batch["doc_id"].to_pylist(), batch["wanted"], batch["seeds"])):
                lo, hi = words.first[i], words.first[i + 1]
                for x, y in zip(wanted.values.field("a").to_pylist(), wanted.values.field("b").to_pylist()):
                    ids.append(doc)
                    a.append(x)
                    b.append(y)
                    w.append(packed(hashes[min(hi, lo + x) : min(hi, lo + y)]))
                at = _candidates(words, i, np.asarray(shared.values), seeds, min_words)
                if len(at):
                    each = _windows_of(hashes[lo:hi], min_words)
                    for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                        ids.append(doc)
                        a.append(-1 - int(run[0]))
                        b.append(len(run))
                        w.append(each[run].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.binary())], names=["doc_id", "a", "b", "w"])

    return build


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            n = np.asarray(part["b"])
            h = np.frombuffer(b"".join(part["w"].to_pylist()), np.int64)
            start = np.repeat(-1 - np.asarray(part["a"]) - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(np.asarray(part["doc_id"]), n)), pa.array((start + np.arange(len(h))).astype(np.int32))], names=["h", "doc_id", "pos"])


def covering(x: np.ndarray, y: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Few equal passages (from, to, from in the source) that cover all words of the windows x (ascending), which begin at y in the source."""
    cuts = [0, *(np.flatnonzero((np.diff(x) != 1) | (np.diff(y) != 1)) + 1).tolist(), len(x)]
    spans = [(int(x[a]), int(x[b - 1]) + n, int(y[a])) for a, b in zip(cuts, cuts[1:])]
    out, end, i = [], -1, 0
    while i < len(spans):
        if spans[i][0] > end:  # nothing before reaches it
            j = i
        else:
            j = i
            while j + 1 < len(spans) and spans[j + 1][0] <= end:
                j += 1  # ends ascend, so the last that touches reaches furthest
            if spans[j][1] <= end:
                i = j + 1
                continue
        out.append(spans[j])
        end, i = spans[j][1], j + 1
    return out


def _equal(min_words: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for table in runs(batches, ["doc_id", "src"]):
            doc, src = table["doc_id"][0].as_py(), table["src"][0].as_py()
            x, at = np.unique(np.asarray(table["pos"]).astype(np.int64), return_index=True)
            rows += [(doc, a, b, src, c, c + b - a, 1.0) for a, b, c in covering(x, np.asarray(table["src_pos"]).astype(np.int64)[at], min_words)]
            if len(rows) > 20_000:
                yield _rows(rows, _PASSAGE)
                rows = []
        yield _rows(rows, _PASSAGE)

    return build


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    row = np.zeros(len(b) + 1, np.int64)
    for v in a:
        nxt = row.copy()
        nxt[1:] = np.maximum(row[1:], row[:-1] + (b == v))
        row = np.maximum.accumulate(nxt)
    return int(row[-1])


def reach(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of margins (words outward from a chain): how far the best alignment with gaps goes in
    both (match 1, edit -1), and its matches; all pairs advance together."""
    m, wide, long = len(a), max(map(len, b), default=0), max(map(len, a), default=0)
    left, right = np.zeros((m, long), np.uint64), np.ones((m, wide), np.uint64)
    for i, (x, y) in enumerate(zip(a, b)):
        left[i, : len(x)], right[i, : len(y)] = x, y
    # A score times 256 plus the matches: among equal scores, more matches.
    cost = 256 * np.arange(wide + 1, dtype=np.int32)
    row = np.broadcast_to(-cost, (m, wide + 1)).astype(np.int32)
    best, at_x, at_y = (np.zeros(m, np.int64) for _ in range(3))
    for i in range(long):
        new = row - 256
        np.maximum(new[:, 1:], row[:, :-1] + np.where(right == left[:, i, None], 257, -256).astype(np.int32), out=new[:, 1:])
        row = np.maximum.accumulate(new + cost, axis=1) - cost
        j = row.argmax(1)
        top = row[np.arange(m), j]
        more = top > best
        best[more], at_x[more], at_y[more] = top[more], i + 1, j[more]
    return at_x, at_y, best & 255


def align(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int]:
    """Ends of a chain in a, ends in b, and its equal words, from its diagonal runs (x0, x1, y0).

    Words between seeds of a run are compared one to one, words between two runs by their
    longest common subsequence.
    """
    same, at_x, at_y = 0, runs[0][0], runs[0][2]
    for x0, x1, y0 in runs:
        over = max(0, at_x - x0, at_y - y0)  # seeds of neighbouring runs may overlap
        x0, y0 = x0 + over, y0 + over
        if x0 > at_x and y0 > at_y:
            same += lcs(a[at_x:x0], b[at_y:y0])
        if x1 > x0:
            same += int((a[x0:x1] == b[y0 : y0 + x1 - x0]).sum())
            at_x, at_y = x1, y0 + x1 - x0
    return runs[0][0], at_x, runs[0][2], at_y, same


_PASSAGE = "doc_id long, start_word long, end_word long, source_doc_id long, source_start_word long, source_end_word long, identity double"


def _aligned(min_words: int, identity: float):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 1000):
                rows, ends, inner, outer = batch.slice(at, 1000).to_pylist(), [], ([], []), ([], [])
                for r in rows:
                    a, b = unpacked(r["aw"]), unpacked(r["bw"])
                    d, u, v = r["diagonals"], r["x_from"], r["y_from"]
                    x0, x1, y0, y1, same = align(a, b, [(d[i] - u, d[i + 1] - u, d[i + 2] - v) for i in range(0, len(d), 3)])
                    ends.append((x0, x1, y0, y1, same))
                    for side, x, y in ((inner, a[:x0][::-1], b[:y0][::-1]), (outer, a[x1:], b[y1:])):
                        side[0].append(x[:MARGIN])
                        side[1].append(y[:MARGIN])
                for r, (x0, x1, y0, y1, same), px, py, p, qx, qy, q in zip(rows, ends, *(v.tolist() for v in reach(*inner)), *(v.tolist() for v in reach(*outer))):
                    x0, x1, y0, y1 = x0 - px, x1 + qx, y0 - py, y1 + qy
                    same = (same + p + q) / max(x1 - x0, y1 - y0)
                    if x1 - x0 >= min_words and same >= identity:
                        out.append((r["doc_id"], r["x_from"] + x0, r["x_from"] + x1, r["src"], r["y_from"] + y0, r["y_from"] + y1, round(same, 6)))
            yield _rows(out, _PASSAGE)

    return build


_MATCH = "doc_id long, src long, pos int, src_pos int, again boolean, h long"


def _matched(batches: Iterator[pa.RecordBatch], full: bool = True) -> Iterator[pa.RecordBatch]:
    """Matches from rows sorted by (h, salt, doc_id, pos): each occurrence of what several documents of a group
    have with the group's first one, and (again) with the last one of the document before, if that is another.
    Not full: only occurrences in other documents than the first, with the first.

    For a salted group also its first occurrence itself, as a row with h.  Only the group at the end of a
    batch is carried on: as a whole while one document has it, then its first row, its last document and the row before.
    """
    names = ("h", "salt", "doc_id", "pos")
    held, done = [np.zeros(0, np.int64)] * 4, np.zeros(0, bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        h, salt, d, p = (np.concatenate([x, np.asarray(batch[c]).astype(np.int64)]) for x, c in zip(held, names))
        done = np.concatenate([done, np.zeros(batch.num_rows, bool)])
        n = len(h)
        group, doc = np.ones(n, bool), np.ones(n, bool)
        group[1:] = (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])
        doc[1:] = group[1:] | (d[1:] != d[:-1])
        begin = np.flatnonzero(group)
        size = np.diff(np.append(begin, n))
        first, last = np.repeat(begin, size), np.repeat(begin + size - 1, size)
        shared = d[first] != d[last]
        runs_ = np.flatnonzero(doc)
        before = np.repeat(runs_ - 1, np.diff(np.append(runs_, n)))  # the last row of the document before
        more = shared & ~done & (before >= first) & (d[before] != d[first])
        one = np.flatnonzero(shared & ~done & (full | (d != d[first])))
        two = np.flatnonzero(more & full)
        told = begin[(salt[begin] > 0) & ~done[begin]]
        # What is carried on of the last group.
        end = int(begin[-1])
        if d[end] == d[-1]:
            keep, seen = np.arange(end, n), done[end:]
            told = told[told != end]
        else:
            keep = np.unique(np.concatenate([[end], np.arange(max(end, int(runs_[-1]) - 1), n)]))  # and the row before that document
            seen = np.ones(len(keep), bool)
        yield _match_rows(d, p, h, one, first[one], two, before[two], told)
        held, done = [x[keep] for x in (h, salt, d, p)], seen
    if len(held[0]) and held[1][0] > 0 and not done[0]:
        h, _, d, p = held
        none = np.zeros(0, np.int64)
        yield _match_rows(d, p, h, none, none, none, none, np.zeros(1, np.int64))


def _match_rows(d, p, h, one, first, two, before, told) -> pa.RecordBatch:
    at, src = np.concatenate([one, two, told]), np.concatenate([first, before, told])
    kind = np.repeat([0, 1, 2], [len(one), len(two), len(told)])
    return pa.RecordBatch.from_arrays(
        [pa.array(d[at]), pa.array(d[src]), pa.array(p[at].astype(np.int32)), pa.array(p[src].astype(np.int32)), pa.array(kind == 1), pa.array(h[at], mask=kind < 2)],
        names=["doc_id", "src", "pos", "src_pos", "again", "h"],
    )


def _linked(keys: DataFrame, some: DataFrame, scratch: Scratch, full: bool = True) -> DataFrame:
    """(doc_id, src, pos, src_pos, again): each occurrence of an h that several documents have, with other ones, and (full) the first with itself.

    some: the keys of a hundredth of the documents, which tell the hot ones; what is hot changes how rows
    are dealt to tasks and, for again, which of the documents before counts, and no more.
    """
    counts = scratch.table(some.groupBy("h").count().where("count > 1"), "some")
    least = max(HOT_LEAST, HOT * (counts.agg(F.sum("count")).first()[0] or 0))
    hot = scratch.table(counts.where(F.col("count") >= least).select("h", F.lit(True).alias("hot")), "hot")  # 1 / HOT rows at most
    salt = F.when(F.col("hot"), 1 + F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = keys.join(F.broadcast(hot), "h", "left").select("h", salt.alias("salt"), "doc_id", "pos")
    order = ["h", "salt", "doc_id", "pos"]
    matched = lambda batches: _matched(batches, full)
    found = scratch.table(dealt.repartition("h", "salt").sortWithinPartitions(*order).mapInArrow(matched, _MATCH), "matches")
    scratch.free()
    firsts = found.where("h is not null").select("h", F.lit(0).alias("salt"), "doc_id", "pos")  # SALTS of a hot hash
    among = scratch.table(firsts.repartition("h").sortWithinPartitions(*order).mapInArrow(matched, _MATCH), "firsts")
    scratch.drop(counts, hot)
    out = found.where("h is null").union(among).drop("h")
    out._parts = (found, among)
    return out


def _hundredth(rows: DataFrame) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(100)) == 0)


def _passages(chains: DataFrame, segments: DataFrame, min_words: int, identity: float) -> DataFrame:
    """The passages that chains align to.  Sources come first, while rows are narrow, as many chains may have one source."""
    right = segments.select(F.col("doc_id").alias("src"), F.col("a").alias("y_from"), F.col("b").alias("y_to"), F.col("w").alias("bw"))
    left = segments.select("doc_id", F.col("a").alias("x_from"), F.col("b").alias("x_to"), F.col("w").alias("aw"))
    start = F.greatest(F.lit(0), F.col("y0") - MARGIN, F.col("y_from"))
    sourced = chains.join(right.hint("merge"), ["src", "y_from", "y_to"]).withColumn("start", start)
    words = F.expr(f"substring(bw, cast({BYTES} * (start - y_from) + 1 as int), cast({BYTES} * (y1 + {MARGIN} - start) as int))")
    sourced = sourced.withColumn("bw", words).withColumn("y_from", F.col("start")).drop("start")
    both = sourced.join(left.hint("merge"), ["doc_id", "x_from", "x_to"])
    return both.select(*(c.split()[0] for c in _CHAIN.split(", ")), "aw", "bw").mapInArrow(_aligned(min_words, identity), _PASSAGE).distinct()


def _outside(rows: DataFrame, found: DataFrame, fits: str) -> DataFrame:
    wider = found.select(F.col("doc_id").alias("d"), F.col("source_doc_id").alias("s"), F.col("start_word").alias("a"), F.col("end_word").alias("b"))
    return rows.join(wider.hint("merge"), F.expr(fits), "left_anti")


def passages(docs: DataFrame, min_words: int = 50, identity: float = 0.8) -> DataFrame:
    """(doc_id, start_word, end_word, source_doc_id, source_start_word, source_end_word, identity, text_key) of each repeated passage.

    Word numbers count from 0 and ends are exclusive.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    names = Identity(docs, scratch)
    rows = names.texts(docs)
    seeds = lambda texts: texts.mapInArrow(_seeds, "h long, doc_id long, pos int")
    matches = _linked(seeds(rows), seeds(_hundredth(rows)), scratch)
    chains = matches.where("doc_id > src").repartition("doc_id").sortWithinPartitions("doc_id", "src", "pos", "src_pos").mapInArrow(_chains(min_words), _CHAIN)
    chains = scratch.table(chains, "chains")
    scratch.free()
    wanted = chains.select("doc_id", F.col("x_from").alias("a"), F.col("x_to").alias("b")).union(chains.select("src", "y_from", "y_to")).distinct()
    # A text's own windows, and its shared seeds (b null); written, so that the matches can go before texts are read again.
    wanted = wanted.select("doc_id", F.col("a").cast("int"), F.col("b").cast("int")).union(matches.where("not again").select("doc_id", "pos", F.lit(None).cast("int")))
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("a", "b"))).alias("wanted"), F.collect_list(F.when(F.col("b").isNull(), F.col("a"))).alias("seeds"))
    wanted = scratch.table(wanted, "wanted")
    scratch.drop(*matches._parts)
    scratch.free()
    segments = scratch.table(rows.join(wanted.hint("merge"), "doc_id").mapInArrow(_segments(min_words), "doc_id long, a long, b long, w binary"), "segments")
    scratch.drop(wanted)
    scratch.free()
    windows = segments.where("a < 0")
    hashed = lambda part: part.mapInArrow(_windows, "h long, doc_id long, pos int")
    same = _linked(hashed(windows), hashed(_hundredth(windows)), scratch, full=False)
    equal = same.where("doc_id > src").repartition("doc_id").sortWithinPartitions("doc_id", "src", "pos", "src_pos").mapInArrow(_equal(min_words), _PASSAGE)
    equal = scratch.table(equal, "equal")
    scratch.drop(*same._parts)
    scratch.free()
    ranges = segments.where("a >= 0")
    found = scratch.table(_passages(chains.where("again = 0"), ranges, min_words, identity), "found")
    covered = found.union(equal)
    open_ = _outside(chains.where("again = 1"), covered, "doc_id = d AND x0 >= a AND x1 <= b")
    further = scratch.table(_passages(open_, ranges, min_words, identity), "further")
    # Less the equal passages that lie within one of the others.
    lone = _outside(equal, found, "doc_id = d AND source_doc_id = s AND start_word >= a AND end_word <= b")
    out = scratch.table(found.union(further).union(lone), "passages")
    scratch.drop(chains, segments, found, further, equal)
    return names.back(names.back(out, "source_doc_id"), "doc_id", "text_key")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (word numbers) and what stands between them."""
    words = Words([text], lower=False)
    raw = words.buffer[1:-1].tobytes()
    out, at = [], 0
    for a, b in sorted(spans):
        b = min(b, len(words))
        if a >= b:
            continue
        lo, hi = int(words.starts[a]) - 1, int(words.ends[b - 1]) - 1
        if hi > at:
            out.append(raw[at : max(at, lo)])
            at = hi
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        texts = [t if not s or t is None else cut(t, [(x["a"], x["b"]) for x in s]) for t, s in zip(batch["text"].to_pylist(), batch["_lodestone_spans"].to_pylist())]
        left = [not s or len(Words([t])) > 0 for t, s in zip(texts, batch["_lodestone_spans"].to_pylist())]
        columns = [pa.array(texts, pa.string()) if c == "text" else batch[c] for c in batch.schema.names if c != "_lodestone_spans"]
        yield pa.RecordBatch.from_arrays(columns, names=[c for c in batch.schema.names if c != "_lodestone_spans"]).filter(pa.array(left))


def remove_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents without the words of their repeated passages; a document with no other word goes, n_chars follows the text.

    Passages are cut from the text that they were found in, not from others of the same id.
    """
    spans = found.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"))).alias("_lodestone_spans"))
    touched = matching(docs, spans, "left", ("_lodestone_spans",))
    out = touched.mapInArrow(_removed, T.StructType([f for f in touched.schema.fields if f.name != "_lodestone_spans"]))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
