"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into segments of SEGMENT words; a passage is as many neighbouring segments
as surely contain a benchmark item of its length.  The terms are the words of the benchmark.
Segments are weighted by tf-idf, and a randomised SVD gives the latent space: a Gaussian matrix of
rank + OVERSAMPLE columns goes through A'A (each task adds its share, the shares are summed in
Spark), a QR of the sum spans the range, a second pass sums the range's Gram matrix Q'A'AQ, and
its eigenvectors give the singular values and the ``rank`` leading right singular vectors.
A passage near an item there (cosine) is a candidate; the word bags, the longest common subsequence
of the words and the item's answer then decide.  All documents take part in the statistics, in the
SVD and in the search, and all items in one space.

What is sent to tasks is terms x rank numbers and the items, block by block (BLOCK_WORDS words of them);
a block is a pass over the postings, never over the documents, and changes no result.

Defined results: null, empty and short texts are compared as they are; texts that share an id, or have
none, are documents of their own (told apart by text_key, which is null where the id has no other text);
rows equal in id and text are one document; its best match of an item_id (most words in order, then first place) is returned once; null or
word-less items match nothing; an empty benchmark or no documents give no rows; extra columns are
ignored by matches() and kept by remove_leaks().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.kit import Identity, Scratch, Words, matching, pieces

SEGMENT = 16
RANK, OVERSAMPLE = 128, 16
#: Terms in more than this share of the segments carry no weight.
MAX_DF = 0.01
#: Rarest terms of an item that carry weight however often they occur.
RAREST = 8
#: Words of the items that one pass over the postings looks for.
BLOCK_WORDS = 1_000_000
STRIP = 32  # rows of a matrix that are summed as one


class Items:
    """A block of benchmark items: their words as numbers of terms (sorted hashes), and where each answer begins."""

    def __init__(self, rows: list[tuple[int, str]], terms: np.ndarray):
        self.ids = [i for i, _ in rows]
        words = Words([t for _, t in rows])
        flat = np.searchsorted(terms, words.hashes)
        self.words = [flat[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        self.answers = [len(Words([t[: answer_start(t)]])) for _, t in rows]
        self.segments = np.array([-(-len(w) // SEGMENT) + 1 for w in self.words])
        self.lengths = np.array([len(w) for w in self.words])
        #: item * terms + term of every word of an item, sorted
        self.bags = np.unique(np.repeat(np.arange(len(rows)), self.lengths) * np.int64(max(1, len(terms))) + flat)


def answer_start(text: str) -> int:
    """Where the answer of an item begins: after its last question or 'answer:' mark, else its last sentence."""
    marks = [m.end() for m in re.finditer(r"\?|answer\s*:", text, re.I)]
    if marks and text[marks[-1] :].strip():
        return marks[-1]
    ends = [m.end() for m in re.finditer(r"[.!?]\s+", text.rstrip())]
    return ends[-1] if ends else 0


def _postings(terms: np.ndarray):
    """Per text: how many segments, and term, position of every benchmark word; and segment counts of terms (doc_id null)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros(len(terms), np.int64), 0
        for batch in pieces(batches):
            words = Words(batch["text"].to_pylist())
            h, counts = words.hashes, words.counts
            at = np.searchsorted(terms, h)
            at[at == len(terms)] = 0
            hit = np.flatnonzero(terms[at] == h) if len(terms) else np.zeros(0, np.int64)
            doc = words.doc[hit]
            pos = hit - words.first[doc]
            n = -(-counts // SEGMENT)
            base = np.cumsum(n) - n
            pairs = np.unique((base[doc] + pos // SEGMENT) * len(terms) + at[hit]) if len(hit) else hit
            df += np.bincount(pairs % len(terms), minlength=len(terms)) if len(hit) else 0
            seen += int(n.sum())
            ends = np.cumsum(np.bincount(doc, minlength=len(counts)))
            t32, p32 = at[hit].astype(np.int32), pos.astype(np.int32)
            cuts = list(zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n), pa.array([t32[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([p32[a:b].tobytes() for a, b in cuts], pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int64())],
                names=["doc_id", "segments", "terms", "positions", "term", "df"],
            )
        used = np.flatnonzero(df)
        k = len(used) + 1  # term -1: how many segments there are
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(df[used], seen))],
            names=["doc_id", "segments", "terms", "positions", "term", "df"],
        )

    return build


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, position, text, first segment of each text and the end) of a batch of postings."""
    term = np.frombuffer(b"".join(batch["terms"].to_pylist()), np.int32)
    pos = np.frombuffer(b"".join(batch["positions"].to_pylist()), np.int32)
    sizes = np.array([len(x) // 4 for x in batch["terms"].to_pylist()], np.int64)
    first = np.concatenate([[0], np.cumsum(np.asarray(batch["segments"]))]).astype(np.int64)
    return term, pos, np.repeat(np.arange(len(sizes)), sizes), first


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pieces([batch.slice(i, rows) for i in range(0, batch.num_rows, rows)], text="terms", limit=1 << 19)


def _project(term: np.ndarray, segment: np.ndarray, weight: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """Sum of weighted basis rows by segment (ascending); a few thousand rows at a time stay in cache."""
    out = np.zeros((n, basis.shape[1]), np.float32)
    for i in range(0, len(term), 4096):
        s = segment[i : i + 4096]
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        out[s[starts]] += np.add.reduceat(basis[term[i : i + 4096]] * weight[i : i + 4096, None], starts, axis=0)
    return out


def _weighted(term, segment, idf, n):
    """Terms with weight only, and tf-idf scaled to unit length by segment."""
    keep = idf[term] > 0
    term, segment = term[keep], segment[keep]
    w = idf[term]
    norm = np.sqrt(np.bincount(segment, w * w, n))
    norm[norm == 0] = 1
    return term, segment, (w / norm[segment]).astype(np.float32)


def _strips(total: np.ndarray, height: int) -> pa.RecordBatch:
    """A matrix as rows to sum: ``height`` of its rows each, those without a number left out."""
    padded = np.zeros((-(-len(total) // height) * height, total.shape[1]), np.float32)
    padded[: len(total)] = total
    flat = padded.reshape(-1, height * total.shape[1])
    used = np.flatnonzero(flat.any(1))
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([flat[i].tobytes() for i in used], pa.binary())], names=["strip", "part"])


def _share(idf: np.ndarray, width: int):
    """This task's share of A'A G."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gauss = np.random.default_rng(1).standard_normal((len(idf), width)).astype(np.float32)
        total = np.zeros((len(idf), width), np.float32)
        for batch in _slices(batches):
            term, pos, text, first = _unpack(batch)
            n = int(first[-1])
            term, segment, w = _weighted(term, first[text] + pos // SEGMENT, idf, n)
            y = _project(term, segment, w, gauss, n)
            order = np.argsort(term, kind="stable")
            for i in range(0, len(order), 4096):
                o = order[i : i + 4096]
                t = term[o]
                starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                total[t[starts]] += np.add.reduceat(y[segment[o]] * w[o, None], starts, axis=0)
        yield _strips(total, STRIP)

    return build


def _gram(idf: np.ndarray, q: np.ndarray):
    """This task's share of Q'A'AQ."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((q.shape[1], q.shape[1]), np.float64)
        for batch in _slices(batches):
            term, pos, text, first = _unpack(batch)
            n = int(first[-1])
            y = _project(*_weighted(term, first[text] + pos // SEGMENT, idf, n), q, n)
            total += y.T @ y
        yield _strips(total, 1)

    return build


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch["strip"].to_pylist(), batch["part"].to_pylist()):
            v = np.frombuffer(x, np.float32).astype(np.float64)
            held[i] = held[i] + v if i in held else v
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in held.values()], pa.binary())], names=["strip", "part"])


def _summed(postings: DataFrame, shares, rows: int, width: int, height: int) -> np.ndarray:
    """The sum of all tasks' shares, rows x width."""
    parts = postings.mapInArrow(shares, "strip int, part binary").repartition("strip").mapInArrow(_added, "strip int, part binary")
    total = np.zeros((-(-rows // height) * height, width))
    for r in parts.collect():  # rows x width numbers
        total[r["strip"] * height : (r["strip"] + 1) * height] += np.frombuffer(r["part"], np.float32).reshape(height, width)
    return total[:rows]


def latent_space(postings: DataFrame, idf: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors (terms x rank at most) and singular values of the tf-idf matrix."""
    width = min(rank + OVERSAMPLE, len(idf))
    q = np.linalg.qr(_summed(postings, _share(idf, width), len(idf), width, STRIP))[0].astype(np.float32)
    gram = _summed(postings, _gram(idf, q), width, width, 1)
    energy, turn = np.linalg.eigh((gram + gram.T) / 2)
    energy, turn = energy[::-1][:rank], turn[:, ::-1][:, :rank]
    good = energy > 1e-9 * max(1e-12, energy.max(initial=0))
    return np.ascontiguousarray(q @ turn[:, good], np.float32), np.sqrt(energy[good])


def common_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which places of b are in one longest common subsequence with a."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a)):
        row = table[i].copy()
        row[1:] = np.maximum(row[1:], table[i, :-1] + (b == a[i]))
        table[i + 1] = np.maximum.accumulate(row)
    used = np.zeros(len(b), bool)
    i, j = len(a), len(b)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            used[j] = True
    return used


def verify(item: np.ndarray, answer: int, window: np.ndarray, places: np.ndarray, least: float) -> tuple[float, float, int, int] | None:
    """(share of the item, share of its answer, first place, end) if the window holds the item, as it is or paraphrased.

    A share of ``least`` decides when half the answer is there too, a share of 0.8 alone.
    """
    used = common_subsequence(window, item)
    share = used.mean()
    if share < least:
        return None
    tail = used[answer:].mean() if answer < len(used) else share
    if share < 0.8 and tail < 0.5:
        return None
    at = places[common_subsequence(item, window)]
    return float(share), float(tail), int(at.min()), int(at.max()) + 1


_MATCH = "doc_id long, item_id long, cosine double, lcs double, answer double, start_word long, end_word long"


def _search(items: Items, idf: np.ndarray, basis: np.ndarray, cosine: float, least: float):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, lengths, bags = np.int64(len(idf)), items.lengths, items.bags
        wide = np.zeros((len(items.words), basis.shape[1]), np.float32)
        for i, w in enumerate(items.words):
            wide[i] = (basis[w] * idf[w, None]).sum(0) if len(w) else 0
        wide /= np.maximum(np.linalg.norm(wide, axis=1, keepdims=True), 1e-9)
        for batch in _slices(batches):
            term, pos, text, first = _unpack(batch)
            n = int(first[-1])
            segment = first[text] + pos // SEGMENT
            bounds = np.searchsorted(segment, np.arange(n + 1))
            t, s, w = _weighted(term, segment, idf, n)
            z = np.concatenate([np.zeros((1, basis.shape[1]), np.float32), np.cumsum(_project(t, s, idf[t].astype(np.float32), basis, n), axis=0, dtype=np.float64)])
            last = np.repeat(first[1:], np.diff(first))  # end of each segment's text
            ids = batch["doc_id"].to_pylist()
            best: dict[tuple[int, int], tuple] = {}
            for m in np.unique(items.segments[lengths > 0]):
                group = np.flatnonzero((items.segments == m) & (lengths > 0))
                stop = np.minimum(np.arange(n) + m, last)
                passage = (z[stop] - z[:-1]).astype(np.float32)
                passage /= np.maximum(np.linalg.norm(passage, axis=1, keepdims=True), 1e-9)
                near = passage @ wide[group].T
                at, which = np.nonzero(near >= cosine)
                # Word bags bound the common subsequence from above.
                for i in range(0, len(at), 20_000):
                    a, g = at[i : i + 20_000], group[which[i : i + 20_000]]
                    lo, hi = bounds[a], bounds[stop[a]]
                    size = hi - lo
                    flat = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
                    owner = np.repeat(np.arange(len(a)), size)
                    key = np.repeat(g, size) * k + term[flat]
                    at_bag = np.minimum(np.searchsorted(bags, key), len(bags) - 1)
                    held = np.bincount(owner, bags[at_bag] == key, len(a))
                    for j in np.flatnonzero(held >= least * lengths[g]).tolist():
                        item, p = int(g[j]), slice(int(lo[j]), int(hi[j]))
                        found = verify(items.words[item], items.answers[item], term[p], pos[p], least)
                        if found:
                            doc = int(np.searchsorted(first, a[j], side="right")) - 1
                            row = (found[0], found[1], -found[2], -found[3], float(near[a[j], which[i + j]]))
                            if best.get((doc, item), (0,)) < row:
                                best[doc, item] = row
            rows = [(ids[d], items.ids[i], round(c, 4), round(s, 6), round(t, 6), -a, -b) for (d, i), (s, t, a, b, c) in best.items()]
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(columns, kinds)], names=[c.split()[0] for c in _MATCH.split(", ")])

    return build


def weighty(blocks: list[Items], df: np.ndarray, most: float) -> np.ndarray:
    """Terms that carry weight: those in at most ``most`` segments, and in any case the RAREST of each item."""
    keep = df <= most
    for w in (w for items in blocks for w in items.words):
        own = np.unique(w)
        keep[own[np.argsort(df[own], kind="stable")[:RAREST]]] = True
    return keep


def blocks_of(benchmark: DataFrame) -> tuple[np.ndarray, list[Items]]:
    """The terms of a benchmark, and its items in blocks; the benchmark is a stated set that the driver holds."""
    rows = [(r[0], r[1]) for r in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator()]
    terms, ends, n = [np.zeros(0, np.uint64)], [], 0
    for i, (_, text) in enumerate(rows):
        words = Words([text])
        terms.append(np.unique(words.hashes))
        if n and n + len(words) > BLOCK_WORDS:
            ends.append(i)
            n = 0
        n += len(words)
    every = np.unique(np.concatenate(terms))
    cuts = [0, *ends, len(rows)]
    return every, [Items(rows[a:b], every) for a, b in zip(cuts, cuts[1:]) if a < b]


def matches(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, cosine: float = 0.45, least: float = 0.6, max_df: float = MAX_DF) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, start_word, end_word, text_key): every document with a benchmark item in it."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "benchmark")
    terms, blocks = blocks_of(benchmark)
    if not len(terms):
        return spark.createDataFrame([], _MATCH + ", text_key long")
    identity = Identity(docs, scratch)
    made = scratch.table(identity.texts(docs).mapInArrow(_postings(terms), "doc_id long, segments long, terms binary, positions binary, term int, df long"), "postings")
    postings = made.where("df is null").select("doc_id", "segments", "terms", "positions")
    counts = {r["term"]: r["df"] for r in made.where("df is not null").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a row for each benchmark word
    n = max(1, counts.pop(-1, 0))
    df = np.array([counts.get(i, 0) for i in range(len(terms))])
    # Inverse document frequency over the root of it: a term's column then has about unit
    # energy whatever its frequency, so rare terms, which tell items apart, span the space too.
    idf = np.where(weighty(blocks, df, max_df * n), np.log1p(n / (1 + df)) / np.sqrt(1 + df), 0.0)
    basis, _ = latent_space(postings, idf, min(rank, len(terms)))
    path = scratch.path("matches")
    for items in blocks:
        postings.mapInArrow(_search(items, idf, basis, cosine, least), _MATCH).write.mode("append").parquet(path)
    scratch.drop(made)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("lcs"), F.desc("answer"), "start_word", "end_word")
    found = spark.read.schema(_MATCH).parquet(path).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return identity.back(found, "doc_id", "text_key")


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all columns, that hold no benchmark item; of texts that share an id only those that hold one go."""
    return matching(docs, matches(docs, benchmark).select("doc_id", "text_key").distinct(), "left_anti")
