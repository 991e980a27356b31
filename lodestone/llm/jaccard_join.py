"""N-gram Jaccard join by the chosen-path method.

Every document is the set of its five-word shingles.  A run walks down a random tree: at
each node a set follows the shingles whose hash, seeded by the node, falls below
``SPREAD / (threshold * size)``, so a pair at the threshold keeps SPREAD common children in
expectation while unlike pairs part.  With SPREAD above 1 the chance to keep a common path
has a floor that no depth goes below, so the number of runs does not depend on how deep nodes lie.

A node of at most NODE sets is compared by brute force over 64-byte sketches.  A larger one is
compared with one of its sets, the pivot: what is near the pivot is one neighbourhood already,
so only pairs with a set far from it are left.  If few sets are far, they are compared with
all, block by block; else the node is split by paths that go some levels on (STEPS: a round costs
much the same however many levels it goes), and what is still large after the last round is compared
whole, in blocks.  Nothing is left out at any size.

Runs repeat until the chance of missing a pair at the threshold is below ``1 - recall``.
Pairs found this way only form neighbourhoods (connected sets); within each, all pairs are
then measured exactly from whole shingle sets, block against block, so no pair is ever a row.

Copies (equal shingle sets) collapse to one representative before anything is compared.

Defined results: null and word-less texts are the empty set, equal to each other and to
nothing else; a text of one to four words is one shingle of all its words; every row is a
document and gives a row, with its id (null: null).  class_id and copy_of are ids too; a text
whose id is null, or taken by another text of the same id, is named there by a number above all ids
(kit.Identity).  No rows give no rows.  Extra columns are ignored by jaccard_join() and kept by keep_one().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.kit import ROW, Identity, Scratch, Words, components, lists, mix, pieces, runs, shingles

BINS = 64
#: Sets that are compared in one go.
NODE = 1024
#: Sets, and shingles, that one block of the exact comparison may hold.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 800_000
#: Common children that a pair at the threshold keeps in expectation, and levels of paths that each further round goes on.
SPREAD, STEPS = 1.5, (2, 3)

_SETS = "doc_id long, sig1 long, sig2 long, n int, sketch binary, nodes array<long>"


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold is missed with a chance below 1 - recall, at any depth.

    A common node keeps a Poisson number of common children with mean SPREAD at least (a subset of
    ``threshold`` times the size), so one run misses at most with the chance that such a branching
    process ever dies out.  Half of what may be missed is left to the sketches.
    """
    miss = 0.0
    for _ in range(1000):
        miss = math.exp(SPREAD * (miss - 1))
    return math.ceil(math.log((1 - recall) / 2) / math.log(miss))


def _unique(values: np.ndarray, owner: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and how many."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[keep], o[keep]
    return v, np.bincount(o, minlength=n_docs)


def _sets(threshold: float, n_runs: int, k: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield describe(batch, threshold, n_runs, k)

    return build


def describe(batch: pa.RecordBatch, threshold: float, n_runs: int, k: int) -> pa.RecordBatch:
    m = batch.num_rows
    values, owner = shingles(Words(batch["text"].to_pylist()), k)
    v, size = _unique(values, owner, m)
    owner = np.repeat(np.arange(m), size)
    with np.errstate(over="ignore"):
        sig1, sig2 = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        np.add.at(sig1, owner, mix(v))
        np.add.at(sig2, owner, mix(v + np.uint64(0x51ED270B)))
        # One permutation, BINS bins: the least hash of each bin, kept as a byte (0: no shingle).
        h = mix(v ^ np.uint64(0xA0761D6478BD642F))
        least = np.full((m, BINS), np.iinfo(np.uint64).max, np.uint64)
        slot = owner * BINS + (h >> np.uint64(58)).astype(np.int64)
        np.minimum.at(least.reshape(-1), slot, h)
        sketch = np.where(least == np.iinfo(np.uint64).max, 0, 1 + ((least >> np.uint64(20)) % np.uint64(255))).astype(np.uint8)
        bar = _bar(size, threshold)
        which, nodes = [], []
        for r in range(n_runs):
            at, node = _children(v, mix(np.array([r + 1], np.uint64)), bar[owner])
            which.append(owner[at])
            nodes.append(node)
    doc, node = np.concatenate(which), np.concatenate(nodes)
    node = node[np.argsort(doc, kind="stable")]
    signed = lambda x: x.view(np.int64)
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"], pa.array(signed(sig1)), pa.array(signed(sig2)), pa.array(size.astype(np.int32)), pa.array([x.tobytes() for x in sketch], pa.binary()), lists(signed(node), np.bincount(doc, minlength=m), pa.int64())],
        names=["doc_id", "sig1", "sig2", "n", "sketch", "nodes"],
    )


def _bar(size: np.ndarray, threshold: float) -> np.ndarray:
    """The hash below which a shingle of a set of this size is followed."""
    return np.minimum(SPREAD * 2.0**64 / (threshold * np.maximum(size, 1)), 2.0**64 - 2**12).astype(np.uint64)


def _children(shingle: np.ndarray, node: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles are followed from a node, and the children they lead to."""
    passed = np.flatnonzero(mix(shingle ^ node) <= bar)
    return passed, mix(node * np.uint64(0x2545F4914F6CDD1D) + shingle[passed])


def _below(threshold: float, levels: int):
    """What some nodes of each set lead to, so many levels on."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text="shingles"):
            nodes, owner = [], []
            for i, (x, at) in enumerate(zip(batch["shingles"].to_pylist(), batch["nodes"])):
                v = np.frombuffer(x, np.uint64)
                bar = _bar(np.array([len(v)]), threshold)
                found = np.asarray(at.values).view(np.uint64)
                with np.errstate(over="ignore"):
                    for _ in range(levels):
                        found = np.concatenate([np.zeros(0, np.uint64), *(_children(v, node[None], bar)[1] for node in found)])
                nodes.append(found)
                owner += [i] * len(found)
            picked = pa.array(owner, pa.int64())
            flat = np.concatenate(nodes) if nodes else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), *(batch[c].take(picked) for c in ("doc_id", "n", "sketch"))], names=["node", "doc_id", "n", "sketch"])

    return build


def _alike(a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may be similar: sizes allow it and the sketches' share of equal bins is within five deviations (of 64 bins at 0.8, a chance below 1e-5 to refuse)."""
    either = (a != 0) | (b != 0)
    equal = ((a == b) & either).sum(-1, dtype=np.int32)
    bins = np.maximum(either.sum(-1, dtype=np.int32), 1)
    least = threshold - 5 * np.sqrt(threshold * (1 - threshold) / bins)
    return (np.minimum(an, bn) >= threshold * np.maximum(an, bn)) & (equal >= least * bins)


def _near(a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray, threshold: float) -> np.ndarray:
    """The matrix of _alike() of all rows of a and b."""
    return _alike(a[:, None, :], an[:, None], b[None, :, :], bn[None, :], threshold)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _forest_edges(ids: np.ndarray, near) -> list[tuple[int, int]]:
    """A spanning forest of the near pairs; near(i) yields, for a block of rows, the matrix against all from i on."""
    forest, edges = _Forest(len(ids)), []
    step = max(1, 65_536 // len(ids))
    for i in range(0, len(ids), step):
        for x, y in zip(*np.nonzero(near(i, min(len(ids), i + step)))):
            p, q = i + int(x), i + int(y)
            if p < q and forest.join(p, q):
                edges.append((int(ids[p]), int(ids[q])))
    return edges


def _buckets(threshold: float):
    """Spanning forests of the near pairs in each node's bucket (runs of equal ``node``)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for table in runs(batches, ["node", "part"]):
            if table.num_rows > 1:
                ids, n, side = np.asarray(table["doc_id"]), np.asarray(table["n"]), np.asarray(table["side"])
                s = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
                if side.any():
                    found += _cross(ids, n, s, side, threshold)
                else:
                    found += _forest_edges(ids, lambda i, j: _near(s[i:j], n[i:j], s[i:], n[i:], threshold))
            if len(found) > 10_000:
                yield _edges(found)
                found = []
        yield _edges(found)

    return build


def _beside(threshold: float):
    """Which sets of a large node are near its pivot."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sketch", "pivot_sketch"))
            an, bn = np.asarray(batch["n"]), np.asarray(batch["pivot_n"])
            near = _alike(a, an, b, bn, threshold)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("node", "doc_id", "n", "sketch", "pivot")), pa.array(near)], names=["node", "doc_id", "n", "sketch", "pivot", "near"])

    return build


def _cross(ids, n, s, side, threshold) -> list[tuple[int, int]]:
    """Forest between the rows of side 1 and those of side 2."""
    left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    forest, edges = _Forest(len(ids)), []
    step = max(1, 65_536 // max(1, len(right)))
    for i in range(0, len(left), step):
        a = left[i : i + step]
        for x, y in zip(*np.nonzero(_near(s[a], n[a], s[right], n[right], threshold))) if len(right) else ():
            p, q = int(a[x]), int(right[y])
            if forest.join(p, q):
                edges.append((int(ids[p]), int(ids[q])))
    return edges


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])


def _whole_sets(k: int, keep: list[str]):
    """The whole shingle set of each text, with the columns ``keep``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            v, size = _unique(*shingles(Words(batch["text"].to_pylist()), k), batch.num_rows)
            ends = np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(size.astype(np.int32)), pa.array([v[e - c : e].tobytes() for e, c in zip(ends, size)], pa.binary())], names=[*keep, "n", "shingles"])

    return build


def _similar(sets: list[bytes], n: np.ndarray, threshold: float) -> np.ndarray:
    """Exact: which of all pairs of these sets reach the threshold."""
    m = len(sets)
    flat = np.frombuffer(b"".join(sets), np.uint64)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(flat, kind="stable")
    v, o = flat[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1  # a shingle of one set only adds to no intersection
    o, number = o[shared], number[shared]
    if len(number):
        number = np.cumsum(np.concatenate([[0], (number[1:] != number[:-1]).astype(np.int64)]))
    common = np.zeros((m, m), np.float32)
    width = 1024
    for base in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        a, b = np.searchsorted(number, [base, base + width])
        dense = np.zeros((m, width), np.float32)
        dense[o[a:b], number[a:b] - base] = 1
        common += dense @ dense.T
    return common >= threshold * (n[:, None] + n[None, :] - common) - 1e-4


def _exact(threshold: float):
    """For each (component, block pair): the weight of each set's links, and a forest of the links."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["component", "pair"]):
            ids, n, copies, block = (np.asarray(table[c]) for c in ("doc_id", "n", "copies", "block"))
            ok = _similar(table["shingles"].to_pylist(), n.astype(np.int64), threshold)
            np.fill_diagonal(ok, False)
            if block.min() != block.max():  # two blocks: only pairs across
                ok &= block[:, None] != block[None, :]
            weight = ok @ copies
            forest = _Forest(len(ids))
            edges = [(int(ids[x]), int(ids[y])) for x, y in zip(*np.nonzero(np.triu(ok))) if forest.join(int(x), int(y))] if len(ids) < 64 else _big_forest(ids, ok, forest)
            a = np.array(edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids, a[:, 0]])), pa.array(np.concatenate([weight, np.zeros(len(a), np.int64)]).astype(np.int64)), pa.array(np.concatenate([ids, a[:, 1]]))],
                names=["doc_id", "links", "other"],
            )

    return build


def _big_forest(ids: np.ndarray, ok: np.ndarray, forest: _Forest) -> list[tuple[int, int]]:
    """Breadth-first: each set is reached once, so a clique costs its rows and not its pairs."""
    left, edges = np.ones(len(ids), bool), []
    for root in range(len(ids)):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            x = todo.pop()
            reach = np.flatnonzero(ok[x] & left)
            left[reach] = False
            edges += [(int(ids[x]), int(ids[y])) for y in reach]
            todo += reach.tolist()
    return edges


def _dealt(rows: DataFrame, blocks, split) -> DataFrame:
    """Rows of (node, doc_id, n, sketch) in blocks by hash; a part is a pair of blocks, or one with itself."""
    mine = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    each = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") == lo, 1).otherwise(2)
    return each.select("node", (split + lo.cast("long") * 1_000_000 + hi).alias("part"), "doc_id", "n", "sketch", side.alias("side"))


def _neighbourhoods(reps: DataFrame, texts: DataFrame, threshold: float, k: int, scratch: Scratch) -> list[DataFrame]:
    """Edges (a, b) whose connected sets hold every similar pair, in written tables."""

    whole = lambda rows: rows.select("node", F.lit(0).cast("long").alias("part"), "doc_id", "n", "sketch", F.lit(0).alias("side"))
    entries, edges, hot = reps.select(F.explode("nodes").alias("node"), "doc_id", "n", "sketch"), [], None
    for step in (*STEPS, 0):
        sizes = entries.groupBy("node").count().where("count > 1")
        held = scratch.table(entries.join(sizes, "node"), "entries")
        parts, large = whole(held.where(F.col("count") <= NODE)), held.where(F.col("count") > NODE)
        done, many = [held], None
        pivot = F.min(F.struct(F.xxhash64("doc_id", "node").alias("h"), F.col("doc_id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("sketch").alias("pivot_sketch")))
        pivots = scratch.table(large.groupBy("node").agg(pivot.alias("p")).select("node", "p.pivot", "p.pivot_n", "p.pivot_sketch"), "pivots")
        if not pivots.isEmpty():
            beside = scratch.table(large.join(pivots, "node").mapInArrow(_beside(threshold), "node long, doc_id long, n int, sketch binary, pivot long, near boolean"), "beside")
            edges.append(scratch.table(beside.where("near and doc_id != pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")), "edges"))
            sides = beside.groupBy("node").agg(F.count_if("near").alias("close"), F.count_if(~F.col("near")).alias("far"))
            sides = scratch.table(sides.where("far > 0"), "sides")  # with none far, all is one neighbourhood
            few = beside.join(sides.where(F.col("far") <= NODE), "node")
            blocks = F.ceil(F.col("close") / NODE).cast("int")
            far = few.where(~F.col("near"))
            across = far.withColumn("part", F.explode(F.sequence(F.lit(1), blocks))).select("node", F.col("part").cast("long"), "doc_id", "n", "sketch", F.lit(1).alias("side"))
            close = few.where("near").select("node", (1 + F.pmod(F.xxhash64("doc_id"), blocks)).cast("long").alias("part"), "doc_id", "n", "sketch", F.lit(2).alias("side"))
            parts = parts.union(whole(far)).union(across).union(close)
            done += [beside, sides, pivots]
            many = sides.where(F.col("far") > NODE)
            if many.isEmpty():
                many = None
            elif not step:
                rest = beside.join(many, "node")
                parts = parts.union(_dealt(rest, F.ceil((F.col("close") + F.col("far")) / NODE).cast("int"), F.lit(1)))
        # An edge that several nodes find is told apart once, in components().
        edges.append(scratch.table(parts.repartition("node", "part").sortWithinPartitions("node", "part", "doc_id").mapInArrow(_buckets(threshold), "a long, b long"), "edges"))
        if many is None or not step:
            scratch.drop(*done)
            break
        split = beside.join(many.select("node"), "node", "left_semi")
        if hot is None:
            wanted = reps.select("doc_id", "sketch").join(split.select("doc_id").hint("merge"), "doc_id", "left_semi")
            read = texts.join(wanted.hint("merge"), "doc_id")
            hot = scratch.table(read.mapInArrow(_whole_sets(k, ["doc_id", "sketch"]), "doc_id long, sketch binary, n int, shingles binary"), "hot")
        down = split.groupBy("doc_id").agg(F.collect_list("node").alias("nodes"))  # nodes of one set
        entries = scratch.table(hot.join(down.hint("merge"), "doc_id").mapInArrow(_below(threshold, step), "node long, doc_id long, n int, sketch binary"), "children")
        scratch.drop(*done)
        scratch.free()
    if hot is not None:
        scratch.drop(hot)
    return edges


def _joined(docs: DataFrame, identity: Identity, scratch: Scratch, threshold: float, k: int, recall: float) -> DataFrame:
    """jaccard_join() with numbers in place of ids."""
    sets = scratch.table(identity.texts(docs, once=False).mapInArrow(_sets(threshold, runs_for(recall, threshold), k), _SETS), "sets")
    sig = ["sig1", "sig2", "n"]
    one = sets.select("doc_id", *sig)
    classes = scratch.table(one.groupBy(*sig).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = sets.join(classes.select(F.col("rep").alias("doc_id"), *sig), ["doc_id", *sig], "left_semi").where("n > 0")
    reps = scratch.table(reps.dropDuplicates(["doc_id"]) if identity.repeats else reps, "reps")
    edges = _neighbourhoods(reps, identity.texts(docs), threshold, k, scratch)
    every = edges[0]
    for more in edges[1:]:
        every = every.union(more)
    scratch.free()
    near = scratch.table(components(every, scratch), "near")
    scratch.drop(*edges)
    # Exact similarity within each neighbourhood.
    member = near.select(F.col("node").alias("doc_id"), F.col("root").alias("component")).join(reps.select("doc_id", *sig), "doc_id").join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *sig])
    total = member.groupBy("component").agg(F.sum(F.col("n").cast("long")).alias("s"), F.count("*").alias("m"))
    member = scratch.table(member.join(total, "component").select("doc_id", "component", "copies", F.greatest(F.ceil(F.col("s") / BLOCK_SHINGLES), F.ceil(F.col("m") / BLOCK_SETS)).cast("int").alias("blocks")), "member")
    scratch.drop(reps, near)
    # Sort-merge at every size: what would be broadcast grows with the corpus.
    whole = identity.texts(docs).join(member.hint("merge"), "doc_id").mapInArrow(_whole_sets(k, ["doc_id", "component", "copies", "blocks"]), "doc_id long, component long, copies long, blocks int, n int, shingles binary")
    whole = whole.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    whole = whole.withColumn("pair", F.least("block", "other") * F.lit(1_000_000).cast("long") + F.greatest("block", "other"))
    verified = whole.repartition("component", "pair").sortWithinPartitions("component", "pair", "doc_id").mapInArrow(_exact(threshold), "doc_id long, links long, other long")
    verified = scratch.table(verified, "verified")
    weights = verified.where("doc_id = other").groupBy("doc_id").agg(F.sum("links").alias("links"))
    exact = components(verified.where("doc_id != other").select(F.col("doc_id").alias("a"), F.col("other").alias("b")), scratch)
    per_class = (
        classes.join(weights.withColumnRenamed("doc_id", "rep"), "rep", "left").join(exact.withColumnRenamed("node", "rep"), "rep", "left")
        .select(*sig, F.col("rep").alias("copy_of"), F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    out = scratch.table(one.join(per_class, sig).select("doc_id", "copy_of", "class_id", F.col("n_links").cast("long")), "result")
    scratch.drop(sets, classes, member, verified)
    return out


def jaccard_join(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9999) -> DataFrame:
    """(doc_id, copy_of, class_id, n_links) for every row.

    copy_of: least id with the same shingle set.  class_id: least id that is reachable over
    links (similarity of at least ``threshold``).  n_links: other rows that are copies
    or linked, each counted.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    identity = Identity(docs, scratch)
    return identity.back(_joined(docs, identity, scratch, threshold, k, recall), "doc_id")


def keep_one(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.9999) -> DataFrame:
    """The first document of each class, with all columns: the one of least id, those without an id last.

    Texts that share an id, or have none, are documents of their own; of rows equal in id and text one stays,
    the first in the order of their other columns.  All word-less texts are one class.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    identity = Identity(docs, scratch)
    first = _joined(docs, identity, scratch, threshold, k, recall).where("doc_id = class_id").select(F.col("doc_id").alias(ROW)).distinct()
    kept = identity.mark(docs).join(first.hint("merge"), ROW, "left_semi")
    if identity.repeats:
        order = Window.partitionBy(ROW).orderBy(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))))
        kept = kept.withColumn("_lodestone_n", F.row_number().over(order)).where("_lodestone_n = 1")
    return kept.select(*(f"`{c}`" for c in docs.columns))
