import glob
import os
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from common import documents
from lodestone.llm import packing, token_files
from lodestone.llm.tokens import Encoder, split

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\x0b\x1c 'sΣİ<|>!1ÀéÞ×÷ßA")), max_size=60), max_size=4))
def test_encoder_equals_the_library(texts):
    want = [x.ids + [1] for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)] if texts else []
    ids, counts = ENCODER.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])][: len(texts)] == want


def test_encoder_over_the_tables(spark, plain):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    ids, counts = Encoder(PATH).encode(pa.array([*texts, "it's <|endoftext|> 12 Ñandú", None]))
    want = [plain.encode(t, add_special_tokens=False).ids + [1] for t in [*texts, "it's <|endoftext|> 12 Ñandú", ""]]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


ENCODER = Encoder(PATH)


def test_runs_that_share_a_hash(plain, monkeypatch):
    """With a first hash of five values, the second one still tells all runs apart."""
    encoder = Encoder(PATH)
    find, text = encoder._find, " ".join(f"word{i} number" for i in range(300))
    n = len(split(np.frombuffer(b"\n" + text.encode() + b"\n", np.uint8))[1])
    monkeypatch.setattr(encoder, "_find", lambda h, *rest: find(h % np.uint64(5) if len(h) == n else h, *rest))
    ids, _ = encoder.encode(pa.array([text]))
    assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids + [1]


def test_a_tokenizer_of_another_kind_gets_whole_texts():
    texts, tried = ["It's 1234 words, Über-alles!", "", None, "日本 mixed  spaces\n\n"], 0
    for path in glob.glob(f"{os.path.dirname(PATH)}/*.json"):
        try:
            library = Tokenizer.from_file(path)
        except Exception:  # noqa: BLE001  other kinds of files lie there too
            continue
        ids, counts = Encoder(path).encode(pa.array(texts))
        want = [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
        tried += 1
    assert tried


def test_files_by_bytes(spark, monkeypatch):
    docs = documents(spark, ["word " * 400] * 50)
    assert token_files.files_for(docs) == 1 and token_files.files_for(documents(spark, [])) == 1
    monkeypatch.setattr(token_files, "FILE_BYTES", 10_000)
    assert token_files.files_for(docs) == 10
    rows = token_files.token_output(docs, PATH).collect()
    assert len({r.file for r in rows}) > 5 and sorted(r.start for r in rows) == [i * rows[0].n_tokens for i in range(50)]


@given(st.integers(1, 32), st.integers(0, 300), st.randoms())
@settings(max_examples=60, deadline=None)
def test_bit_packing_round_trip(bits, n, rng):
    ids = np.array([rng.randrange(2**bits) for _ in range(n)], np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-n // 64) * bits * 8
    a = rng.randrange(n + 1)
    assert token_files.unpack(data, bits, a, n - a).tolist() == ids[a:].tolist()


TEXTS = ["One two three.", None, "", "x " * 9000, "It's <|endoftext|> here", "One two three."]


def test_token_files(spark, plain):
    docs = documents(spark, TEXTS, [5, 1, None, 7, 3, 5]).withColumn("start", docs_column())
    got = token_files.token_output(docs, PATH).collect()
    want, start = [], 0
    for i, t in sorted(zip([5, 1, None, 7, 3, 5], TEXTS), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r[:4] for r in got), key=lambda r: r[1]) == want


def docs_column():
    from pyspark.sql import functions as F

    return F.lit("clashing name")


def test_pack_odd_rows(spark, plain):
    docs = documents(spark, ["a b", "c d e", "c d e", None], [None, 7, 7, 7]).withColumns({c: docs_column() for c in ("piece", "length", "part", "rank", "base")})
    rows = packing.pack(docs, PATH).collect()
    want = sorted((str(i), len(plain.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in zip([None, 7, 7, 7], ["a b", "c d e", "c d e", None]))
    assert sorted((str(r.doc_id), r.length) for r in rows) == want


def test_no_rows(spark):
    docs = documents(spark, [])
    assert token_files.token_output(docs, PATH).count() == 0
    assert packing.pack(docs, PATH).count() == 0


def test_random_access(tmp_path):
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 5000, 80)
    ids = rng.integers(0, 49408, counts.sum()).astype(np.uint32)
    writer = token_files.Writer(f"file://{tmp_path}/t", 16)
    writer.add(np.arange(80), counts, ids)
    writer.close()
    reader = token_files.Reader(f"file://{tmp_path}/t")
    assert reader.ids(65_000, 70_000).tolist() == ids[65_000:135_000].tolist()
    assert np.concatenate([x for _, _, x in reader.documents(9000)]).tolist() == ids.tolist()


def brute_best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, b in enumerate(bins) if b >= x]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= x
        else:
            bins.append(capacity - x)
    return sorted(bins)


@given(st.integers(1, 60), st.data())
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(capacity, data):
    lengths = data.draw(st.lists(st.integers(1, capacity), max_size=120))
    histogram = {x: lengths.count(x) for x in set(lengths)}
    plan, made = packing.plan_packing(histogram, capacity)
    fill = np.zeros(made, np.int64)
    taken = set()
    for length, rank, first, per, offset in plan.tolist():
        after = min([p[1] for p in plan.tolist() if p[0] == length and p[1] > rank], default=histogram[length])
        for i in range(after - rank):
            b, k = divmod(i, per)
            for t in range(offset + k * length, offset + (k + 1) * length):
                assert (first + b, t) not in taken and t < capacity
                taken.add((first + b, t))
            fill[first + b] += length
    assert sorted((capacity - fill).tolist()) == brute_best_fit(lengths, capacity)


def test_pack(spark, plain):
    texts = [*TEXTS, *("word " * n for n in range(0, 300, 7))]
    rows = packing.pack(documents(spark, texts), PATH, keep_ids=True).collect()
    want = {(i, p): ids[p * 4096 : p * 4096 + 4096] for i, t in enumerate(texts) for ids in [plain.encode(t or "", add_special_tokens=False).ids + [1]] for p in range(-(-len(ids) // 4096))}
    assert {(r.doc_id, r.piece): np.frombuffer(r.ids, "<u4").tolist() for r in rows} == want
    assert all(r.start == r.piece * 4096 and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and r.length * 4 == len(r.ids) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == len(brute_best_fit([len(v) for v in want.values()], 4096))
    made = packing.sequences(packing.pack(documents(spark, texts), PATH, keep_ids=True)).collect()
    assert sum(r.length for r in made) == sum(map(len, want.values())) and all(len(r.ids) == 4 * r.length for r in made)
