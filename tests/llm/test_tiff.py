import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from common import documents
from lodestone.llm import tiff


@given(st.binary(max_size=3000))
@settings(max_examples=100, deadline=None)
def test_codecs_round_trip(data):
    data = data * 3
    for name in ("packbits", "lzw", "deflate", "none"):
        assert tiff.DECODE[name](tiff.ENCODE[name](data)) == data


def test_lzw_over_table_resets():
    rng = np.random.default_rng(0)
    for high in (2, 30, 256):
        data = rng.integers(0, high, 60_000).astype(np.uint8).tobytes()
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data
    # A known stream: 9-bit codes 256, 65, 258, 257.
    bits = "".join(f"{c:09b}" for c in (256, 65, 258, 257)).ljust(40, "0")
    assert tiff.lzw_decode(int(bits, 2).to_bytes(5, "big")) == b"AAA"
    assert tiff.lzw_encode(b"AAA") == int(bits, 2).to_bytes(5, "big")


@pytest.mark.parametrize("compression", ["none", "packbits", "lzw", "deflate"])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 256, (37, 50)).astype(np.uint8), rng.integers(0, 60000, (20, 33, 3)).astype(np.uint16), np.zeros((1, 1), np.uint8)]
    got = list(tiff.read_pages(tiff.encode(pages, compression, predictor, tile, rows=8, order=order)))
    assert [p.layout for p in got] == ["tiles" if tile else "strips"] * 3
    for want, page in zip(pages, got):
        assert (page.pixels.reshape(want.shape) == want).all() and page.compression == compression


def test_damaged_files(spark):
    good = tiff.encode([np.ones((4, 4), np.uint8)] * 2)
    loop = bytearray(good)
    loop[-4:] = loop[4:8]
    rows = [(1, good), (2, good[:-20]), (3, b"nothing"), (4, None), (5, bytes(loop)), (6, good[:40] + b"\xff" * 20 + good[60:])]
    out = {}
    for r in tiff.explode_pages(spark.createDataFrame(rows, "doc_id long, media binary")).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert [r.page for r in out[1]] == [0, 1] and bytes(out[1][0].pixels) == b"\1" * 16
    assert all(out[i][-1].error for i in (2, 3, 4, 5))
    assert tiff.explode_pages(spark.createDataFrame([], "doc_id long, media binary")).count() == 0


def patched(data, tag, value):
    """The file with another value of a field of its first directory."""
    at = struct.unpack_from("<I", data, 4)[0]
    out = bytearray(data)
    for i in range(struct.unpack_from("<H", data, at)[0]):
        where = at + 2 + 12 * i
        if struct.unpack_from("<H", data, where)[0] == tag:
            kind = struct.unpack_from("<H", data, where + 2)[0]
            struct.pack_into("<I" if kind == 4 else "<H", out, where + 8, value if kind == 4 else value % 65536)
    return bytes(out)


@pytest.mark.parametrize("tag", [tiff.IMAGE_WIDTH, tiff.IMAGE_LENGTH, tiff.TILE_WIDTH, tiff.TILE_LENGTH, tiff.SAMPLES, tiff.BITS, tiff.ROWS_PER_STRIP, tiff.PREDICTOR, tiff.COMPRESSION])
@pytest.mark.parametrize("value", [0, 2**31 - 1, 2**32 - 1])
def test_sizes_that_cannot_be(tag, value):
    for tile in (None, (16, 16)):
        media = patched(tiff.encode([np.ones((20, 20), np.uint8)], tile=tile), tag, value)
        try:
            list(tiff.read_pages(media))
        except ValueError:
            continue


@given(st.data())
@settings(max_examples=400, deadline=None)
def test_only_value_errors_leave_a_damaged_file(data):
    compression = data.draw(st.sampled_from(["none", "packbits", "lzw", "deflate"]))
    good = bytearray(tiff.encode([np.arange(400, dtype=np.uint16).reshape(20, 20), np.ones((9, 9, 3), np.uint8)], compression, tile=data.draw(st.sampled_from([None, (16, 16)])), order=data.draw(st.sampled_from("<>"))))
    for _ in range(data.draw(st.integers(1, 6))):
        good[data.draw(st.integers(4, len(good) - 1))] = data.draw(st.integers(0, 255))
    try:
        list(tiff.read_pages(bytes(good[: data.draw(st.integers(8, len(good)))])))
    except ValueError:
        pass


def test_a_bomb_is_refused_and_the_job_goes_on(spark):
    bomb = patched(patched(tiff.encode([np.zeros((4096, 192), np.uint8)]), tiff.IMAGE_WIDTH, 2**31 - 1), tiff.IMAGE_LENGTH, 2**31 - 1)
    zero = patched(tiff.encode([np.zeros((20, 20), np.uint8)], tile=(16, 16)), tiff.TILE_WIDTH, 0)
    media = spark.createDataFrame([(1, bomb), (2, zero), (None, tiff.encode([np.ones((2, 2), np.uint8)]))], "doc_id long, media binary").withColumn("page", F.lit("clash")).withColumn("error", F.lit(1))
    rows = {r.doc_id: r for r in tiff.explode_pages(media).collect()}
    assert rows[1].error and rows[2].error and rows[None].error is None and rows[None].rows == 2
    docs = documents(spark, ["a", "b"]).withColumns({c: F.lit("clash") for c in ("n_bytes", "media", "feature")})
    assert tiff.digests(tiff.documents_media(docs)).count() == 2


def test_texts(spark):
    texts = ["", None, "a" * 192, "é" * 5000, "word " * 400_000, "word", "word"]
    rows = {i: r for i, r in enumerate(sorted(tiff.digests(tiff.documents_media(documents(spark, texts, [0, 1, 2, 3, 4, 5, None]))).collect(), key=lambda r: 9 if r.doc_id is None else r.doc_id))}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = tiff.text_media(raw)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert rows[5][1:] == rows[6][1:]
    assert "pages=3" in rows[4].feature
    assert tiff.digests(tiff.documents_media(documents(spark, []))).count() == 0
