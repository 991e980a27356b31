"""TIFF as a media column: write payloads as grey pages, walk files page by page.

Reading follows the directory chain of either byte order, takes strips or tiles, undoes
PackBits, LZW or deflate and the horizontal predictor, and gives one row for each page:
8 or 16 bits a sample, one or more samples a pixel.  A file that is damaged, or not of these kinds, gives its
pages up to there and one row with the error and no pixels.  Sizes are checked before anything
is allocated: a page has at most MOST_BYTES of pixels, and no more than its data can unfold to.

For texts: the payload is the UTF-8 text and spaces up to a positive multiple of WIDTH; each
page is WIDTH samples wide and at most PAGE_ROWS long, deflated in strips after the
predictor.  Nothing in a file depends on anything but the text.

Defined results: a null text is empty; a null doc_id is returned as null; rows that repeat
give equal values; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.kit import BATCH, keyed, pieces, unkeyed

WIDTH, PAGE_ROWS, STRIP_ROWS = 192, 4096, 512
#: Bytes of pixels that a page may have, and that a byte of data can unfold to at most in any of the codings.
MOST_BYTES, UNFOLD = 1 << 28, 4096

# Fixed values of the format: tags, field sizes, compression codes.
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
FIELD = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
CODES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
NAMES = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}


# --------------------------------------------------------------------- compression


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes([257 - (j - i), data[i]])
        else:
            while j < n and j - i < 128 and (j + 1 >= n or data[j] != data[j + 1]):
                j += 1
            out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes, most: int = MOST_BYTES) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first; code widths grow one code early, as the format has it."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    codes, size, width, run = {}, 258, 9, -1
    put(256, 9)
    for b in data:
        if run < 0:
            run = b
        elif (run, b) in codes:
            run = codes[run, b]
        else:
            put(run, width)
            codes[run, b], size = size, size + 1
            width = max(9, (size).bit_length())
            if size == 4094:
                put(256, width)
                codes, size, width = {}, 258, 9
            run = b
    if run >= 0:
        put(run, width)
        size += 1
        width = min(12, max(9, size.bit_length()))
    put(257, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


def lzw_decode(data: bytes, most: int = MOST_BYTES) -> bytes:
    out, size, held, bits, width = [], 0, 0, 0, 9
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    last = b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code > len(table) or (code == len(table) and not last):
            raise ValueError("bad LZW code")
        found = table[code] if code < len(table) else last + last[:1]
        out.append(found)
        size += len(found)
        if size >= most:
            break
        if last and len(table) < 4096:
            table.append(last + found[:1])
        last = found
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


ENCODE = {"none": bytes, "packbits": packbits_encode, "lzw": lzw_encode, "deflate": lambda x: zlib.compress(x, 1)}
DECODE = {"none": lambda x, most=MOST_BYTES: x[:most], "packbits": packbits_decode, "lzw": lzw_decode, "deflate": lambda x, most=MOST_BYTES: zlib.decompressobj().decompress(x, most)}


# ------------------------------------------------------------------------- writing


def encode(pages: list[np.ndarray], compression: str = "deflate", predictor: int = 2, tile: tuple[int, int] | None = None, rows: int = STRIP_ROWS, order: str = "<") -> bytes:
    """Pages of (rows, columns) or (rows, columns, samples) uint8 or uint16 as one file; tile: (rows, columns)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        height, width, samples = page.shape
        bits = page.dtype.itemsize * 8
        parts = []
        if tile:
            for y in range(0, height, tile[0]):
                for x in range(0, width, tile[1]):
                    block = page[y : y + tile[0], x : x + tile[1]]
                    parts.append(np.pad(block, ((0, tile[0] - block.shape[0]), (0, tile[1] - block.shape[1]), (0, 0)), mode="edge"))
        else:
            parts = [page[y : y + rows] for y in range(0, height, rows)]
        places, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            data = ENCODE[compression](np.ascontiguousarray(part).astype(part.dtype.newbyteorder(order)).tobytes())
            places.append(len(out))
            sizes.append(len(data))
            out += data
            out += b"\0" * (len(out) % 2)
        fields = {IMAGE_WIDTH: (4, [width]), IMAGE_LENGTH: (4, [height]), BITS: (3, [bits] * samples), COMPRESSION: (3, [CODES[compression]]), PHOTOMETRIC: (3, [2 if samples == 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        fields |= {TILE_WIDTH: (4, [tile[1]]), TILE_LENGTH: (4, [tile[0]]), TILE_OFFSETS: (4, places), TILE_COUNTS: (4, sizes)} if tile else {ROWS_PER_STRIP: (4, [rows]), STRIP_OFFSETS: (4, places), STRIP_COUNTS: (4, sizes)}
        entries = b""
        for tag in sorted(fields):
            kind, values = fields[tag]
            raw = struct.pack(f"{order}{len(values)}{FIELD[kind][0]}", *values)
            if len(raw) > 4:
                at = struct.pack(order + "I", len(out))
                out += raw + b"\0" * (len(raw) % 2)
                raw = at
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# ------------------------------------------------------------------------- reading


@dataclass
class Page:
    number: int
    compression: str
    predictor: int
    layout: str
    pixels: np.ndarray  # (rows, columns, samples)


def read_pages(data: bytes) -> Iterator[Page]:
    """Every page of a file; raises ValueError where it is damaged."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF header")
    at, seen, number = struct.unpack_from(order + "I", data, 4)[0], set(), 0
    try:
        while at:
            if at in seen:
                raise ValueError("directories form a loop")
            seen.add(at)
            fields, at = _directory(data, at, order)
            yield _page(data, fields, order, number)
            number += 1
    except (struct.error, zlib.error, LookupError, ArithmeticError, MemoryError, TypeError) as e:
        raise ValueError(f"damaged: {type(e).__name__} {e}") from e


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    n = struct.unpack_from(order + "H", data, at)[0]
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in FIELD:
            letter, size = FIELD[kind]
            where = at + 10 + 12 * i
            if size * count > 4:
                where = struct.unpack_from(order + "I", data, where)[0]
            if where + size * count > len(data):
                raise ValueError(f"field {tag} lies beyond the file")
            fields[tag] = struct.unpack_from(f"{order}{count}{letter}", data, where)
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, fields: dict[int, tuple], order: str, number: int) -> Page:
    width, height = fields[IMAGE_WIDTH][0], fields[IMAGE_LENGTH][0]
    samples, bits = fields.get(SAMPLES, (1,))[0], fields.get(BITS, (1,))[0]
    predictor, code = fields.get(PREDICTOR, (1,))[0], fields.get(COMPRESSION, (1,))[0]
    if bits not in (8, 16) or code not in NAMES or predictor not in (1, 2) or fields.get(PLANAR, (1,))[0] != 1:
        raise ValueError(f"not supported: {bits} bits, compression {code}, predictor {predictor}")
    kind = np.dtype(f"{order}u{bits // 8}")
    tiled = TILE_OFFSETS in fields
    rows, columns = (fields[TILE_LENGTH][0], fields[TILE_WIDTH][0]) if tiled else (min(fields.get(ROWS_PER_STRIP, (height,))[0], height), width)
    places, sizes = (fields[TILE_OFFSETS], fields[TILE_COUNTS]) if tiled else (fields[STRIP_OFFSETS], fields[STRIP_COUNTS])
    if min(width, height, samples, rows, columns) < 1:
        raise ValueError(f"no such size: {width} x {height}, {samples} samples, parts of {columns} x {rows}")
    across = -(-width // columns)
    if len(places) < across * -(-height // rows) or len(sizes) < len(places):
        raise ValueError("strips or tiles are missing")
    held = sum(max(0, min(size, len(data) - at)) for at, size in zip(places, sizes))
    most, part_bytes = min(MOST_BYTES, UNFOLD * held), columns * rows * samples * (bits // 8)
    if max(width * height * samples * (bits // 8), part_bytes) > most:
        raise ValueError(f"{width} x {height} pixels of {samples} samples are more than {most} bytes")
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for i, (at, size) in enumerate(zip(places, sizes)):
        y, x = i // across * rows, i % across * columns
        if y >= height:
            break
        full = rows if tiled else min(rows, height - y)
        need = full * columns * samples
        part = np.frombuffer(DECODE[NAMES[code]](data[at : at + size], need * kind.itemsize), kind, need).reshape(full, columns, samples)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        out[y : y + full, x : x + columns] = part[: height - y, : width - x]
    return Page(number, NAMES[code], predictor, "tiles" if tiled else "strips", out)


_PAGES = "doc_id long, page int, rows int, columns int, samples int, bits int, compression string, layout string, pixels binary, error string"


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _PAGES.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in _PAGES.split(", ")]
    for batch in pieces(batches, text="media"):
        for doc, media in zip(batch["doc_id"].to_pylist(), batch["media"].to_pylist()):
            n, rows, size = 0, [], 0
            try:
                for p in read_pages(media or b""):
                    rows.append((doc, p.number, *p.pixels.shape, p.pixels.itemsize * 8, p.compression, p.layout, p.pixels.tobytes(), None))
                    n, size = n + 1, size + p.pixels.nbytes
                    if size > 1 << 24:  # some pages at a time
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
            except ValueError as e:
                rows.append((doc, n, None, None, None, None, None, None, None, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def explode_pages(media: DataFrame) -> DataFrame:
    """One row for each page of (doc_id, media); null, empty and damaged media end in a row with the error."""
    media.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(_page_rows, _PAGES)


# --------------------------------------------------------------------------- texts


def text_media(text: bytes, width: int = WIDTH) -> bytes:
    payload = text.ljust(max(1, -(-len(text) // width)) * width)
    grid = np.frombuffer(payload, np.uint8).reshape(-1, width)
    return encode([grid[i : i + PAGE_ROWS] for i in range(0, len(grid), PAGE_ROWS)])


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        raw = [(t or "").encode("utf-8", "replace") for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) for x in raw], pa.int64()), pa.array([text_media(x) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])


def documents_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a TIFF file."""
    return keyed(docs).mapInArrow(_media, "doc_id long, n_bytes long, media binary")


def describe(pages: list[np.ndarray]) -> str:
    """A feature string of grey pages: size, mean, spread, entropy, blank share, and row contrast."""
    flat = np.concatenate([p.reshape(-1) for p in pages])
    share = np.bincount(flat, minlength=256) / len(flat)
    some = share[share > 0]
    mean = float((share * np.arange(256)).sum())
    spread = float(np.sqrt((share * (np.arange(256) - mean) ** 2).sum()))
    steps = np.abs(np.diff(flat.astype(np.int16))).mean() if len(flat) > 1 else 0.0
    return f"pages={len(pages)};rows={sum(p.shape[0] for p in pages)};mean={mean:.4f};std={spread:.4f};entropy={-(some * np.log2(some)).sum():.4f};blank={share[32]:.4f};contrast={steps:.4f}"


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _DIGEST.split(", ")]
    for batch in pieces(batches, text="media"):
        rows = []
        for doc, n, media in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"].to_pylist()):
            pages = [p.pixels for p in read_pages(media)]
            payload = b"".join(p.tobytes() for p in pages)
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(pages)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def digests(media: DataFrame) -> DataFrame:
    """What is read back from each stored file: payload and media digests, and the feature string."""
    return media.mapInArrow(_digests, _DIGEST).withColumn("doc_id", unkeyed())
