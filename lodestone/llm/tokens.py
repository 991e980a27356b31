"""Token ids of whole texts with a given tokenizer file, fast enough for a corpus.

The tokenizers handled here lower the text, split it into runs of letters, single digits and
runs of other signs, and drop white space, so a text's ids are its runs' ids in a row.  A
batch is split into runs with numpy; each run that was not seen before goes through the
library once, its ids are kept in a memo keyed by a 64-bit hash, and the rest is gathering.
A second hash of each run is checked at every use, so that two runs that share the first
are told apart.  Whether a tokenizer is of this kind is tried out when it is loaded (PROBES); one that is not
gets every text whole.
Runs whose split, case or normal form needs more than ASCII and Latin-1 letters (an
apostrophe, other scripts, control signs, special tokens) are taken as whole
white-space-free pieces and left to the library as they are.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from lodestone.llm import kit

END = 1
_CHECK = np.random.default_rng(20250101).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)

_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[ord("'")] = _OTHER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Texts that a tokenizer must encode run by run as it does whole.
PROBES = [
    "Hello, World! it's 12,345.67 (a--b) ...", "ÀÉÎÕÜ straße Œuvre ×÷ naïve", "日本語 テスト mixed英語 Ελλάδα ΣΊΣΥΦΟΣ", "a\u0301e\u0308 \u00a0nbsp\u2003em\tTab\r\nline",
    "<|endoftext|> <|startoftext|>x <s> [CLS]", "don't we'll I'M they'Re ' '", "x" * 300 + " " + "9" * 40 + "?!" * 30, "UPPER lower MiXeD_snake-case/path.to", " leading  double   spaces ", "\x00\x01 \x7f\x1c\x0b emoji 😀👍🏽 ﬁ ǅ İ",
]


def split(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with case lowered, starts, ends, whole) of the runs; whole: left to the library as it is."""
    kind = _CLASS[buffer]
    low = _LOWER[buffer]
    # Latin-1 letters: 0xC3 and one more byte.
    lead = np.flatnonzero(buffer[:-1] == 0xC3)
    if len(lead):
        second = buffer[lead + 1]
        letter = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        lead, second = lead[letter], second[letter]
        kind[lead] = kind[lead + 1] = _LETTER
        capital = lead[second <= 0x9E] + 1
        low[capital] = buffer[capital] | 0x20
    special = np.flatnonzero((buffer[:-1] == ord("<")) & (buffer[1:] == ord("|")))
    kind[special] = _OTHER
    space = kind == _SPACE
    begin = np.ones(len(buffer), bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begin &= ~space
    inside = None
    odd = np.flatnonzero(kind == _OTHER)
    if len(odd):
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        piece = np.searchsorted(edge, odd, side="right") - 1  # the buffer begins and ends with a space
        piece = np.unique(piece)
        mark = np.zeros(len(buffer) + 1, np.int8)
        mark[edge[piece]] += 1
        mark[edge[piece + 1]] -= 1
        inside = np.cumsum(mark[:-1]).astype(bool)
        begin &= ~inside
        begin[edge[piece]] = True
        low = np.where(inside, buffer, low)
    starts = np.flatnonzero(begin)
    stop = begin | space
    last = np.flatnonzero(~space[:-1] & stop[1:]) + 1
    return low, starts, last, inside[starts] if inside is not None else np.zeros(len(starts), bool)


class Encoder:
    """encode(): flat ids and how many each text has, with ``end`` appended to each."""

    #: Runs that the memo holds before it starts anew; bounds memory and nothing else.
    MEMO = 1_500_000
    #: Entries of the direct-mapped table before the sorted memo.
    FRONT = 1 << 19

    def __init__(self, path: str, end: int | None = END):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends_word = np.zeros(self.vocabulary, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.ends_word[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.end = end
        self._reset()
        self.by_run = True
        self.by_run = all(self._runs_of([t]).tolist() == self.tokenizer.encode(t, add_special_tokens=False).ids for t in [*PROBES, "\n".join(PROBES)])

    def _runs_of(self, texts: list[str]) -> np.ndarray:
        end, self.end = self.end, None
        try:
            return self.encode(pa.array(texts))[0]
        finally:
            self.end = end

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slots = np.zeros(0, np.int64)
        self.begin, self.size, self.check = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint64)
        self.flat, self.n_flat, self.n = np.zeros(1 << 18, np.uint32), 0, 0
        self.front_key, self.front_slot = np.zeros(self.FRONT, np.uint64), np.zeros(self.FRONT, np.int64)

    def _library(self, words: list[str], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of new runs, where each begins, and counts."""
        begin, counts = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        parts, n = [], 0
        single = np.flatnonzero(~whole)
        lines = [single[i : i + 256] for i in range(0, len(single), 256)] if self.ends_word.any() else []
        for group, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join([words[i] for i in g.tolist()]) for g in lines], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) == len(group):  # each run ends with the one token of it that ends a word
                counts[group] = np.diff(cuts, prepend=0)
                begin[group] = n + cuts - counts[group]
                parts.append(ids)
                n += len(ids)
        rest = np.flatnonzero(counts < 0).tolist()
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            begin[i], counts[i] = n, len(e.ids)
            parts.append(np.array(e.ids, np.uint32))
            n += len(e.ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), begin, counts

    def _learn(self, h: np.ndarray, check: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> None:
        """Add runs with distinct hashes h (sorted)."""
        words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]
        ids, begin, counts = self._library(words, whole)
        while self.n + len(h) > len(self.begin):
            self.begin, self.size, self.check = (np.append(x, np.zeros_like(x)) for x in (self.begin, self.size, self.check))
        while self.n_flat + len(ids) > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        self.begin[self.n : self.n + len(h)] = self.n_flat + begin
        self.size[self.n : self.n + len(h)] = counts
        self.check[self.n : self.n + len(h)] = check
        at = np.searchsorted(self.keys, h)
        self.keys = np.insert(self.keys, at, h)
        self.slots = np.insert(self.slots, at, np.arange(self.n, self.n + len(h)))
        self.n, self.n_flat = self.n + len(h), self.n_flat + len(ids)

    def _find(self, h: np.ndarray, check: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """The memo's slot of each run."""
        h = np.maximum(h, np.uint64(1))  # 0 marks a free place
        at = (h & np.uint64(self.FRONT - 1)).astype(np.int64)
        slot = self.front_slot[at]
        miss = np.flatnonzero(self.front_key[at] != h)
        if len(miss):
            values, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            where = np.searchsorted(self.keys, values)
            known = np.zeros(len(values), bool)
            inner = where < len(self.keys)
            known[inner] = self.keys[where[inner]] == values[inner]
            new = np.flatnonzero(~known)
            if self.n + len(new) > self.MEMO and self.n:
                self._reset()
                return self._find(h, check, raw, starts, ends, whole)
            if len(new):
                src = miss[first[new]]
                self._learn(values[new], check[src], raw, starts[src], ends[src], whole[src])
            found = self.slots[np.searchsorted(self.keys, values)]
            slot[miss] = found[back]
            self.front_key[at[miss]], self.front_slot[at[miss]] = h[miss], slot[miss]
        other = np.flatnonzero(self.check[slot] != check)
        if len(other):  # another run has this hash: looked up by both
            before = self.n
            with np.errstate(over="ignore"):
                found = self._find(kit.mix(h[other] + kit.mix(check[other])), check[other], raw, starts[other], ends[other], whole[other])
            if self.n < before:  # the memo began anew
                return self._find(h, check, raw, starts, ends, whole)
            slot[other] = found
        return slot

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Every text by the library as it is."""
        done = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        tail = [] if self.end is None else [self.end]
        parts = [np.array([*e.ids, *tail], np.uint32) for e in done]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(x) for x in parts], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_run:
            return self._whole(texts)
        data = [t.encode("utf-8", "replace") if t else b"" for t in texts.to_pylist()]
        raw = b"\n" + b"\n".join(data) + b"\n"
        buffer = np.frombuffer(raw, np.uint8)
        base = np.concatenate([[1], 1 + np.cumsum(np.fromiter((len(x) + 1 for x in data), np.int64, len(data)))]).astype(np.int64)
        low, starts, ends, whole = split(buffer)
        first = np.searchsorted(starts, base)
        with np.errstate(over="ignore"):
            up, down = kit._powers(len(buffer))
            total = np.cumsum(kit._SALT[low] * up[: len(buffer)])
            h = kit.mix((total[ends - 1] - total[starts - 1]) * down[starts] + whole)
            total = np.cumsum(_CHECK[low] * up[: len(buffer)])
            check = (total[ends - 1] - total[starts - 1]) * down[starts] + whole
        slot = self._find(h, check, raw, starts, ends, whole)
        n = self.size[slot]
        stop = np.concatenate([[0], np.cumsum(n)])
        counts = np.diff(stop[first])
        ids = self.flat[np.repeat(self.begin[slot] - stop[:-1], n) + np.arange(stop[-1])]
        if self.end is not None:
            ids = np.insert(ids, np.cumsum(counts), np.uint32(self.end))
            counts = counts + 1
        return ids, counts


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end: int | None = END) -> Encoder:
    """One for each Python worker."""
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = Encoder(path, end)
    return _ENCODERS[path, end]
