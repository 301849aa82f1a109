"""Words and n-grams of Arrow text columns as NumPy arrays, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
PIECE = 1 << 19
#: A word is hashed in strides of this many bytes.
STRIDE = 256
_RANDOM = np.random.default_rng(41).integers(0, 1 << 63, STRIDE * 256, np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: letters, digits and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words where only white space divides.
BLACK = np.ones(256, bool)
BLACK[9:14] = BLACK[32] = False


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches cut to rows of about ``size`` bytes of text; a longer row is one by itself."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _beyond_ascii(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of Unicode punctuation, first bytes of characters that are words by themselves).

    Scripts without spaces (kana and Han from U+3040, Thai and Lao) have a word for each
    character, all of three bytes; the blocks of general, Han and full-width punctuation divide words.
    """
    lead = np.flatnonzero(data >= 0xE0)
    lead = lead[lead + 2 < len(data)]
    if not len(lead):
        return lead, lead
    a, b, c = data[lead], data[lead + 1], data[lead + 2]
    mark = (a == 0xE2) & (b <= 0x81) | (a == 0xE3) & (b == 0x80) | (a == 0xEF) & (b == 0xBC) & (c < 0x90)
    alone = (a == 0xE3) & (b > 0x80) | (a > 0xE3) & (a <= 0xE9) | (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)
    at = lead[mark]
    return np.concatenate([at, at + 1, at + 2]), lead[alone]


class Words:
    """start, end: byte positions; row: index of the text; hash: 64 bits of each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM, lower: bool = True):
        is_word = kind[data]
        alone = np.zeros(0, np.int64)
        if kind is ALNUM:
            marks, alone = _beyond_ascii(data)
            is_word[marks] = False
        left = np.empty(len(data) + 1, bool)
        left[0] = left[-1] = False
        left[1:] = is_word
        cut = np.r_[offsets[:-1], alone, alone + 3]
        cut = cut[cut < len(data)]
        left[cut] = False
        self.start = np.flatnonzero(is_word & ~left[:-1])
        right = np.empty(len(data) + 1, bool)
        right[-1] = False
        right[:-1] = is_word
        right[cut] = False
        self.end = np.flatnonzero(is_word & ~right[1:]) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.rows = len(offsets) - 1
        self.hash = _hashes(LOWER[data] if lower else data, self.start, self.end)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of n words of one text."""
        m = len(self.row) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:m] == self.row[n - 1 :])
        h = np.zeros(len(at), np.uint64)
        for j in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hash[at + j]
        return at, mix64(h)

    def bounds(self) -> np.ndarray:
        """Where each text's words begin, and the end of the last."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each word: random numbers by place and byte are summed in each stride, and the
    strides, mixed with their number, in each word. Unlike a polynomial modulo 2^64 this has no
    texts of regular form that collide. Memory is bounded by PIECE, however long a word is."""
    length = end - start
    strides = np.maximum(1, -(-length // STRIDE))
    first = np.cumsum(strides) - strides
    number = np.arange(strides.sum()) - np.repeat(first, strides)
    at = np.repeat(start, strides) + number * STRIDE
    size = np.minimum(STRIDE, np.repeat(end, strides) - at)
    upto, sums, i = np.cumsum(size), np.empty(len(at), np.uint64), 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] - size[i] + PIECE, "right")))
        n = size[i:j]
        begin = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(begin, n)
        byte = data[place + np.repeat(at[i:j], n)]
        sums[i:j] = np.add.reduceat(_RANDOM[(place << 8) | byte], begin)
        i = j
    if len(at) > len(start):
        sums = np.add.reduceat(mix64(sums + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first) if len(start) else sums
    else:
        sums = mix64(sums)
    return mix64(sums + length.astype(np.uint64))


def hash_words(words: list[str]) -> np.ndarray:
    """The hash that each word would have in a text (as a whole, in lower case for A-Z)."""
    enc = [w.encode() for w in words]
    offsets = np.cumsum([0, *map(len, enc)])
    data = np.frombuffer(b"".join(enc), np.uint8)
    keep = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros(len(words), np.uint64)
    out[keep] = _hashes(LOWER[data], offsets[keep], offsets[keep + 1])
    return out


class Table:
    """Positions of 64-bit keys in a fixed set, by a bitmap and a binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.order = np.unique(keys, return_index=True)
        self.bits = max(10, int(np.ceil(np.log2(len(self.keys) + 1))) + 4)
        self.shift = np.uint64(64 - self.bits)
        self.bitmap = np.zeros(1 << self.bits, bool)
        self.bitmap[self.keys >> self.shift] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h that are in the set, index of the key as given at first)."""
        at = np.flatnonzero(self.bitmap[h >> self.shift])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == h[at]
        return at[hit], self.order[k[hit]]
