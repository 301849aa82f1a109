"""Token ids as Parquet list columns.

Documents are dealt by range of id and sorted inside; each range becomes a file. Ids are INT32
lists with a dictionary (16 bits or fewer an id for a vocabulary of 50,000) that falls back to
DELTA_BINARY_PACKED pages, in row groups of a set size and pages of a set number of rows with
column and offset indexes, so a reader can fetch one document's tokens, or the metadata alone.
Files go through Spark's committer: a lost task leaves nothing and is run again.

Encoding: pre-tokens are cut by array operations with the rule of the byte-level tokenizer;
each new pre-token is encoded by the tokenizers library and kept in a table of bounded size, as
byte-pair merges never cross pre-tokens. Texts are gathered from that table, found by hash and
compared point by point: another pre-token with the same hash is encoded by the library.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import tie_of, written
from lattica.llm.textvec import chunks, mix64

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
#: Pre-tokens, and code points of them, that a worker keeps.
KEPT, KEPT_POINTS = 1 << 20, 1 << 24
STEP = 4096
OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": 1 << 20,
    "parquet.block.size": 32 << 20,
    "parquet.page.size": 1 << 18,
    "parquet.page.row.count.limit": 2000,
}


@cache
def _classes() -> np.ndarray:
    """Class of every code point: letters and digits by Unicode category, white space as in \\s."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(i))[0]
        if c in "LN":
            out[i] = LETTER if c == "L" else DIGIT
    for i in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        out[i] = SPACE
    return out


def pre_tokens(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the code points of texts that begin at ``begins``.

    A text is runs of letters, digits, other marks and white space. A space before a run that
    isn't white space belongs to it; any other last white space stands alone. An apostrophe
    alone that opens s, t, re, ve, m, ll or d takes those letters.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[begins[begins < n]] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space of a run before something else in the same text
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
    plain = points[last] == 32
    start[last] = True
    start[last[plain] + 1] = False
    # contractions: a lone apostrophe, not after a space, before letters
    tick = np.flatnonzero(points == 39)
    if len(tick):
        tick = tick[start[tick] & (tick + 1 < n)]
        tick = tick[start[tick + 1] & ~first[tick + 1] & (kind[tick + 1] == LETTER)]
        p = np.r_[points, 0, 0]
        same = np.r_[kind == LETTER, False, False] & ~np.r_[first, True]
        a, b = p[tick + 1], np.where(same[tick + 2], p[tick + 2], 0)
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        start[tick[one | two] + 1] = False
        for at, step in ((tick[one], 2), (tick[two], 3)):
            at = at + step
            start[at[at < n]] = True
    return np.flatnonzero(start)



class Encoder:
    """Texts to ids, with the encoded pre-tokens kept by a 64-bit hash and compared point by point."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, and where their ids are
        self.ids, self.ends = _Growing(np.int32), _Growing(np.int64)  # ids of pre-tokens, and where they end
        self.points, self.stops = _Growing(np.uint32), _Growing(np.int64)  # their code points, and where these end
        self.ends.add([0])
        self.stops.add([0])

    def _ids_of(self, tokens: list[str]) -> Iterator[list[int]]:
        for a in range(0, len(tokens), STEP):
            yield from (enc.ids for enc in self.tokenizer.encode_batch_fast(tokens[a : a + STEP], add_special_tokens=False))

    def _add(self, keys: np.ndarray, tokens: list[str]) -> None:
        for ids in self._ids_of(tokens):
            self.ids.add(ids)
            self.ends.add([self.ids.n])
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.stops.add(self.points.n + np.cumsum(size))
        self.points.add(np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32))
        place = np.arange(self.ends.n - 1 - len(keys), self.ends.n - 1, dtype=np.int32)
        every, place = np.r_[self.keys, keys], np.r_[self.place, place]
        order = np.argsort(every, kind="stable")
        self.keys, self.place = every[order], place[order]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.place[at], -1)

    def _others(self, points: np.ndarray, start: np.ndarray, length: np.ndarray, where: np.ndarray) -> np.ndarray:
        """The pre-tokens whose code points aren't those kept at ``where``: another text with the same hash."""
        low, stop = self.stops.x[where], self.stops.x[where + 1]
        other = stop - low != length
        i = 0
        while i < len(start):  # pre-tokens cover the texts, so a run of them is a slice of the points
            j = max(i + 1, int(np.searchsorted(start, start[i] + (1 << 19), "left")))
            ok = i + np.flatnonzero(~other[i:j])
            n = length[ok]
            begin = np.cumsum(n) - n
            inside = np.arange(n.sum()) - np.repeat(begin, n)
            differ = points[inside + np.repeat(start[ok], n)] != self.points.x[inside + np.repeat(low[ok], n)]
            if differ.any():
                other[ok[np.add.reduceat(differ, begin) > 0]] = True
            i = j
        return np.flatnonzero(other)

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by end_id; offsets)."""
        if self.ends.n > KEPT or self.points.n > KEPT_POINTS:
            self.clear()
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.cumsum([0, *map(len, texts)])
        start = pre_tokens(points, begins[:-1])
        kept = self.ids.x
        if len(start):
            length = np.diff(np.r_[start, len(points)])
            keys = _hashes(points, start, length)
            uniq, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
            known = self._find(uniq)
            new = np.flatnonzero(known < 0)
            if len(new):
                self._add(uniq[new], [joined[start[i] : start[i] + length[i]] for i in at[new]])
                known[new] = self._find(uniq[new])
            where = known[inverse]
            low, size = self.ends.x[where], self.ends.x[where + 1] - self.ends.x[where]
            kept = self.ids.x[: self.ids.n]
            if len(rest := self._others(points, start, length, where)):
                for i, ids in zip(rest, self._ids_of([joined[start[i] : start[i] + length[i]] for i in rest]), strict=True):
                    low[i], size[i] = len(kept), len(ids)
                    kept = np.r_[kept, np.array(ids, np.int32)]
        else:
            low = size = np.zeros(0, np.int64)
        sums = np.r_[0, np.cumsum(size)]
        mine = np.diff(sums[np.searchsorted(start, begins)]) + 1
        offsets = np.r_[0, np.cumsum(mine)]
        body = kept[np.repeat(low - sums[:-1], size) + np.arange(sums[-1])]
        out = np.full(offsets[-1], end_id, np.int32)
        keep = np.ones(offsets[-1], bool)
        keep[offsets[1:] - 1] = False
        out[keep] = body
        return out, offsets


class _Growing:
    """An array that doubles as it is added to."""

    def __init__(self, kind):
        self.x, self.n = np.zeros(1 << 16, kind), 0

    def add(self, more) -> None:
        if self.n + len(more) > len(self.x):
            self.x = np.r_[self.x, np.zeros(max(len(self.x), len(more)), self.x.dtype)]
        self.x[self.n : self.n + len(more)] = more
        self.n += len(more)


_UP = np.random.default_rng(43).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(points: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64 bits of each pre-token: its length, and its mixed code points weighted by their place modulo 64.

    Places 64 apart have one weight, so long pre-tokens can share a key; what a key finds is compared."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + (1 << 19), "left")))
        n, a = length[i:j], int(start[i])
        begin = start[i:j] - a
        place = np.arange(n.sum()) - np.repeat(begin, n)
        x = points[a : a + len(place)].astype(np.uint64) + np.uint64(0x632BE59B)
        x *= _UP[place & 63]
        x ^= x >> np.uint64(32)
        out[i:j] = np.add.reduceat(x * _UP[(place + 7) & 63], begin)
        i = j
    return mix64(out + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenized(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, shard, start (in the shard), n_tokens, ids; a shard is a range of ids, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = _encoder(vocabulary), 0
        for batch in chunks(batches):
            ids, offsets = encoder.encode([t or "" for t in batch.column("text").to_pylist()], end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("shard"), pa.array(at + offsets[:-1]), pa.array(np.diff(offsets)), lists],
                names=["doc_id", "shard", "start", "n_tokens", "ids"],
            )
            at += int(offsets[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # ranges of id and tie, so that rows that share an id, or are equal, needn't be in one task
    dealt = docs.select("doc_id", "text", tie_of(F.col("text")).alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return dealt.withColumn("shard", F.spark_partition_id()).mapInArrow(run, f"doc_id {kind}, shard int, start bigint, n_tokens bigint, ids array<int>")


def write_tokens(docs: DataFrame, vocabulary: str, *, end_id: int = 2, path: str | None = None) -> DataFrame:
    """The token table of ``docs`` as it is read back: doc_id, shard, start, n_tokens, ids.

    Without a ``path`` the files go with the application. Null text is empty and gives the end id
    alone; texts of any length are one row; rows of one id follow each other by a hash of their text;
    an empty table gives an empty one; other columns are not read.
    """
    tokens = tokenized(docs, vocabulary, end_id)
    if path is None:
        return written(tokens, "tokens", **OPTIONS)
    tokens.write.mode("overwrite").options(**{k: str(v) for k, v in OPTIONS.items()}).parquet(path)
    return docs.sparkSession.read.schema(tokens.schema).parquet(path)


def tokens_of(tokens: DataFrame, doc_ids: Sequence[int]) -> DataFrame:
    """doc_id, ids of some documents: their row groups and pages alone are read, by the statistics of doc_id."""
    return tokens.where(F.col("doc_id").isin(list(doc_ids))).select("doc_id", "ids")


def metadata(tokens: DataFrame) -> DataFrame:
    """doc_id, shard, start, n_tokens: no page of ids is read."""
    return tokens.select("doc_id", "shard", "start", "n_tokens")


def positions(tokens: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files.

    The start in a shard is in the file; the shards' totals are one row for each file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values, offsets = ids.values.to_numpy().astype("<i4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "shard", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    totals = tokens.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("shard", before.alias("before"))
    read = tokens.select("doc_id", "shard", "start", "ids").mapInArrow(run, f"doc_id {kind}, shard int, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(F.broadcast(totals), "shard").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
