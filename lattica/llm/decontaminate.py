"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Alignment is over words, matches 2, mismatches and gaps -1; a pair is reported from a score of
``least`` of the whole item's with itself. Seeds are the pairs of neighbouring words of an item,
found in a document side by side or with one word between. No pair is lost to them: let an
alignment match m of an item's n words, with p breaks between matches that skip item words, q that
skip two or more words of the document alone, and u and v that skip none and one. Then
``score <= 2m - p - 2q - v`` with ``p + q + u + v = m - 1`` and ``m + p <= n``, so a score of S
needs ``2u + v >= S - 2 - p`` and ``p <= (2n - S) / 3``: of the weight ``need = (4S - 2n) / 3 - 2``.
An item's most common pairs, of less weight than ``need`` together, can therefore be left out, and
what is left, its rarest, has a hit still. Where there is one, all pairs of the item are counted in
the passage around it, and from ``need`` on it is aligned. A passage is 4n words and the next
begins 2n later, so the words of an alignment (2n at most) lie in one of them whole.

The test items are the query set, in blocks of at most ``block_bytes`` of text, so what a task holds
is bounded. A first reading of the documents counts in how many each pair occurs, over all
documents; the second finds and aligns in the same task: a document's hits are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lattica.llm.textvec import Table, Words, chunks, mix64, text_bytes

MATCH, MISS, GAP = 2, 1, 1
#: Items of fewer words must stand in a document word for word.
SHORT = 5
_ITEM, _PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _pairs(h: np.ndarray, distance: int) -> np.ndarray:
    """The hash of each word and the one ``distance`` after it."""
    return mix64(h[: max(0, len(h) - distance)] * _PAIR + h[distance:])


@dataclass
class _Items:
    ids: list
    words: np.ndarray  # of all items
    bounds: np.ndarray  # where each item's begin
    need: np.ndarray  # weight of pairs that an alignment has at least
    key: np.ndarray  # per place: the pair, or the whole of a short item
    item: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.bounds)


def _items(rows, least: float) -> _Items:
    w = Words(*text_bytes(pa.array([r["text"] for r in rows], pa.large_string())))
    bounds = w.bounds()
    n = np.diff(bounds)
    pair = _pairs(w.hash, 1)
    at = np.flatnonzero((w.row[:-1] == w.row[1:]) & (n[w.row[:-1]] >= SHORT)) if len(w.row) else np.zeros(0, np.int64)
    keys, item = [pair[at]], [w.row[at]]
    for k in range(1, SHORT):
        i = np.flatnonzero(n == k)
        if len(i):
            first, gram = w.grams(k)
            keys.append(gram[np.isin(first, bounds[i])])
            item.append(i)
    need = np.maximum(1, np.ceil((4 * least * MATCH * n - 2 * n) / 3 - 2 - 1e-9)).astype(np.int64)
    return _Items([r["item_id"] for r in rows], w.hash, bounds, np.where(n < SHORT, 1, need), np.concatenate(keys), np.concatenate(item))


def _seeds(items: _Items, df: np.ndarray) -> np.ndarray:
    """Places that are seeds: an item's pairs but the most common, which weigh less than it needs."""
    order = np.lexsort((items.key, -df, items.item))
    item = items.item[order]
    rank = np.arange(len(order)) - np.searchsorted(item, item)  # 0: the most common of the item
    return order[(2 * (rank + 1) >= items.need[item]) | (items.size[item] < SHORT)]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local scores of equally many items and passages (rows of hashes, 0 pads), and their ends."""
    n, width = passage.shape
    ramp = np.arange(width, dtype=np.int32) * GAP
    above, best, end = np.zeros((n, width), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(item.shape[1]):
        same = (passage == item[:, i : i + 1]) & (item[:, i : i + 1] != 0)
        diagonal = np.zeros_like(above)
        diagonal[:, 1:] = above[:, :-1]
        h = np.maximum(diagonal + np.where(same, MATCH, -MISS).astype(np.int32), above - GAP)
        np.maximum(h, 0, out=h)
        above = np.maximum.accumulate(h + ramp, axis=1) - ramp
        top = above.max(axis=1)
        better = top > best
        end[better] = above[better].argmax(axis=1)
        best = np.maximum(best, top)
    return best, end


def _pad(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(1, *map(len, rows)) if len(rows) > 1 else max(1, len(rows[0]))), np.uint64)
    for r, x in zip(out, rows, strict=True):
        r[: len(x)] = x
    return out


@dataclass
class _Seeds:
    """What the second reading looks up."""

    items: _Items
    seeds: Table
    first: np.ndarray  # per seed key: where its items begin in ``owner``
    owner: np.ndarray
    every: Table  # all pairs, by item

    def passages(self, w: Words) -> np.ndarray:
        """(row, item, number of the passage) of those that have a seed and pairs enough."""
        n, b = self.items.size, w.bounds()
        found = []
        for d in (1, 2):
            pair = _pairs(w.hash, d)
            pair_at, key = self.seeds.find(pair)
            keep = w.row[pair_at] == w.row[pair_at + d] if len(pair_at) else np.zeros(0, bool)
            found.append((pair_at[keep], key[keep]))
        for k in range(1, SHORT):  # whole short items
            if (n == k).any():
                first, gram = w.grams(k)
                at, key = self.seeds.find(gram)
                found.append((first[at], key))
        at, key = (np.concatenate(x) for x in zip(*found, strict=True))
        count = self.first[key + 1] - self.first[key]
        item = self.owner[np.repeat(self.first[key] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        at = np.repeat(at, count)
        if not len(at):
            return np.zeros((3, 0), np.int64)
        row = w.row[at]
        k = (at - b[row]) // (2 * n[item])
        some = np.stack([np.r_[row, row], np.r_[item, item], np.r_[k, np.maximum(0, k - 1)]])
        some = np.unique(some, axis=1)
        keep = np.zeros(some.shape[1], bool)
        for a in range(0, some.shape[1], 4096):
            keep[a : a + 4096] = self._enough(w, b, *some[:, a : a + 4096])
        return some[:, keep]

    def _enough(self, w: Words, b: np.ndarray, row: np.ndarray, item: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether the passages hold pairs of the item with the weight it needs."""
        low, high = _span(self.items.size[item], b, row, k)
        size = high - low
        who = np.repeat(np.arange(len(row)), size)
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        weight = np.zeros(len(row), np.int64)
        for d, worth in ((1, 2), (2, 1)):
            ok = at + d < high[who]
            pair = mix64(w.hash[at[ok]] * _PAIR + w.hash[at[ok] + d])
            hit, _ = self.every.find(mix64(pair + item[who[ok]].astype(np.uint64) * _ITEM))
            weight += worth * np.bincount(who[ok][hit], minlength=len(row))
        return (weight >= self.items.need[item]) | (self.items.size[item] < SHORT)


def _span(n: np.ndarray, b: np.ndarray, row: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = b[row] + 2 * n * k
    return low, np.minimum(b[row + 1], low + 4 * n)


def _score(w: Words, passages: np.ndarray, items: _Items, least: float) -> list[tuple]:
    """(row, item, score, matched, first and last word) of the best alignment of each pair."""
    b, size = w.bounds(), items.size
    best: dict[tuple[int, int], tuple] = {}
    order = passages[:, np.argsort(size[passages[1]], kind="stable")]
    lengths, begin = np.unique(size[order[1]], return_index=True)
    for n, i, j in zip(lengths, begin, np.r_[begin[1:], order.shape[1]], strict=True):
        step = max(1, (1 << 18) // int(4 * n))  # items of one length at a time, 2 MB of passages
        for a in range(i, j, step):
            row, item, k = order[:, a : min(j, a + step)]
            low, high = _span(n, b, row, k)
            rows = [w.hash[x:y] for x, y in zip(low, high, strict=True)]
            mine = items.words[items.bounds[item][:, None] + np.arange(n)]
            score, end = align(mine, _pad(rows))
            share = score / (MATCH * n)
            good = np.flatnonzero(share >= (1.0 if n < SHORT else least))
            if not len(good):
                continue
            # the same backwards gives where the alignment begins
            _, start = align(mine[good][:, ::-1], _pad([rows[g][: end[g] + 1][::-1] for g in good]))
            for g, s in zip(good, start, strict=True):
                r, x, y = int(row[g]), int(low[g] + end[g] - s), int(low[g] + end[g])
                matched = int(np.isin(mine[g], w.hash[x : y + 1]).sum())
                found = (float(share[g]), matched, x - int(b[r]), y - int(b[r]))
                best[r, int(item[g])] = max(best.get((r, int(item[g])), found), found, key=lambda f: (f[0], -f[2]))
    return sorted((r, i, *x) for (r, i), x in best.items())


def _blocks(docs: DataFrame, benchmark: DataFrame, least: float, block_bytes: int) -> Iterator:
    """A broadcast of what the second reading looks up, for each block of items."""
    if least < 0.5:
        raise ValueError("pairs under half of an item's score have no seed for sure")
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # at most about block_bytes
        found = _items(rows, least)
        if len(found.key):
            yield docs.sparkSession.sparkContext.broadcast(_prepared(docs, found))


def _prepared(docs: DataFrame, items: _Items) -> _Seeds:
    keys, place = np.unique(items.key, return_inverse=True)
    held = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, df = Table(held.value), np.zeros(len(held.value), np.int64)
        for batch in chunks(batches):
            w = Words(*text_bytes(batch.column("text")))
            at, key = table.find(_pairs(w.hash, 1))
            keep = w.row[at] == w.row[at + 1] if len(at) else np.zeros(0, bool)
            seen = np.unique(w.row[at[keep]] * np.int64(len(df)) + key[keep])
            df += np.bincount(seen % len(df), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some), pa.array(df[some])], names=["pair", "n"])

    df = np.zeros(len(keys), np.int64)
    t = docs.select("text").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # one row for each pair of a block
    df[t["pair"].to_numpy()] = t["n"].to_numpy()
    seeds = _seeds(items, df[place])
    seeds = seeds[np.lexsort((items.item[seeds], place[seeds]))]
    used, first = np.unique(place[seeds], return_index=True)
    every = np.unique(mix64(items.key + items.item.astype(np.uint64) * _ITEM))
    return _Seeds(items, Table(keys[used]), np.r_[first, len(seeds)], items.item[seeds], Table(every))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, score, matched, first_word, last_word: the pairs that score ``least`` or more.

    ``score`` is the best local alignment over that of the whole item with itself (0 to 1); the
    words count from 0 in the document. Null and empty texts have no words and no pairs; an item
    of under five words is found only word for word; a passage that a document repeats gives its
    best alignment, the first among equals; repeated rows give a row each; with no item or no
    document there are no pairs; other columns are not read.
    """
    ids, item_type = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {ids.simpleString()}, item_id {item_type.simpleString()}, score double, matched int, first_word int, last_word int"
    item_type = to_arrow_type(item_type)
    out = docs.sparkSession.createDataFrame([], schema)
    for held in _blocks(docs, benchmark, least, block_bytes):

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch, found in _found(batches, held.value, least):
                if found:
                    row, item, score, matched, a, b = zip(*found, strict=True)
                    yield pa.record_batch(
                        [batch.column("doc_id").take(pa.array(row)), pa.array([held.value.items.ids[i] for i in item], item_type), pa.array(score), pa.array(matched, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                        names=["doc_id", "item_id", "score", "matched", "first_word", "last_word"],
                    )

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(find, schema))
    return out


def _found(batches: Iterator[pa.RecordBatch], seeds: _Seeds, least: float) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    for batch in chunks(batches):
        w = Words(*text_bytes(batch.column(batch.schema.get_field_index("text"))))
        passages = seeds.passages(w)
        yield batch, _score(w, passages, seeds.items, least) if passages.shape[1] else []


def clean(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows without a contaminated pair, with their columns; a row is judged by its own text, whatever its id."""
    kept = docs
    for held in _blocks(docs, benchmark, least, block_bytes):

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch, found in _found(batches, held.value, least):
                good = np.ones(batch.num_rows, bool)
                good[[f[0] for f in found]] = False
                yield batch.filter(pa.array(good))

        kept = kept.mapInArrow(keep, docs.schema)
    return kept
