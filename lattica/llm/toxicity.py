"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of labelled rows (``examples`` of each label, by hash of the id), each
counted for as many labelled rows as it stands for. Terms are all words of the examples, with document
frequencies counted over all documents. Two votes of the k nearest are mixed: over all terms (its
neighbours and similarities are the evidence), and over the words that toxic examples hold more
often than chance allows, which long texts would drown: a Chernoff bound on their count, with the
false-discovery rate held at 1 % over the words tried; examples that share their smallest three-word
hash count once there, so copies lend no weight. Both votes read an inverted index in blocks of
examples that keeps the largest weight of each term in a block: the blocks of the greatest bounds
are read first, then those alone whose bound reaches the k-th neighbour found. Both are exact. A
text that equals examples has their label. An isotonic fit of leave-one-out votes turns a vote into a
probability. The indexes are bounded by the sample and go to every task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import by_hash, doc_hash
from lattica.llm.textvec import Table, Words, chunks, text_bytes

FOLDS = 5
#: Examples of a block, and blocks that are read before any is left out.
BLOCK, OPENED = 32, 8
#: Share and number of the examples from which a term's list is a row of a matrix, and steps of similarities.
COMMON, LEAST, GRAIN = 1 / 32, 64, 1e-7
#: Rows of the matrix that are taken at once.
PART = 16
#: Share of the vote over all terms, and the cosine from which texts are copies.
WHOLE = 0.25
COPY = 0.9999


def fold(doc_id) -> object:
    """crc32 of the id as text (null: the empty text), modulo FOLDS."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _term_counts(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word hash, count) of each distinct word of each text."""
    order = np.lexsort((w.hash, w.row))
    row, h = w.row[order], w.hash[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(row) else order
    return row[first], h[first], np.diff(np.r_[first, len(row)])


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class Postings:
    """Examples' unit vectors, inverted, in blocks with the largest weight of each term.

    The lists of terms that many examples hold are spread out as rows of a matrix, which a product
    with a text's weights reads whole; blocks are bounded over the other terms.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], terms: int, spread: bool = True):
        self.n = len(rows)
        # examples with the same strongest term lie together, so that blocks differ in their terms
        strongest = np.array([t[np.argmax(x)] if len(t) else -1 for t, x in rows], np.int64)
        self.place = np.argsort(strongest, kind="stable")  # position of each stored row
        term = np.concatenate([rows[i][0] for i in self.place]).astype(np.int32) if rows else np.zeros(0, np.int32)
        order = np.argsort(term, kind="stable")
        term = term[order]
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(rows[i][0]) for i in self.place])[order]
        self.x = np.concatenate([rows[i][1] for i in self.place])[order] if rows else np.zeros(0, np.float32)
        del order
        # runs of postings of one term in one block
        block = self.row // BLOCK
        new = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(block) != 0)]) if len(term) else np.zeros(0, np.int64)
        self.begin, self.block = np.r_[new, len(term)].astype(np.int32), block[new]
        self.most = np.maximum.reduceat(self.x, new) if len(new) else self.x
        self.run = np.searchsorted(term[new], np.arange(terms + 1))
        if spread:
            self._spread()

    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The examples' vectors, by position."""
        term = np.repeat(np.arange(len(self.run) - 1), np.diff(self.begin[self.run]))
        order = np.argsort(self.row, kind="stable")
        cut = np.searchsorted(self.row[order], np.arange(self.n + 1))
        out: list = [None] * self.n
        for r, at in enumerate(self.place.tolist()):
            mine = order[cut[r] : cut[r + 1]]
            out[at] = term[mine], self.x[mine]
        return out

    def _spread(self) -> None:
        low, high = self.begin[self.run[:-1]], self.begin[self.run[1:]]
        common = np.flatnonzero(high - low >= max(LEAST, self.n * COMMON))
        self.slot = np.full(len(low), -1, np.int32)
        self.slot[common] = np.arange(len(common))
        self.common = np.zeros((len(common), self.n), np.float32)
        for i, t in enumerate(common.tolist()):
            self.common[i, self.row[low[t] : high[t]]] = self.x[low[t] : high[t]]
        self.blocks = np.arange(0, self.n, BLOCK)
        self.part = np.zeros((min(PART, len(common)), self.n), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("common", "slot", "blocks", "part", "rows")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._spread()

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(positions, similarities) of the k nearest with similarity over 0; ties by position."""
        if not self.n or not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        slot = self.slot[terms]
        often = slot >= 0
        base = self._product(slot[often], weights[often].astype(np.float32))
        terms, weights = terms[~often], weights[~often]
        n = self.run[terms + 1] - self.run[terms]
        run, weight = _ranges(self.run[terms], n), np.repeat(weights, n)
        block = self.block[run]
        bound = np.maximum.reduceat(base, self.blocks) + np.bincount(block, self.most[run] * weight, len(self.blocks))
        chosen = np.zeros(len(bound), bool)
        chosen[np.argsort(-bound, kind="stable")[:OPENED]] = True
        pos, sim = self._read(run, weight, chosen[block], chosen, base, k, leave, GRAIN / 2)
        rest = ~chosen & (bound > 0)
        least = GRAIN / 2
        if len(pos) >= k:
            least = sim[-1] - GRAIN
            rest &= bound >= sim[-1] - 2 * GRAIN
        if rest.any():
            p, s = self._read(run, weight, rest[block], rest, base, k, leave, least)
            pos, sim = np.r_[pos, p], np.r_[sim, s]
            keep = np.lexsort((pos, -sim))[:k]
            pos, sim = pos[keep], sim[keep]
        return pos, sim

    def _product(self, slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weights times these rows of the matrix, some rows at a time in memory that is used again."""
        base = np.zeros(self.n, np.float32)
        for a in range(0, len(slots), PART):
            n = min(PART, len(slots) - a)
            rows = np.take(self.common, slots[a : a + n], axis=0, out=self.part[:n], mode="clip")  # other modes copy
            base += weights[a : a + n] @ rows
        return base

    def _read(self, run, weight, wanted, blocks, base, k: int, leave: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest of some blocks from ``least`` on; similarities to GRAIN, so that equal examples tie."""
        wanted = np.flatnonzero(wanted)
        run, weight = run[wanted], weight[wanted]
        begin = self.begin[run]
        n = self.begin[run + 1] - begin
        at = _ranges(begin, n)
        sums = np.bincount(self.row[at], self.x[at] * np.repeat(weight, n), self.n) + base
        row = np.flatnonzero(sums >= least)
        row = row[blocks[row // BLOCK]]
        sim = np.round(sums[row] / GRAIN) * GRAIN
        pos = self.place[row]
        ok = (sim > 0) & (pos != leave)
        pos, sim = pos[ok], sim[ok]
        if len(sim) > k:
            near = sim >= np.partition(sim, -k)[-k]
            pos, sim = pos[near], sim[near]
        keep = np.lexsort((pos, -sim))[:k]
        return pos[keep], sim[keep]


class Index(Postings):
    """Postings of examples with ids and labels; ``standing``: for how many labelled rows one stands."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], terms: int, k: int, standing: np.ndarray | None = None, spread: bool = True):
        super().__init__(rows, terms, spread)
        self.ids, self.toxic, self.rows, self.k = ids, toxic.astype(float), rows, k
        self.standing = np.ones(len(rows)) if standing is None else standing

    def nearest(self, terms: np.ndarray, weights: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return super().nearest(terms, weights, self.k, leave)

    def vote(self, pos: np.ndarray, weight: np.ndarray) -> float:
        weight = weight * self.standing[pos]
        return float((weight * self.toxic[pos]).sum() / weight.sum())


class Model:
    """terms (word hashes), idf, both indexes, the calibration of votes, and the rate without terms."""

    def __init__(self, ids, toxic, vectors, corpus_df, n_docs: int, terms: np.ndarray, telling: np.ndarray, k: int, totals: dict[int, int] | None = None):
        self.terms, self.ids, self.k = terms, ids, k
        standing = np.ones(len(ids))
        for y, n in (totals or {}).items():
            standing[toxic == y] = n / max(1, (toxic == y).sum())
        self.idf = np.log((n_docs + 1) / (corpus_df + 1)) + 1
        self.tell = np.full(len(terms), -1)
        self.tell[telling] = np.arange(len(telling))
        self.tell_idf = self.idf[telling]
        every = [self.vector(t, c) for t, c in vectors]
        told = [self.told(t, c) for t, c in vectors]
        # the driver builds the lists; what is spread out for reading is so in the workers alone
        self.every = Index(ids, toxic, every, len(terms), k, standing, spread=False)
        self.at = np.flatnonzero([len(t) > 0 for t, _ in told])
        self.index = Index(self.at, toxic[self.at], [told[i] for i in self.at], len(telling), k, standing[self.at], spread=False)
        bare = np.array([len(t) == 0 for t, _ in every], bool)
        self.none = float(((toxic * standing)[bare].sum() + 0.5) / (standing[bare].sum() + 1)) if bare.any() else 0.5
        del self.every.rows, self.index.rows  # the postings hold them
        self.steps = _isotonic(np.zeros(0), np.zeros(0), np.zeros(0))

    def votes(self, low: int, high: int) -> list[tuple[int, float]]:
        """(position, vote) of the examples from ``low`` to ``high``, each left out of its own vote; those with neighbours."""
        every, told = self.every.vectors(), self.index.vectors()
        place = {int(i): j for j, i in enumerate(self.at)}
        none = np.zeros(0, np.int64), np.zeros(0, np.float32)
        found = ((i, self.vote(every[i], told[place[i]] if i in place else none, i, place.get(i, -1))) for i in range(low, high))
        return [(i, vote) for i, (vote, pos, _) in found if len(pos)]

    def calibrate(self, at: np.ndarray, votes: np.ndarray) -> None:
        self.steps = _isotonic(votes, self.every.toxic[at], self.every.standing[at])

    def vector(self, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(counts)) * (self.idf if idf is None else idf)[terms]
        return terms, (x / np.sqrt((x * x).sum())).astype(np.float32) if len(x) else x.astype(np.float32)

    def told(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vector over the telling words alone."""
        t = self.tell[terms]
        return self.vector(t[t >= 0], counts[t >= 0], self.tell_idf)

    def vote(self, every: tuple, told: tuple, leave: int = -1, leave_told: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """(vote, positions and similarities of the nearest over all terms)."""
        pos, sim = self.every.nearest(*every, leave)
        if not len(pos):
            return 0.0, pos, sim
        copies = sim >= COPY
        if copies.any():
            return self.every.vote(pos[copies], np.ones(copies.sum())), pos, sim
        whole, part = self.every.vote(pos, sim * sim), 0.0
        if len(told[0]):
            p, s = self.index.nearest(*told, leave_told)
            part = self.index.vote(p, s) if len(p) else 0.0
        return WHOLE * whole + (1 - WHOLE) * part, pos, sim

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list, list]:
        """(probability, neighbours' ids, similarities)."""
        vote, pos, sim = self.vote(self.vector(terms, counts), self.told(terms, counts))
        p = float(np.interp(vote, *self.steps)) if len(pos) else self.none
        return p, self.ids[pos[:3]].tolist(), [round(float(s), 6) for s in sim[:3]]


def _isotonic(vote: np.ndarray, seen: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nondecreasing fit by pooling, each pool drawn a little to one half; as points to interpolate."""
    if not len(vote):
        return np.array([0.0, 1.0]), np.array([0.05, 0.95])
    order = np.argsort(vote, kind="stable")
    pools: list[list[float]] = []
    for v, y, w in zip(vote[order], seen[order], weight[order], strict=True):
        pools.append([y * w, w, v])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            b = pools.pop()
            a = pools[-1]
            a[2] = (a[2] * a[1] + b[2] * b[1]) / (a[1] + b[1])
            a[0] += b[0]
            a[1] += b[1]
    x = np.array([p[2] for p in pools])
    y = np.array([(p[0] + 0.25) / (p[1] + 0.5) for p in pools])
    return x, np.maximum.accumulate(y)


def informative(toxic: np.ndarray, signature: np.ndarray, words: list[np.ndarray], most: int | None = None, chance: float = 0.01) -> np.ndarray:
    """Hashes of the words over-represented among toxic examples, the surest first."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, one = np.unique(np.stack([signature, toxic.astype(np.uint64)]), axis=1, return_index=True)
    rate = toxic[one].mean()
    if not 0 < rate < 1:
        return np.zeros(0, np.uint64)
    keys, inverse = np.unique(np.concatenate([words[i] for i in one]), return_inverse=True)
    label = np.repeat(toxic[one], [len(words[i]) for i in one])
    n = np.bincount(inverse, minlength=len(keys))
    p = np.clip(np.bincount(inverse, label, len(keys)) / n, 1e-12, 1 - 1e-12)
    surprise = n * (p * np.log(p / rate) + (1 - p) * np.log((1 - p) / (1 - rate)))
    tried = max(1, int((n >= 3).sum()))
    good = np.flatnonzero((p > rate) & (n >= 3))
    good = good[np.lexsort((keys[good], -surprise[good]))]
    # step-up rule: of the surest k, at most the share ``chance`` may be there by chance
    passes = np.flatnonzero(surprise[good] >= np.log(tried / (chance * np.arange(1, len(good) + 1))))
    return keys[good[: passes[-1] + 1 if len(passes) else 0][:most]]


def _sample(labels: DataFrame, examples: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id and toxic of the sample, number of usable labelled rows by label)."""
    known = labels.where((fold(F.col("doc_id")) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select("doc_id", "toxic", doc_hash(F.col("doc_id")).alias("h"))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    part = lambda y: by_hash(known.where(F.col("toxic") == y), "h", examples, total.get(y, 0))
    return part(1).unionByName(part(0)).select("doc_id", "toxic"), total


def learn(docs: DataFrame, labels: DataFrame, *, examples: int = 4000, k: int = 15) -> Model:
    """A model from at most ``examples`` rows of each label outside fold 0, and counts over all documents."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            w = Words(*text_bytes(batch.column("text")))
            row, h, n = _term_counts(w)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            at, grams = w.grams(3)
            sign = np.full(batch.num_rows, 0, np.uint64)
            np.maximum.at(sign, w.row, w.hash & np.uint64(0xFFFF))  # texts without three-word runs
            first = np.full(batch.num_rows, ~np.uint64(0))
            np.minimum.at(first, w.row[at], grams)
            sign = np.where(first == ~np.uint64(0), sign, first)
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(kind)))
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(sign.view(np.int64)), lists(h.view(np.int64), np.int64), lists(n, np.int32)], names=["doc_id", "toxic", "sign", "words", "counts"])

    sample, totals = _sample(labels, examples)
    chosen = F.broadcast(sample)  # at most twice ``examples`` rows of two numbers
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "text")
    t = rows.mapInArrow(vectors, "doc_id bigint, toxic int, sign bigint, words array<bigint>, counts array<int>").toArrow()
    ids, toxic, sign = t["doc_id"].to_numpy(), t["toxic"].to_numpy(), t["sign"].to_numpy().view(np.uint64)
    values = [(c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in t["words"].chunks if len(c)]
    terms = np.unique(np.concatenate([np.unique(v[o[0] : o[-1]]) for v, o in values])) if values else np.zeros(0, np.uint64)
    counts = [c.values.to_numpy()[a:b] for c in t["counts"].chunks for a, b in zip(c.offsets.to_numpy()[:-1], c.offsets.to_numpy()[1:], strict=True)]
    words = (v[a:b] for v, o in values for a, b in zip(o[:-1], o[1:], strict=True))
    vectors_ = [(np.searchsorted(terms, h).astype(np.int32), c.copy()) for h, c in zip(words, counts, strict=True)]
    del t, values, counts, words  # the driver holds the sample once
    pa.default_memory_pool().release_unused()
    order = np.argsort(ids, kind="stable")
    ids, toxic, sign, vectors_ = ids[order], toxic[order], sign[order], [vectors_[i] for i in order]
    telling = informative(toxic, sign, [v for v, _ in vectors_])
    df, n = _corpus_counts(docs, terms)
    model = Model(ids, toxic, vectors_, df, n, terms, telling, k, totals)
    del vectors_
    if len(ids):
        at, votes = _votes(docs.sparkSession, model, len(ids))
        model.calibrate(at, votes)
    _give_back()
    return model


def _give_back() -> None:
    """Return what the sample took to the system, where the C library can: many small arrays leave its heap in pieces."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def _votes(spark, model: Model, n: int, at_once: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Leave-one-out votes of the examples, made on the executors: (positions, votes), at most one for each example."""
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column("id").to_numpy()
            found = held.value.votes(int(i[0]), int(i[-1]) + 1) if len(i) else []
            at, votes = zip(*found, strict=True) if found else ((), ())
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(votes, pa.float64())], names=["at", "vote"])

    t = spark.range(0, n, 1, -(-n // at_once)).mapInArrow(run, "at bigint, vote double").toArrow().sort_by("at")
    held.unpersist()
    return t["at"].to_numpy(), t["vote"].to_numpy()


def _corpus_counts(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and how many documents there are."""
    if not len(terms):
        return np.zeros(0), 0
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, df, n = Table(held.value), np.zeros(len(held.value), np.int64), 0
        for batch in chunks(batches):
            w = Words(*text_bytes(batch.column("text")))
            at, term = table.find(w.hash)
            pair = np.unique(w.row[at] * np.int64(len(df)) + term)
            df += np.bincount(pair % len(df), minlength=len(df))
            n += batch.num_rows
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.r_[-1, some]), pa.array(np.r_[n, df[some]])], names=["term", "n"])

    t = docs.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term
    term, n = t["term"].to_numpy(), t["n"].to_numpy()
    out = np.zeros(len(terms))
    out[term[term >= 0]] = n[term >= 0]
    total = int(n[term < 0].sum())
    return out, total


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, neighbours, similarities for every row of ``docs``.

    Null and empty texts and those without a word of the examples get the toxic rate of examples
    without words; repeated rows get equal scores; an empty table gives no rows; other columns are
    not read. Ties among neighbours go to the example of the least id.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        table = Table(model.terms)
        for batch in chunks(batches):
            w = Words(*text_bytes(batch.column("text")))
            at, term = table.find(w.hash)
            width = max(1, len(model.terms))
            pair, count = np.unique(w.row[at] * np.int64(width) + term, return_counts=True)
            ends = np.searchsorted(pair // width, np.arange(batch.num_rows + 1))
            found = [model.score((pair[a:b] % width), count[a:b]) if b > a else (model.none, [], []) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            p = [x[0] for x in found]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array([x[2] for x in found], pa.list_(pa.float64()))],
                names=["doc_id", "score", "predicted", "neighbours", "similarities"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, neighbours array<bigint>, similarities array<double>")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", "neighbours", "similarities")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, with their columns; all where there are no examples."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        table = Table(model.terms)
        width = max(1, len(model.terms))
        for batch in chunks(batches):
            w = Words(*text_bytes(batch.column(batch.schema.get_field_index("text"))))
            at, term = table.find(w.hash)
            pair, count = np.unique(w.row[at] * np.int64(width) + term, return_counts=True)
            ends = np.searchsorted(pair // width, np.arange(batch.num_rows + 1))
            keep = [not len(model.ids) or (model.score(pair[a:b] % width, count[a:b])[0] if b > a else model.none) < 0.5 for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
