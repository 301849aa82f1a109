"""SimHash near-duplicates by a popcount embedding.

A 64-bit fingerprint is mapped to a point: the bit counts of its 32 two-bit segments. Flipping
a bit moves one coordinate by at most one, so the Manhattan distance of two points is a lower
bound of the Hamming distance of their fingerprints. The range join "Manhattan distance at most
``reach``" is a grid join: with the axes in blocks, points that near differ in ``reach`` blocks at
most, so a cell is a choice of the other blocks with the point's coordinates there. Pairs in a
cell are held against the Manhattan bound, and what is left is verified on the bits. More blocks
make more and finer cells; their number follows the number of fingerprints, and any gives the
same links.

Copies are one fingerprint from the start. A cell gives links that join what is linked in it,
not all its pairs: each found point absorbs what is near it. Cells that a sixteenth of the
fingerprints shows to be large are first cut by exact runs of bits: of ``reach + 1`` runs, the
differing bits of a pair can touch ``reach``, so one agrees and the pair meets there: nothing is
lost by a cut, and the sample steers only where rows go.

The pipeline keeps one document of each of these components (``near``). Texts alike by five-word shingles,
Jaccard 0.8 or more, lie up to 17 of 64 bits apart, beyond any grid; who wants those takes ``alike``, an
operator of its own: candidates by bands of MinHash values (a pair at 0.8 is missed by all of them once
in 40,000), each checked on the exact sets of shingles. In long runs of a band, what one pass of neighbours left in
different components is compared whole, under a bound that loses no pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import free_name, small, text_key, without, written
from lattica.llm.components import components
from lattica.llm.textvec import BLACK, Words, chunks, mix64, text_bytes

REACH = 3
#: Blocks of axes, and up to how many distinct fingerprints.
BLOCKS = ((6, 1 << 26), (7, 1 << 30), (8, 1 << 64))
LARGE = 4096
SAMPLE = 16
SHINGLE = 5
LIKE = 0.8
BANDS = 20
ROWS = 4
#: Sets of a band that are compared whole, and bits of the bound beyond them.
ALL_PAIRS = 24
BITS = 1024


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, tie (of the text), fp (the 64 bits as bigint). Null text has no words: fingerprint zero."""
    digest = xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, ends = [], [0]
            for text in batch.column("text").to_pylist():
                w = (text or "").encode().lower().split()
                if w:
                    n = min(words, len(w))
                    joined, at, begin = b" ".join(w), 0, []
                    for x in w:
                        begin.append(at)
                        at += len(x) + 1
                    begin.append(at)
                    hashes += [digest(joined[a : b - 1], 42) for a, b in zip(begin, begin[n:], strict=False)]
                ends.append(len(hashes))
            fps = _majority(np.array(hashes, np.uint64), np.array(ends)).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("tie"), pa.array(fps)], names=["doc_id", "tie", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key(F.col("text")).alias("tie"), "text").mapInArrow(run, f"doc_id {kind}, tie bigint, fp bigint")


def _majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ends) - 1, np.uint64)
    full = np.flatnonzero(np.diff(ends))
    step = 1 << 14
    sums = np.zeros((len(full), 64), np.int64)
    rank = np.repeat(np.arange(len(full)), np.diff(ends)[full])
    for a in range(0, len(hashes), step):  # 1 MB of bits at a time
        bits = np.unpackbits(hashes[a : a + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r = rank[a : a + step]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        sums[r[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    over = 2 * sums > np.diff(ends)[full][:, None]
    out[full] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel() if len(full) else 0
    return out


_EVERY = 0x5555555555555555


def _cells(fp: Column, blocks: int, reach: int) -> Column:
    """The grid cells of a fingerprint's point, each as a hash of choice and coordinates."""
    high, every = F.shiftrightunsigned(fp, 1), F.lit(_EVERY)
    two, one = fp.bitwiseAND(high).bitwiseAND(every), fp.bitwiseXOR(high).bitwiseAND(every)
    point = F.shiftleft(two, 1).bitwiseOR(one)  # 32 fields of two bits, each a count of 0 to 2
    cuts = [round(i * 32 / blocks) for i in range(blocks + 1)]
    masks = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = []
    for i, chosen in enumerate(combinations(masks, blocks - reach)):
        m = sum(chosen)
        keys.append(F.xxhash64(F.lit(i), point.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))))
    return F.array(*keys)


def embed(fps: np.ndarray) -> np.ndarray:
    """Points as thermometers: a segment with none, one or two bits is 00, 01 or 11.

    The differing bits of two thermometers are the Manhattan distance of the points."""
    high, every = fps >> np.uint64(1), np.uint64(_EVERY)
    two = fps & high & every
    return (two << np.uint64(1)) | two | ((fps ^ high) & every)


def _near(p: np.ndarray, q, point_p: np.ndarray, point_q, reach: int) -> np.ndarray:
    """Where p and q are within reach: the lower bound first, the bits of what it leaves then."""
    near = np.flatnonzero(np.bitwise_count(point_p ^ point_q) <= reach)
    return near[np.bitwise_count(p[near] ^ (q[near] if np.ndim(q) else q)) <= reach]


def _absorb(rest: np.ndarray, reach: int) -> list[tuple[np.ndarray, np.ndarray]]:
    links, points = [], embed(rest)
    while len(rest) > 1:
        todo, rest, points = [(rest[0], points[0])], rest[1:], points[1:]
        while todo and len(rest):
            q, at = todo.pop()
            near = _near(rest, q, points, at, reach)
            if len(near):
                hit = rest[near]
                links.append((np.full(len(hit), q), hit))
                todo.extend(zip(hit, points[near], strict=True))
                left = np.ones(len(rest), bool)
                left[near] = False
                rest, points = rest[left], points[left]
    return links


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return first, np.diff(np.r_[first, len(keys)])


def _bits(reach: int) -> list[tuple[int, int]]:
    """(shift, mask) of ``reach + 1`` runs of bits: two fingerprints within reach agree in one."""
    cuts = [round(i * 64 / (reach + 1)) for i in range(reach + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _links(keys: np.ndarray, fps: np.ndarray, reach: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links in the runs of equal keys that connect all that is within reach in a run."""
    if len(keys) < 2:
        return []
    first, size = _runs(keys)
    out = []
    for at, n in zip(first[size > 24], size[size > 24], strict=True):
        p = np.unique(fps[at : at + n])
        if len(p) <= LARGE:
            out += _absorb(p, reach)
            continue
        for shift, mask in _bits(reach):
            part = (p >> np.uint64(shift)) & np.uint64(mask)
            order = np.argsort(part, kind="stable")
            q = p[order]
            for a, m in zip(*_runs(part[order]), strict=True):
                out += _absorb(q[a : a + m], reach) if m > 1 else []
    small_runs = np.repeat((size > 1) & (size <= 24), size)
    k, f = keys[small_runs], fps[small_runs]
    points = embed(f)
    for d in range(1, 24):
        if len(k) <= d:
            break
        at = np.flatnonzero(k[d:] == k[:-d])
        at = at[_near(f[at + d], f[at], points[at + d], points[at], reach)]
        out.append((f[at], f[at + d]))
    return out


def links(fps: DataFrame, reach: int = REACH) -> DataFrame:
    """Distinct ``fp`` -> links (a, b) at most ``reach`` bits apart that connect what is connected."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key -> links, a run at a time even across batches."""

        def give(rows):
            found = _links(np.concatenate([x[0] for x in rows]), np.concatenate([x[1] for x in rows]), reach)
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            k, f = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if not len(k):
                continue
            if held and held[-1][0][-1] == k[-1]:
                held.append((k, f))
                continue
            last = int(np.searchsorted(k, k[-1]))
            if last or held:
                yield from give([*held, (k[:last], f[:last])])
            held = [(k[last:], f[last:])]
        if held:
            yield from give(held)

    n = fps.count()
    blocks = next(b for b, most in BLOCKS if n <= most)
    cells = fps.select("fp", F.explode(_cells(F.col("fp"), blocks, reach)).alias("key"))
    hot = cells.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).groupBy("key").count().where(F.col("count") * SAMPLE >= LARGE).select("key")
    hot = written(hot, "simhash-hot")
    n = hot.count()
    if n:
        hot = hot.withColumn("hot", F.lit(True))
        cells = cells.join(F.broadcast(hot) if n <= 100_000 else hot, "key", "left")
        runs = F.array(*[F.xxhash64("key", F.lit(i), F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(mask))) for i, (shift, mask) in enumerate(_bits(reach))])
        cells = cells.select("fp", F.explode(F.when(F.col("hot"), runs).otherwise(F.array("key"))).alias("key"))
    return cells.repartition("key").sortWithinPartitions("key").mapInArrow(join, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, words: int = 3, reach: int = REACH) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``.

    Null, empty and blank texts have fingerprint zero and are linked like any other; texts of
    fewer words than a shingle are one shingle; repeated rows are rows of their own in one
    component; a null id is none of the ids a component is named by; an empty table gives no rows;
    other columns are not read.
    """
    fps = written(fingerprints(docs, words), "simhash-docs")
    found = _classes(fps, F.col("doc_id"), reach).withColumnRenamed("chosen", "component_id")
    return fps.join(found, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def _classes(fps: DataFrame, key: Column, reach: int) -> DataFrame:
    """fp, chosen (the least ``key`` of the component) of each fingerprint that is not of one row alone."""
    groups = fps.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    groups = written(groups, "simhash-groups")
    roots = written(components(links(groups.select("fp"), reach)), "simhash-roots")
    whole = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    least = whole.where("linked").groupBy("root").agg(F.min("first").alias("least"))
    # only what is not alone needs to be joined to the documents
    return whole.where("linked or n > 1").join(least, "root", "left").select("fp", F.coalesce("least", "first").alias("chosen"))


def _row_key() -> Column:
    """Orders the rows of a component: by id, a null one last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")


def near(docs: DataFrame, words: int = 3, reach: int = REACH) -> DataFrame:
    """doc_id, tie, keep for every row of ``docs``: ``keep`` as in ``alike``, components as in ``near_duplicates``."""
    fps = written(fingerprints(docs, words), "simhash-docs")
    found = fps.join(_classes(fps, _row_key(), reach), "fp", "left")
    return found.select("doc_id", "tie", (F.col("chosen").isNull() | (_row_key() == F.col("chosen"))).alias("keep"))


def _shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of ``words`` words; a shorter text is one run of all its words."""
    w = Words(*text_bytes(column), BLACK)
    count = np.bincount(w.row, minlength=w.rows)
    rows, hashes = [], []
    for n in range(1, words + 1):
        at, h = w.grams(n)
        row = w.row[at]
        keep = slice(None) if n == words else count[row] == n
        rows.append(row[keep])
        hashes.append(h[keep])
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(row) else np.zeros(0, bool)
    return row[first], h[first]


def _same(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """A digest of each text's set of shingles; zero without any."""
    out = np.zeros(rows, np.uint64)
    np.add.at(out, row, mix64(h + np.uint64(0x632BE59BD9B4E019)))
    return out.view(np.int64)


def sketches(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, tie (of the text), same (digest of the set of shingles), n (its size), bands (keys of the MinHash bands), bits.

    ``bits`` has the bits that the set's hashes fall on, of BITS: what one set has there and another
    hasn't, is in no intersection.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(5)
        salt, odd = rng.integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
        odd |= np.uint64(1)
        for batch in chunks(batches):
            row, h = _shingles(batch.column("text"), words)
            n = np.bincount(row, minlength=batch.num_rows)
            full = np.flatnonzero(n)
            keys = np.zeros((len(full), BANDS), np.uint64)
            if len(full):
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                for b in range(BANDS):
                    key = np.full(len(full), b + 1, np.uint64)
                    for k in range(b * ROWS, (b + 1) * ROWS):
                        key = mix64(key ^ np.minimum.reduceat((h ^ salt[k]) * odd[k], first))
                    keys[:, b] = key
            bits = np.zeros((batch.num_rows, BITS), bool)
            bits[row, (h >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)] = True
            bits = np.packbits(bits, axis=1)
            bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(n > 0, BANDS, 0))].astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.record_batch([batch.column("doc_id"), batch.column("tie"), pa.array(_same(row, h, batch.num_rows)), pa.array(n.astype(np.int32)), bands, pa.array([x.tobytes() for x in bits], pa.binary())], names=["doc_id", "tie", "same", "n", "bands", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key(F.col("text")).alias("tie"), "text").mapInArrow(run, f"doc_id {kind}, tie bigint, same bigint, n int, bands array<bigint>, bits binary")


def shingle_sets(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """same, set (the hashes of the distinct shingles) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            row, h = _shingles(batch.column("text"), words)
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.record_batch([pa.array(_same(row, h, batch.num_rows)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["same", "set"])

    return docs.select("text").mapInArrow(run, "same bigint, set array<bigint>")


def _neighbours(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> pairs of a run whose sizes allow the likeness.

    Runs of up to ``most`` rows give all pairs. In a longer one each row meets as many that follow it
    in the order, which is another one in each band; ``_apart`` sees to the rest.
    """
    names = ("key", "same", "n")
    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        cols = [np.concatenate([x, batch.column(c).to_numpy().astype(np.int64)]) for x, c in zip(held, names, strict=True)]
        fresh = len(held[0])
        key, same, n = cols
        for d in range(1, min(most, len(key))):
            at = np.flatnonzero((key[d:] == key[:-d]) & (np.minimum(n[d:], n[:-d]) >= LIKE * np.maximum(n[d:], n[:-d])))
            at = at[at + d >= fresh]
            a, b = same[at], same[at + d]
            if len(at):
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        held = [x[max(0, len(key) - most + 1) :] for x in cols]


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block (``outer`` ones, and all) -> pairs of different roots that may be alike.

    A set's elements on bits that the other lacks aren't shared, so the bits bound the intersection from
    above: no pair that is alike is left out.
    """

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        same, n, root = (rows[c].to_numpy() for c in ("same", "n", "root"))
        outer = rows["outer"].to_numpy()
        bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(same), -1)
        inner = np.flatnonzero(~outer)
        for o in np.flatnonzero(outer):
            with_o = inner[root[inner] != root[o]]
            own = np.bitwise_count(bits[o] & ~bits[with_o]).sum(axis=1, dtype=np.int64)
            other = np.bitwise_count(bits[with_o] & ~bits[o]).sum(axis=1, dtype=np.int64)
            shared = np.minimum(n[o] - own, n[with_o] - other)
            good = with_o[shared >= LIKE * (n[o] + n[with_o] - shared)]
            if len(good):
                yield pa.record_batch([pa.array(np.minimum(same[o], same[good])), pa.array(np.maximum(same[o], same[good]))], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                if held and held[-1].column("block")[0].as_py() != block[a]:
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield from pairs(pa.Table.from_batches(held))


def _apart(members: DataFrame, roots: DataFrame, rows: int) -> DataFrame | None:
    """Pairs in long runs that the first pass left unmet and that may be alike: those of different roots.

    ``members``: key, same, n, bits of every row of a long run; ``roots``: node, root. In a run the rows
    outside its largest root meet all rows of other roots, in blocks of ``rows`` by ``rows``. Where a run
    has one root only, nothing is left to do.
    """
    m = members.join(roots, members["same"] == roots["node"], "left").select("key", "same", "n", "bits", F.coalesce("root", "same").alias("root"))
    sizes = m.groupBy("key", "root").agg(F.count("*").alias("in_root"))
    runs = sizes.groupBy("key").agg(F.max(F.struct("in_root", "root")).alias("largest"), F.sum("in_root").alias("all"), F.count("*").alias("roots"))
    runs = runs.where("roots > 1").select("key", F.col("largest.root").alias("most"), F.ceil(F.col("all") / rows).alias("parts"), F.ceil((F.col("all") - F.col("largest.in_root")) / rows).alias("outer_parts"))
    runs = written(runs, "near-runs")
    if not runs.count():
        return None
    m = m.join(small(runs), "key")
    part = lambda n: F.pmod(F.xxhash64("same"), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    inner = m.select("key", "same", "n", "bits", "root", F.lit(False).alias("outer"), part("parts").alias("i"), all_of("outer_parts").alias("j"))
    outer = m.where("root != most").select("key", "same", "n", "bits", "root", F.lit(True).alias("outer"), part("outer_parts").alias("j"), all_of("parts").alias("i"))
    both = inner.unionByName(outer).withColumn("block", F.xxhash64("key", "i", "j")).select("block", "same", "n", "bits", "root", "outer")
    return both.repartition("block").sortWithinPartitions("block").mapInArrow(_between, "a bigint, b bigint").distinct()


def alike(docs: DataFrame, words: int = SHINGLE, *, most: int = ALL_PAIRS, rows_per_block: int = LARGE) -> DataFrame:
    """doc_id, tie, same, component_id, keep for every row: components of texts with Jaccard LIKE or more.

    Texts with one set of shingles (those without words too) are one component. ``keep`` says whether
    the row has the least id of its component (a null one is the greatest), and of those the least
    ``tie``; copies with one id are all kept. Runs of a band of up to ``most`` sets are compared whole,
    longer ones in two passes, of which the second leaves no pair of different components unmet.
    """
    rows = written(sketches(docs, words), "near-docs")
    key = _row_key()
    groups = written(rows.groupBy("same").agg(F.min(key).alias("first"), F.min("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "near-groups")
    cells = groups.select("same", "n", F.explode("bands").alias("key"))
    long = written(cells.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > most), "near-long")
    members = long.count() > 0
    cells = cells.withColumn("turn", F.xxhash64("key", "same"))
    if members:
        members = groups.select("same", "n", "bits", F.explode("bands").alias("key")).join(small(long.select("key")), "key", "left_semi")
        # a key with many rows is dealt in parts, other parts in each band
        hot = long.where(F.col("rows") > LARGE).select("key", F.ceil(F.col("rows") / (LARGE // 2)).alias("parts"))
        cells = cells.join(small(hot), "key", "left").withColumn("key", F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.pmod("turn", "parts"))))
    cells = cells.select("key", "same", "n", "turn").repartition("key").sortWithinPartitions("key", "turn")
    links = written(_alike_of(docs, groups, cells.mapInArrow(lambda b: _neighbours(b, most), "a bigint, b bigint").distinct(), words), "near-links")
    roots = written(components(links), "near-roots")
    if members and (more := _apart(members, roots, rows_per_block)) is not None:
        roots = written(components(links.unionByName(_alike_of(docs, groups, more, words))), "near-roots")
    whole = groups.join(roots, groups["same"] == roots["node"], "left").select("same", "first", F.coalesce("root", "same").alias("root"), F.col("root").isNotNull().alias("linked"))
    least = whole.where("linked").groupBy("root").agg(F.min("first").alias("least"))
    whole = whole.join(least, "root", "left").select("same", F.coalesce("least", "first").alias("chosen"))
    return rows.select("doc_id", "tie", "same").join(whole, "same").select("doc_id", "tie", "same", F.col("chosen.doc_id").alias("component_id"), (key == F.col("chosen")).alias("keep"))


def _alike_of(docs: DataFrame, groups: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b: ``same`` of two groups) that are alike by their exact sets, from one text of each group."""
    pairs = written(pairs, "near-pairs")
    nodes = pairs.select(F.col("a").alias("same")).union(pairs.select("b")).distinct()
    wanted = written(groups.join(small(nodes), "same", "left_semi").select("first.doc_id", "first.tie"), "near-wanted")
    sets = written(shingle_sets(without(docs, wanted, keep=True), words).dropDuplicates(["same"]), "near-sets")
    both = pairs.join(sets.select(F.col("same").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("same").alias("b"), F.col("set").alias("sb")), "b")
    shared = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("m"))
    return shared.where(F.col("m") >= LIKE * (F.col("n") - F.col("m"))).select("a", "b")


def one_of_each(docs: DataFrame, components_of: Callable[[DataFrame], DataFrame] = alike) -> DataFrame:
    """One document of each component of ``alike`` (or ``near``), with its columns: of the rows with its id and text one.

    Different texts that share an id, or have none, are documents of their own. Of rows that are
    equal in id and text and differ in other columns the least row stays.
    """
    found = written(components_of(docs).select("doc_id", "tie", "keep"), "near-rows")
    kept = without(docs, found.where("not keep"))
    twice = found.where("keep").groupBy("doc_id", "tie").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "tie")
    twice = written(twice, "near-twice")
    if not twice.count():
        return kept
    row, tie = free_name(docs, "row"), free_name(docs, "tie")
    repeated = without(kept, twice, keep=True).select(F.struct("*").alias(row)).groupBy(F.col(row)["doc_id"], text_key(F.col(row)["text"]).alias(tie)).agg(F.min(row).alias(row))
    return without(kept, twice).unionByName(repeated.select(f"{row}.*"))
