"""Document fingerprints by consistent weighted sampling.

A text's weighted terms are its runs of five words, by count, of which the first four may begin
before the text (so its first one to four words are terms, and a short text has terms as well); a
text without words is one term. For each of ``SAMPLES``
samples a term has two Gamma(2, 1) variates r and c and a uniform b, drawn by hash from a table
of 2^18 triples; with weight w it has level t = floor(ln w / r + b) and value
ln c - r (t - b) - r. The term and level of the least value are the sample, so two texts agree in
a sample with a probability equal to the generalised Jaccard similarity of their weights.
A fingerprint is 16 bits of each sample, as hexadecimal digits.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import tie_of
from lattica.llm.textvec import Words, chunks, mix64, text_bytes

SAMPLES = 128
WORDS = 5
TABLE_BITS = 18
FEATURE_BITS = 44


@cache
def _variates() -> tuple[np.ndarray, ...]:
    """r, ln c, b of every triple, the value at weight 1 in sortable form, the samples' multipliers."""
    rng = np.random.default_rng(20)
    n = 1 << TABLE_BITS
    r, c, b = rng.gamma(2, 1, n).astype(np.float32), np.log(rng.gamma(2, 1, n)).astype(np.float32), rng.random(n, np.float32)
    return r, c, b, _sortable(c - r * (1 - b)), rng.integers(0, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)


def _sortable(x: np.ndarray) -> np.ndarray:
    """Floats as integers in the same order, in the upper half of 64 bits."""
    i = x.astype(np.float32).view(np.uint32)
    return np.where(i >> np.uint32(31), ~i, i | np.uint32(0x80000000)).astype(np.uint64) << np.uint64(32)


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash of FEATURE_BITS, count) of each text's distinct terms, by row; every row has one."""
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    w = Words(data, offsets)
    at, h = w.grams(WORDS)
    b = w.bounds()
    n, hashes, rows = np.diff(b), [h], [w.row[at]]
    opening = np.full(len(texts), 0x5851F42D4C957F2D, np.uint64)
    for k in range(WORDS - 1):
        long = np.flatnonzero(n > k)
        opening[long] = mix64(opening[long] * np.uint64(0xD6E8FEB86659FD93) + w.hash[b[long] + k])
        hashes.append(opening[long])
        rows.append(long)
    bare = np.flatnonzero(n == 0)
    hashes.append(np.array([xxhash.xxh64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes()) for i in bare], np.uint64))
    row = np.concatenate([*rows, bare]).astype(np.uint64)
    key = (row << np.uint64(FEATURE_BITS)) | (np.concatenate(hashes) >> np.uint64(64 - FEATURE_BITS))
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    count = np.diff(np.r_[first, len(key)])
    key = key[first]
    return (key >> np.uint64(FEATURE_BITS)).astype(np.int64), key & np.uint64((1 << FEATURE_BITS) - 1), count


def signatures(texts: list[str]) -> np.ndarray:
    """Texts x SAMPLES, 16 bits of each sample."""
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    if not texts:
        return out
    r, c, b, at_one, steps = _variates()
    row, feature, count = terms(texts)
    feature = mix64(feature)
    name = feature & np.uint64(0xFFFFFFFF)
    more = np.flatnonzero(count > 1)
    log_w = np.log(count[more]).astype(np.float32)
    first = np.searchsorted(row, np.arange(len(texts)))
    shift = np.uint64(64 - TABLE_BITS)
    for k in range(SAMPLES):
        i = (feature * steps[k]) >> shift
        value = at_one[i]
        value |= name
        if len(more):
            j = i[more]
            t = np.floor(log_w / r[j] + b[j])
            same = mix64(feature[more] ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) & np.uint64(0xFFFFFFFF)
            value[more] = _sortable(c[j] - r[j] * (t - b[j]) - r[j]) | np.where(t == 0, name[more], same)
        out[:, k] = np.minimum.reduceat(value, first) & np.uint64(0xFFFF)
    return out


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _hex(s: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in s.astype(">u2")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, for every row; null counts as empty, equal texts are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=1 << 19):
            s = signatures([t or "" for t in batch.column("text").to_pylist()])
            yield pa.record_batch([batch.column("doc_id"), pa.array(_hex(s), pa.string())], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


#: Stands for a null id: the least bigint, so it is the last by descending id.
NO_ID = -(1 << 63)
OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _whole(quantile: float) -> int:
    """A quantile as a bigint; beyond 2^53 quantiles are near an id, which is enough for a limit."""
    return min(max(int(quantile), NO_ID), (1 << 63) - 1)


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, guest, doc_id, tie, text: ranges of ids, each followed by the first of the next range.

    The rows of a bucket that aren't guests, then the guests, each by descending id and tie, are the
    documents of a range and the one after it (after the last range, the first document). Range
    limits are quantiles of the ids; an id with more rows than a range is ranges of its own, by tie.
    One row, a range's first, is in two ranges. Texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("tie", tie_of(F.col("text")))
    quantiles = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)
    # an id that is several quantiles has more rows than a range: it stands between limits of its own
    cuts = {_whole(q): n + 1 for q, n in Counter(quantiles).items() if n > 1}
    around = [i + d for i in cuts for d in (0, 1) if i + d < 1 << 63]
    limits = np.unique(np.array([*map(_whole, quantiles), *around], np.int64))
    width = max([1, *cuts.values()])

    def bucket(ids: pd.Series, ties: pd.Series) -> pd.Series:
        x, t = ids.to_numpy(), ties.to_numpy()
        out = np.searchsorted(limits, x, "right").astype(np.int64) * width
        for i, n in cuts.items():
            mine = x == i
            place = (t[mine].astype(np.float64) / 2.0**64 + 0.5) * n
            out[mine] += np.clip(place.astype(np.int64), 0, n - 1)
        return pd.Series(out.astype(np.int32))

    bucket_of = F.pandas_udf(bucket, "int")
    top = F.max(F.struct("doc_id", "tie")).alias("first")
    firsts = docs.select("doc_id", "tie", bucket_of("doc_id", "tie").alias("bucket")).groupBy("bucket").agg(top).collect()  # a row for each range
    order = sorted(firsts, key=lambda x: -x["bucket"])
    before = {(x["first"]["doc_id"], x["first"]["tie"]): order[i - 1]["bucket"] for i, x in enumerate(order)}
    ids = np.unique(np.array([i for i, _ in before], np.int64))

    def host(ids_: pd.Series, ties: pd.Series) -> pd.Series:
        x, t = ids_.to_numpy(), ties.to_numpy()
        out = np.full(len(x), -1, np.int32)
        for k in np.flatnonzero(np.isin(x, ids)).tolist():
            out[k] = before.get((int(x[k]), int(t[k])), -1)
        return pd.Series(out)

    placed = docs.select("doc_id", "tie", "text", bucket_of("doc_id", "tie").alias("bucket"), F.pandas_udf(host, "int")("doc_id", "tie").alias("host"))
    at = F.array(F.struct("bucket", F.lit(0).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest")))
    rows = placed.select("doc_id", "tie", "text", F.inline(F.slice(at, 1, F.when(F.col("host") >= 0, 2).otherwise(1))))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc("doc_id"), F.desc("tie"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how near they are.

    The edited text has the first half of the document (the longer half) and as many code points
    from the next document, by descending id, as are replaced. Null text is empty; rows of one id
    follow each other by a hash of their text; a single document is next to itself; a null id comes last, as the
    least bigint (which a real id can't be); an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in chunks(batches, size=1 << 18):
            rows = held + list(zip(*(batch.column(n).to_pylist() for n in ("bucket", "guest", "doc_id", "text")), strict=True))
            pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            held = rows[-1:]
            if not pairs:
                continue
            texts = [r[3] for r in rows]
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in pairs]
            s = signatures(texts + edited)
            own, following, other = s[pairs], s[[i + 1 for i in pairs]], s[len(texts) :]
            yield pa.record_batch(
                [
                    pa.array([rows[i][2] for i in pairs], pa.int64()), pa.array([len(texts[i]) for i in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(_hex(own)), pa.array(_hex(other)),
                    pa.array(_likeness(own, other)), pa.array(_likeness(own, following)),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    found = with_next(docs).select("bucket", "guest", "doc_id", "text").mapInArrow(run, OUT)
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
