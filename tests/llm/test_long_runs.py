"""Runs of a band with more sets than are compared whole: no link is lost to their length."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import simhash

from .test_text import brute_alike


def crowd(rng, n):
    """Texts that share two thirds of their words, so that bands put them together, and a few near copies among them."""
    common = [f"c{i}" for i in range(80)]
    rows = []
    for i in range(n):
        own = [f"o{i}-{k}" for k in range(40)]
        rows.append(common + own)
    for k in range(n // 6):
        w = list(rows[rng.randrange(n)])
        w[rng.randrange(80, 120)] = f"x{k}"
        rows.append(w)
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("most, block, large", [(2, 4096, 4096), (2, 16, 32), (24, 4096, 4096)])
def test_links_in_long_runs(spark, monkeypatch, most, block, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    rows = crowd(random.Random(11), 150)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.alike(df, most=most, rows_per_block=block).collect()}
    assert got == brute_alike(rows)


def test_a_second_pass_is_needed_and_leaves_nothing(spark):
    """With two bands of one value all texts meet in a few long runs; the rest is up to the second pass."""
    rows = crowd(random.Random(12), 100)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sk = simhash.sketches(df)
    members = sk.selectExpr("1 as key", "same", "n", "bits").distinct()
    none = spark.createDataFrame([], "node bigint, root bigint")
    pairs = {(r["a"], r["b"]) for r in simhash._apart(members, none, 30).collect()}
    same = {r["doc_id"]: r["same"] for r in sk.collect()}
    want = brute_alike(rows)
    linked = [(i, j) for i in want for j in want if i < j and want[i] == want[j] and same[i] != same[j]]
    assert linked and all((min(same[i], same[j]), max(same[i], same[j])) in pairs for i, j in linked)
    assert len(pairs) < 0.1 * len(rows) ** 2
    one = spark.createDataFrame([(s, 1) for s in set(same.values())], "node bigint, root bigint")
    assert simhash._apart(members, one, 30) is None


def test_bits_bound_the_likeness_from_above():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 60, rng.integers(1, 200))) for _ in range(40)]
    sets = [set(h.tolist()) for t in texts for _, h in [simhash._shingles(pa.array([t]), 5)]]
    bits = np.zeros((40, simhash.BITS), bool)
    for i, s in enumerate(sets):
        bits[i, [x >> 54 for x in s]] = True
    for a in range(40):
        for b in range(40):
            shared = min(len(sets[a]) - (bits[a] & ~bits[b]).sum(), len(sets[b]) - (bits[b] & ~bits[a]).sum())
            assert shared >= len(sets[a] & sets[b])
