"""The block-max index with and without blocks left out, weights of the sample, labels in any size."""

import pickle
import random

import numpy as np
import pytest

from lattica.llm import toxicity


def rows_of(rng, n, terms, groups):
    out = []
    for i in range(n):
        near = rng.choice(terms // groups, rng.integers(1, 9), replace=False) + (i % groups) * (terms // groups)
        t = np.unique(np.r_[near, rng.integers(0, terms, 2)])
        x = rng.random(len(t)) + 0.1
        out.append((t, (x / np.linalg.norm(x)).astype(np.float32)))
    return out


@pytest.mark.parametrize("opened", [1, 8, 1000])
def test_blocks_left_out_hold_no_neighbour(monkeypatch, opened):
    monkeypatch.setattr(toxicity, "OPENED", opened)
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rows = rows_of(np.random.default_rng(1), 500, 120, 12)
    index = toxicity.Postings(rows, 120)
    dense = np.zeros((500, 120))
    for i, (t, x) in enumerate(rows):
        dense[i, t] = x
    left_out = []
    read = index._read
    index._read = lambda run, w, wanted, *more: (left_out.append((~wanted).sum()), read(run, w, wanted, *more))[1]
    for i in range(0, 500, 5):
        sims = dense @ dense[i]
        sims[i] = 0
        pos, sim = index.nearest(*rows[i], 9, i)
        best = np.lexsort((np.arange(500), -sims.round(12)))[:9]
        assert np.allclose(sim, sims[best][sims[best] > 0], atol=1e-6) and np.allclose(sims[pos], sim, atol=1e-6)
    assert opened > 900 or any(left_out)


def test_ties_go_to_the_least_position():
    index = toxicity.Postings([(np.array([0]), np.array([1.0], np.float32))] * 300, 1)
    assert index.nearest(np.array([0]), np.array([1.0]), 5)[0].tolist() == [0, 1, 2, 3, 4]


def test_a_smaller_sample_gives_like_scores(spark):
    """Examples stand for all labelled rows of their label, so scores don't rise with a bounded sample."""
    rng = random.Random(2)

    def text(toxic):
        return " ".join(rng.choice(["bad", "worse"]) if toxic and rng.random() < 0.2 else f"w{rng.randrange(300)}" for _ in range(40))

    rows = [(i, text(i % 10 == 0)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 10 == 0)) for i in range(3000)], "doc_id bigint, quality int, toxic int")
    scores = []
    for n in (4000, 150):
        r = toxicity.score(docs, toxicity.learn(docs, labels, examples=n)).where("held_out").toPandas()
        toxic = r["doc_id"] % 10 == 0
        scores.append((r[toxic]["score"].mean(), r[~toxic]["score"].mean()))
        assert r[toxic]["predicted"].mean() > 0.9 and r[~toxic]["predicted"].mean() < 0.03
    assert abs(scores[0][1] - scores[1][1]) < 0.05


@pytest.mark.parametrize("common, least, block, opened", [(1 / 128, 4, 8, 2), (2, 64, 8, 1), (0, 1, 16, 3)])
def test_lists_as_matrix_rows_are_the_same(monkeypatch, common, least, block, opened):
    """Some, none or all lists spread out, also after the way to a worker."""
    for k, v in (("COMMON", common), ("LEAST", least), ("BLOCK", block), ("OPENED", opened)):
        monkeypatch.setattr(toxicity, k, v)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(400):
        t = np.unique(np.r_[rng.choice(60, rng.integers(1, 9)), 60 + rng.integers(0, 300, 4)])
        x = rng.random(len(t)) + 0.1
        rows.append((t, (x / np.linalg.norm(x)).astype(np.float32)))
    index = pickle.loads(pickle.dumps(toxicity.Postings(rows, 360)))
    assert (len(index.common) > 0) == (common < 1) and len(index.common) <= 360
    dense = np.zeros((400, 360))
    for i, (t, x) in enumerate(rows):
        dense[i, t] = x
    for i in range(0, 400, 3):
        sims = dense @ dense[i]
        sims[i] = 0
        pos, sim = index.nearest(*rows[i], 9, i)
        best = np.sort(sims)[::-1][:9]
        assert np.allclose(sim, best[best > 0], atol=1e-6) and np.allclose(sims[pos], sim, atol=1e-6)


def test_an_index_without_examples():
    pos, sim = toxicity.Postings([], 5).nearest(np.array([1]), np.array([1.0]), 3)
    assert not len(pos) and not len(sim)


@pytest.mark.parametrize("part", [1, 3, 64])
def test_products_take_a_few_rows_of_the_matrix_at_once(monkeypatch, part):
    """However many of a text's terms are common, no more than PART rows are copied."""
    monkeypatch.setattr(toxicity, "PART", part)
    monkeypatch.setattr(toxicity, "LEAST", 1)
    rng = np.random.default_rng(6)
    index = toxicity.Postings(rows_of(rng, 300, 60, 3), 60)
    slots, weights = np.arange(len(index.common)), rng.random(len(index.common)).astype(np.float32)
    assert len(slots) > 10 and len(index.part) == min(part, len(slots))
    assert np.allclose(index._product(slots, weights), weights @ index.common, atol=1e-5)
    assert not index._product(slots[:0], weights[:0]).any()
