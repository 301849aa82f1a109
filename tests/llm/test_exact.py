"""Words and tokens that hash alike, unhashed n-grams, scripts without spaces."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lattica.llm import fingerprint, language_id, textvec, token_output

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def as_library(encoder, texts):
    got, at = encoder.encode(texts, 2)
    for i, x in enumerate(encoder.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert got[at[i] : at[i + 1]].tolist() == [*x.ids, 2]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_regular_words_do_not_collide(n):
    a = thue_morse(n)
    b = a.translate(str.maketrans("ab", "ba"))
    x, y = textvec.hash_words([a, b])
    assert x != y
    as_library(token_output.Encoder(VOCABULARY), [a, b, a + b])


def test_ids_are_right_under_any_hash(docs, monkeypatch):
    """With five bits of hash nearly all pre-tokens collide."""
    real = token_output._hashes
    monkeypatch.setattr(token_output, "_hashes", lambda *x: real(*x) & np.uint64(31))
    e, texts = token_output.Encoder(VOCABULARY), [r["text"] for r in docs.limit(40).collect()]
    as_library(e, texts)
    as_library(e, texts[::-1])


def test_a_full_table_starts_anew(docs, monkeypatch):
    monkeypatch.setattr(token_output, "KEPT", 50)
    e, texts = token_output.Encoder(VOCABULARY), [r["text"] for r in docs.limit(20).collect()]
    for t in texts:
        as_library(e, [t])


def test_words_of_any_length_hash_by_every_byte():
    rng = random.Random(1)
    words = ["".join(rng.choice("xy") for _ in range(n)) for n in (1, 255, 256, 257, 512, 600_000)]
    more = [w[:k] + ("x" if w[k] == "y" else "y") + w[k + 1 :] for w in words for k in {0, len(w) // 2, len(w) - 1}]
    assert len(set(textvec.hash_words(words + more).tolist())) == len(set(words + more))
    swapped = "a" * 256 + "b" * 256, "b" * 256 + "a" * 256
    assert len(set(textvec.hash_words(list(swapped)).tolist())) == 2


def test_scripts_without_spaces_have_words():
    def count(t):
        return len(textvec.Words(*textvec.text_bytes(pa.array([t]))).hash)

    assert [count(t) for t in ("漢字", "漢字、かな。", "ok漢x", "“quoted” — dash", "é ü ñandú", "ก็", "한국어 말")] == [2, 4, 3, 2, 3, 2, 2]


def test_spectra_are_the_sets_of_n_grams(monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", 7)
    rng = random.Random(2)
    texts = ["", "a", "aB", "".join(rng.choice("abcé漢😀 ") for _ in range(200))]
    plain = [{t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    points, begins = language_id.points_of(pa.array(texts))
    x = language_id.presence(points, begins)
    assert x.sum(axis=1).tolist() == [len(p) for p in plain]
    assert (x @ x.T).tolist() == [[len(p & q) for q in plain] for p in plain]


def test_kernel_ridge_as_by_dense_algebra():
    """Margins of the model equal kernel ridge regression written out with all landmarks."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(w) for _ in range(12)) for w in (("the", "cat", "of", "and"), ("der", "hund", "von", "und"), ("le", "chat", "de", "et")) for _ in range(12)]
    labels = ["en"] * 12 + ["de"] * 12 + ["fr"] * 12
    m = language_id.fit(texts, labels, 6, 1e-2)
    points, begins = language_id.points_of(pa.array(texts))
    x = language_id.presence(points, begins).astype(float)
    x /= np.sqrt(x.sum(axis=1))[:, None]
    y = np.array([m.languages.index(v) for v in labels])
    marks = np.concatenate([np.flatnonzero(y == c)[:6] for c in range(3)])
    value, vector = np.linalg.eigh(x[marks] @ x[marks].T)
    keep = value > 1e-6 * value.max()
    f = x @ x[marks].T @ vector[:, keep] / np.sqrt(value[keep])
    f -= f.mean(axis=0)
    t = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    beta = np.linalg.solve(f.T @ f / 12 + 1e-2 * np.eye(f.shape[1]), f.T @ (t - t.mean(axis=0)) / 12)
    assert np.allclose(f @ beta + t.mean(axis=0), m.margins(points, begins), atol=1e-3)


def plain_likeness(a, b, samples=600):
    """Generalised Jaccard likeness of two texts' terms by a plain sampler: three variates for each term and sample."""

    def sample(text):
        _, term, n = fingerprint.terms([text])
        out = []
        for k in range(samples):
            best = None
            for f, w in zip(term.tolist(), n.tolist(), strict=True):
                rng = random.Random(f * 1000 + k)
                r, c, u = rng.gammavariate(2, 1), rng.gammavariate(2, 1), rng.random()
                t = np.floor(np.log(w) / r + u)
                best = min(best or (np.inf,), (np.log(c) - r * (t - u) - r, f, t))
            out.append(best[1:])
        return out

    return np.mean([x == y for x, y in zip(sample(a), sample(b), strict=True)])


def test_fingerprints_as_by_a_plain_sampler():
    rng = random.Random(4)
    base = [f"w{rng.randrange(30)}" for _ in range(60)]
    for keep in (60, 50, 30):
        other = " ".join(base[:keep] + [f"z{i}" for i in range(60 - keep)])
        s = fingerprint.signatures([" ".join(base), other])
        assert abs(float(fingerprint._likeness(s[:1], s[1:])[0]) - plain_likeness(" ".join(base), other)) < 0.16


@pytest.mark.parametrize("n", [1, 3, 4, 5, 6, 19, 20, 21])
def test_terms_are_alike_at_every_length(n):
    """n words have n terms: those of the runs of five that may begin before the text."""
    assert len(fingerprint.terms([" ".join(f"w{i}" for i in range(n))])[0]) == n


def test_the_least_id_is_not_lost(spark):
    rows = [(-(1 << 62), "a b c"), (None, "d e f"), (5, "g h i")]
    got = fingerprint.compare_edited(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str)
