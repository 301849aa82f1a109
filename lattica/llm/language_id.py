"""Language identification by a blended-spectrum string kernel.

A text is the set of its n-grams of 1 to ``longest`` code points, in lower case; the kernel of
two texts is the number of n-grams in both over the geometric mean of their set sizes. Kernel
ridge regression against Nystroem landmarks, one versus rest, is fitted on a bounded sample of
labelled texts (``landmarks + training`` per language). The feature map of a text is
``K(x, landmarks) @ K(landmarks, landmarks)^(-1/2)``; as K(x, landmarks) is the presence vector
times the landmarks' presence matrix, the two products of scoring are taken in the other order:
batches of presence rows times one matrix of n-grams by languages. The model's size depends on
the landmarks alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import doc_hash
from lattica.llm.textvec import Table, chunks, mix64
from lattica.llm.toxicity import fold

LONGEST = 3
BATCH = 64
PIECE = 1 << 18


def points_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, and where each begins."""
    strings = [t or "" for t in pc.utf8_lower(texts.cast(pa.large_string())).to_pylist()]
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([0, *map(len, strings)])


def spectrum(points: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """The distinct n-grams of one text: 21 bits for each code point, mixed by a bijection, so no two are one.

    A long text is taken in pieces that overlap by an n-gram; what is kept is their union."""
    found = np.zeros(0, np.uint64)
    for a in range(0, max(1, len(points)), PIECE):
        p = points[a : a + PIECE + longest - 1].astype(np.uint64) + np.uint64(1)
        key, parts = p, [p]
        for n in range(2, longest + 1):
            key = (key[: max(0, len(p) - n + 1)] << np.uint64(21)) | p[n - 1 :]
            parts.append(key)
        found = np.unique(np.concatenate([found, *parts]))
    return mix64(found)


def _spectra(points: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    return [spectrum(points[a:b]) for a, b in zip(begins[:-1], begins[1:], strict=True)]


def presence(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One row for each text, one column for each n-gram that any of them holds."""
    spectra = _spectra(points, begins)
    grams = np.unique(np.concatenate([*spectra, np.zeros(0, np.uint64)]))
    return _presence(spectra, Table(grams), len(grams))[0]


def _presence(spectra: list[np.ndarray], known: Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(one row for each text: 1 where it holds a known n-gram; number of all its n-grams)."""
    out = np.zeros((len(spectra), width), np.float32)
    size = np.fromiter(map(len, spectra), np.int64, len(spectra))
    at, column = known.find(np.concatenate(spectra)) if size.sum() else (np.zeros(0, np.int64),) * 2
    out[np.repeat(np.arange(len(spectra)), size)[at], column] = 1
    return out, size


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # the landmarks' n-grams
    weights: np.ndarray  # n-grams of the landmarks x languages
    bias: np.ndarray
    sharpness: float

    def margins(self, points: np.ndarray, begins: np.ndarray, known: Table | None = None) -> np.ndarray:
        """``known``: the table of ``grams``, which a caller with many batches makes once."""
        x, size = _presence(_spectra(points, begins), known or Table(self.grams), len(self.grams))
        return (x @ self.weights) / np.sqrt(np.maximum(1, size))[:, None] + self.bias

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        z = np.exp(self.sharpness * (margins - margins.max(axis=1, keepdims=True)))
        return z / z.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], landmarks: int, ridge: float) -> Model:
    """Texts in a fixed order; the first ``landmarks`` of each language are the landmarks."""
    return fit_spectra(_spectra(*points_of(pa.array(texts, pa.string()))), labels, landmarks, ridge)


def fit_spectra(spectra: list[np.ndarray], labels: list[str], landmarks: int, ridge: float) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros(0), 1.0)
    y = np.array([languages.index(v) for v in labels])
    chosen = np.concatenate([np.flatnonzero(y == c)[:landmarks] for c in range(len(languages))])
    grams = np.unique(np.concatenate([spectra[i] for i in chosen]))
    known = Table(grams)
    base, size = _presence([spectra[i] for i in chosen], known, len(grams))
    base /= np.sqrt(np.maximum(1, size))[:, None]
    kernel = np.concatenate([_presence(spectra[a : a + BATCH], known, len(grams))[0] @ base.T for a in range(0, len(spectra), BATCH)])
    kernel /= np.sqrt(np.maximum(1, [len(s) for s in spectra]))[:, None]
    value, vector = np.linalg.eigh(kernel[chosen].astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # K(landmarks, landmarks)^(-1/2)
    feature = kernel @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # a language has weight by its share no more than any other
    weight = 1.0 / np.bincount(y, minlength=len(languages))[y]
    mean, goal = np.average(feature, axis=0, weights=weight), np.average(target, axis=0, weights=weight)
    centred = feature - mean
    gram = centred.T @ (centred * weight[:, None]) + ridge * np.eye(feature.shape[1])
    beta = np.linalg.solve(gram, centred.T @ ((target - goal) * weight[:, None]))
    fitted = centred @ beta + goal
    weights = (base.T @ (root @ beta)).astype(np.float32)
    # the sharpness under which the training margins are likeliest
    trials = [(-np.log(np.take_along_axis(_soft(s * fitted), y[:, None], 1) + 1e-12).mean(), s) for s in (1, 2, 3, 4, 6, 8)]
    return Model(languages, grams, weights, goal - mean @ beta, float(min(trials)[1]))


def _soft(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def learn(docs: DataFrame, *, landmarks: int = 64, training: int = 192, ridge: float = 1e-3) -> Model:
    """A model from at most ``landmarks + training`` documents of each language outside fold 0.

    The sample goes by hash of the id. Languages are counted without reading texts; then one scan
    fetches the rows of every language under its own threshold, which keeps six standard deviations
    more than are wanted. Texts of any length are taken; their distinct n-grams come to the driver,
    not the texts.
    """
    known = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0)).select("lang", "text", doc_hash(F.col("doc_id")).alias("h"))
    n = landmarks + training
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return fit_spectra([], [], landmarks, ridge)
    top = {lang: int(min(1.0, (n + 6 * n**0.5) / c) * ((1 << 60) - 1)) for lang, c in counts.items()}
    limit = F.create_map(*[x for lang, t in top.items() for x in (F.lit(lang), F.lit(t))])[F.col("lang")]
    some = known.where(F.col("h") <= limit).where(F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = [s.tobytes() for s in _spectra(*points_of(batch.column("text")))]
            yield pa.record_batch([batch.column("lang"), batch.column("h"), pa.array(found, pa.binary())], names=["lang", "h", "grams"])

    rows: dict[str, list] = {}
    for r in sorted(some.mapInArrow(grams, "lang string, h bigint, grams binary").collect(), key=lambda r: (r["lang"], r["h"], r["grams"])):
        if len(mine := rows.setdefault(r["lang"], [])) < n:
            mine.append(np.frombuffer(r["grams"], np.uint64))
    return fit_spectra([t for mine in rows.values() for t in mine], [lang for lang, mine in rows.items() for _ in mine], landmarks, ridge)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0; ties go to the language that
    comes first; repeated rows get equal predictions; an empty table gives no rows; without any
    labelled document all are ``und``; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        known = Table(model.grams)
        for part in chunks(batches, size=1 << 18):
            for a in range(0, part.num_rows, BATCH):
                batch = part.slice(a, BATCH)
                text = batch.column("text")
                letter = pc.match_substring_regex(text.fill_null("").cast(pa.large_string()), r"\p{L}").to_numpy(zero_copy_only=False)
                if model.languages:
                    p = model.probabilities(model.margins(*points_of(text), known))
                    best = p.argmax(axis=1)
                    lang = [model.languages[i] if ok else "und" for i, ok in zip(best, letter, strict=True)]
                    score = np.where(letter, p[np.arange(len(best)), best], 0.0)
                else:
                    lang, score = ["und"] * len(letter), np.zeros(len(letter))
                yield pa.record_batch([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
