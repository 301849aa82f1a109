"""Personal data: fixed rules, and candidates judged by gradient-boosted trees.

Rules find e-mail addresses, IP addresses, payment cards and phone numbers; what they find is
always reported. High-recall generators propose further, overlapping spans (addresses written
with "at" and "dot", defanged IP addresses, digit groups with other separators, numbers without
a country code). Boosted trees score a candidate by its format and context; the threshold of
each kind is the lowest at which a calibration set keeps ``precision``; of overlapping accepted
candidates the likeliest stays.

The trees learn from a bounded sample of documents. What the rules find there is known to be
personal data: it counts as it stands, and again in a disguise, in its own context. Other candidates
of the sample are unlabelled and count as wrong with a small weight only, since real disguised data
is among them. Written examples, right and wrong, in words of the sample fill up what it lacks.

Patterns start only where a run starts, so the time is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import by_hash, doc_hash
from lattica.llm.textvec import chunks

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BYTES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|\b(?:dot|at)\b", re.I)
#: Weight of a candidate of which nothing is known.
UNLABELLED = 0.2
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """What the rules find, leftmost and without overlap in a kind, by start and kind."""
    found, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > last and text[a - 1] in _LOCAL_BYTES:
                a -= 1
            if a < m.start():
                found.append((a, 0, m.end()))
                last = m.end()
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


_AT = r"(?:\x20?[\[(]at[\])]\x20?|\x20at\x20|\x20?@\x20?)"
_DOT = r"(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)"
_GENERATORS = (
    (0, re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}", re.I)),
    (1, re.compile(r"(?<![0-9])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\.)\x20?[0-9]{1,3}){3}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{2,6}(?:[\x20._/-]?[0-9]{2,6}){2,5}(?![0-9])")),
    (3, re.compile(r"(?<![0-9A-Za-z])(?:00|\(?\+?)?[0-9]{1,4}\)?(?:[\x20./()-]{1,2}[0-9]{2,5}){1,5}(?![0-9A-Za-z])")),
)
#: Fixed words that stand near personal data, and near other numbers.
_NEAR = ("mail", "contact", "phone", "tel", "call", "mobile", "fax", "card", "visa", "iban", "pay", "ip", "host", "server", "address")
_FAR = ("version", "license", "token", "key", "password", "id", "order", "page", "isbn", "date", "sha", "hash")


def candidates(text: str) -> list[Span]:
    if not _ANY.search(text):
        return []
    return sorted({(m.start(), k, m.end()) for k, g in _GENERATORS for m in g.finditer(text)})


def features(text: str, span: Span) -> list[float]:
    a, kind, b = span
    body, before, after = text[a:b], text[max(0, a - 24) : a], text[b : b + 12]
    d = _digits(body)
    words = re.findall(r"[a-z]+", before.lower())
    parts = re.findall(r"[0-9]+", body)
    years = len(parts) == 3 and any(len(p) == 4 and p[0] in "12" for p in parts)
    tail = re.search(r"([A-Za-z]+)$", body)
    return [
        kind, len(body), len(d), len(parts), max(map(len, parts), default=0), min(map(len, parts), default=0),
        max((int(p) for p in parts if len(p) < 7), default=0), luhn(d) if d else 0, body.startswith("+") or body.startswith("00"), "(" in body, "@" in body,
        bool(re.search(r"[\[(](?:at|dot|\.)[\])]", body, re.I)), len(re.findall(r"\bat\b|\bdot\b", body, re.I)), body.count("."), body.count("-"), body.count(" "), body.count("/"),
        len(set(re.findall(r"[^0-9A-Za-z]", body))), years, len(tail[1]) if tail else 0,
        bool(before) and before[-1].isalnum(), bool(after) and after[0].isalnum(), bool(before) and before[-1] in "\"'=#._/-", bool(after) and after[0] in "\"'._/-",
        any(w.startswith(n) for w in words for n in _NEAR), any(w.startswith(n) for w in words for n in _FAR),
    ]


@dataclass
class Trees:
    """Boosted trees of depth 3 as arrays: feature and limit of 7 nodes, value of 8 leaves."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.limit, self.value, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(3):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - 7]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    """Logistic boosting with second-order gains over at most 32 limits a feature."""
    limits = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
    width = max(map(len, limits)) + 1
    bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(limits, x.T, strict=True)], axis=1)
    shape = (x.shape[1], width)
    flat = bins + np.arange(x.shape[1]) * width
    good = (y * weight).sum()
    start = float(np.log((good + 1) / (weight.sum() - good + 1)))
    margin, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        node, feature, limit = np.zeros(len(y), int), np.zeros(7, int), np.full(7, np.inf)
        for n in range(7):
            at = np.flatnonzero(node == n)
            if len(at) > 8:
                sums = [np.cumsum(np.bincount(flat[at].ravel(), np.repeat(w[at], shape[0]), shape[0] * width).reshape(shape), axis=1) for w in (g, h)]
                total = [w[at].sum() for w in (g, h)]
                gain = sums[0] ** 2 / (sums[1] + ridge) + (total[0] - sums[0]) ** 2 / (total[1] - sums[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
                f, b = np.unravel_index(np.argmax(gain), shape)
                if gain[f, b] > 1e-6 and b < len(limits[f]):
                    feature[n], limit[n] = f, limits[f][b]
            node[at] = 2 * n + 1 + (x[at, feature[n]] > limit[n])
        leaf = node - 7
        value = rate * np.bincount(leaf, g, 8) / (np.bincount(leaf, h, 8) + ridge)
        margin += value[leaf]
        trees.append((feature, limit, value))
    return Trees(*(np.array([t[i] for t in trees]) for i in range(3)), start)


@dataclass
class Model:
    trees: Trees
    thresholds: np.ndarray  # margin for each kind

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """The base spans, and accepted candidates that overlap none of them nor each other."""
        taken = _Taken((a, b) for a, _, b in base)
        free = [s for s in candidates(text) if taken.free(s)]
        found = []
        if free:
            m = self.trees.margin(np.array([features(text, s) for s in free], float))
            good = [(-v, s) for v, s in zip(m, free, strict=True) if v >= self.thresholds[s[1]]]
            for _, s in sorted(good):
                if taken.free(s):
                    taken.add(s[0], s[2])
                    found.append(s)
        return sorted(base + found)


class _Taken:
    """Intervals that are apart, by start."""

    def __init__(self, spans):
        self.low, self.high = [], []
        for a, b in sorted(spans):
            if self.high and a < self.high[-1]:
                self.high[-1] = max(self.high[-1], b)
            else:
                self.low.append(a)
                self.high.append(b)

    def free(self, s: Span) -> bool:
        i = bisect_right(self.high, s[0])
        return i == len(self.low) or self.low[i] >= s[2]

    def add(self, a: int, b: int) -> None:
        i = bisect_left(self.low, a)
        self.low.insert(i, a)
        self.high.insert(i, b)


def _written(rng: np.random.Generator, kind: int, good: bool) -> str:
    """One example of a kind, or something that its generator proposes wrongly."""
    pick = lambda *x: x[rng.integers(len(x))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    if kind == 0:
        if good:
            at, dot = pick((" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), (" @ ", "."))
            return word(rng.integers(2, 9)) + pick("", ".", "_") + pick("", num(2)) + at + word(rng.integers(3, 9)) + dot + pick("com", "org", "net", "example" + dot + "com", "de", "fr")
        return word(rng.integers(1, 7)) + " at " + word(rng.integers(1, 8)) + "." + pick(word(rng.integers(1, 7)).title(), num(1), word(7))
    if kind == 1:
        if good:
            sep = pick("[.]", "(.)", " . ", "[.]")
            return sep.join(str(n) for n in rng.integers(1, 256, 4))
        return ".".join(str(n) for n in rng.choice([rng.integers(256, 999), rng.integers(0, 9), rng.integers(300, 999), 400], 4))
    if kind == 2:
        d = pick("4", "51", "37") + num(13 + rng.integers(0, 2))
        d += next(c for c in "0123456789" if luhn(d + c)) if good else pick(*[c for c in "0123456789" if not luhn(d + c)])
        sep = pick(".", "_", "/") if good else pick("", " ", "-", ".")
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if good or sep else d
    if good:
        return pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"00{num(2)} {num(3)} {num(6)[:3]} {num(4)}", f"0{num(3)}/{num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}")
    return pick(f"20{num(2)}-0{num(1)}-1{num(1)}", f"{num(2)}.{num(2)}.19{num(2)}", f"{num(1)}.{num(2)}", f"{num(2)} {num(2)}", f"{num(3)} {num(3)}", f"{num(4)}-{num(4)}", f"{num(2)}:{num(2)} {num(2)}", f"{num(5)} {num(5)} {num(5)}")


def disguise(rng: np.random.Generator, kind: int, body: str) -> str:
    """Personal data that a rule found, written so that the rule doesn't find it."""
    pick = lambda *x: x[rng.integers(len(x))]
    digits = _digits(body)
    if kind == 0:
        at, dot = pick((" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."), (" @ ", "."))
        local, _, domain = body.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return body.replace(".", pick("[.]", "(.)", " . "))
    if kind == 2:
        sep = pick(".", "_", "/")
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return pick(f"00{digits[:2]} {digits[2:5]} {digits[5:8]} {digits[8:]}", f"({digits[:3]}) {digits[3:6]}-{digits[6:10]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:10]}", f"{digits[:3]}.{digits[3:6]}.{digits[6:10]}")


Example = tuple[list[float], bool, float]  # features, personal data, weight


def _around(text: str, lead: int, body: str, kind: int, good: bool) -> Iterator[Example]:
    """What the generators propose at ``body``, which stands at ``lead``: right if it is the whole of it."""
    for s in candidates(text):
        if s[0] < lead + len(body) and s[2] > lead:
            yield features(text, s), good and s == (lead, kind, lead + len(body)), 1.0


def examples_of(text: str, rng: np.random.Generator, most: int) -> list[Example]:
    """A document's examples; of other candidates than the rules' at most ``most``, from anywhere in it."""
    out, base = [], base_spans(text)
    for a, kind, b in base:
        body, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 40]
        for x in (body, disguise(rng, kind, body)):
            out += (e for e in _around(before + x + after, len(before), x, kind, True) if e[1] or x != body)
    taken = _Taken((a, b) for a, _, b in base)
    other = [s for s in candidates(text) if taken.free(s)]
    if len(other) > most:
        other = [other[i] for i in np.sort(rng.choice(len(other), most, replace=False))]
    return out + [(features(text, s), False, UNLABELLED) for s in other]


def fit(rows: list[Example], words: list[str], *, written: int = 6000, precision: float = 0.98, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    words, rows = words or ["text"], list(rows)
    for i in range(written):
        kind, good = i % 4, bool(i // 4 % 2)
        body = _written(rng, kind, good)
        lead = " ".join(words[j] for j in rng.integers(0, len(words), 4))
        cue = rng.integers(3)
        lead += " " + (str(rng.choice(_NEAR if good else _FAR)) + str(rng.choice([" ", ": ", " = "])) if cue == 0 else "")
        rows += _around(lead + body + str(rng.choice([" ", ". ", ", ", "\n"])) + words[rng.integers(len(words))], len(lead), body, kind, good)
    x, y, weight = (np.array(v, float) for v in zip(*rows, strict=True))
    held = rng.random(len(y)) < 0.3
    trees = boost(x[~held], y[~held], weight[~held])
    margin, limits = trees.margin(x[held]), np.full(4, np.inf)
    for k in range(4):
        mine = x[held][:, 0] == k
        order = np.argsort(-margin[mine], kind="stable")
        w = weight[held][mine][order]
        ok = np.flatnonzero(np.cumsum(y[held][mine][order] * w) / np.cumsum(w) >= precision)
        if len(ok):
            limits[k] = max(0.0, margin[mine][order][ok[-1]])
    return Model(trees, limits)


def learn(docs: DataFrame, *, contexts: int = 1000, per_document: int = 200) -> Model:
    """Trees fitted on at most ``contexts`` documents, by hash of the id.

    A document of the sample gives all that the rules find in it, and at most ``per_document`` other
    candidates and 20 words, from its whole text; these come to the driver, the texts don't.
    """
    known = docs.where(F.col("text").isNotNull())
    sample = by_hash(known.select("doc_id", doc_hash(F.col("doc_id")).alias("h")), "h", contexts, known.count())
    top = sample.agg(F.max("h")).first()[0]
    some = known.select("doc_id", "text", doc_hash(F.col("doc_id")).alias("h")).where(F.col("h") <= (-1 if top is None else top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            for text, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist(), strict=True):
                rng = np.random.default_rng(h)
                rows, words = examples_of(text, rng, per_document), text.split()
                x, y, w = zip(*rows, strict=True) if rows else ((), (), ())
                flat = np.array(x, float).ravel()
                some_words = [words[i][:40] for i in rng.integers(0, len(words), min(20, len(words)))]
                yield pa.record_batch([pa.array([h]), pa.array([flat]), pa.array([[bool(v) for v in y]], pa.list_(pa.bool_())), pa.array([list(w)], pa.list_(pa.float64())), pa.array([some_words], pa.list_(pa.string()))], names=["h", "x", "y", "w", "words"])

    found = some.select("text", "h").mapInArrow(run, "h bigint, x array<double>, y array<boolean>, w array<double>, words array<string>").collect()
    rows, words = [], []
    for r in sorted(found, key=lambda r: (r["h"], r["words"], r["x"])):
        n = len(r["y"])
        rows += zip(np.array(r["x"], float).reshape(n, -1).tolist() if n else [], r["y"], r["w"], strict=True)
        words += r["words"]
    return fit(rows, words)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the rules' counts, base_sha256 and all spans, for every row of ``docs``.

    Positions are code points, ends are exclusive. Null and empty texts have no spans; at equal
    starts spans go by kind as listed; repeated rows get equal spans; an empty table gives no
    rows; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in chunks(batches):
            base, every = [], []
            for t in batch.column("text").to_pylist():
                b = base_spans(t) if t and _ANY.search(t) else []
                base.append(b)
                every.append(model.spans(t, b) if t else [])
            count = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(4)]
            sha = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string())
            yield pa.record_batch([batch.column("doc_id"), *count, sha, pa.array(map(_joined, every), pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are one."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
