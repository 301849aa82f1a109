"""The array forms of words and n-grams, and the operators built on them, against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import decontaminate, fingerprint, language_id, pii, queries, simhash, textvec, token_output, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())


def words(text):
    return re.findall(r"[^\W_]+", "".join(c.lower() if c.isascii() else c for c in text))


def test_words_and_grams_as_in_python():
    texts = ["The cat, THE dog", "", None, "a" * 70_000 + " b", "x y"]
    w = textvec.Words(*textvec.text_bytes(pa.array(texts)))
    named = {}
    for i, (r, h) in enumerate(zip(w.row, w.hash, strict=True)):
        named.setdefault(int(h), set()).add(words(texts[r])[i - int(w.bounds()[r])])
    assert all(len(v) == 1 for v in named.values())
    assert np.bincount(w.row, minlength=5).tolist() == [len(words(t or "")) for t in texts]
    assert w.hash[0] == w.hash[2] == textvec.hash_words(["the"])[0]
    at, h = w.grams(2)
    assert [w.row[i] for i in at] == [0, 0, 0, 3, 4] and len(set(h.tolist())) == 5


def test_table_finds_what_is_there():
    rng = np.random.default_rng(1)
    keys, probe = rng.integers(0, 2**63, 500, np.uint64), rng.integers(0, 2**63, 2000, np.uint64)
    probe[::7] = keys[rng.integers(0, 500, len(probe[::7]))]
    at, k = textvec.Table(keys).find(probe)
    assert at.tolist() == [i for i, p in enumerate(probe) if p in set(keys.tolist())]
    assert (keys[k] == probe[at]).all()


# 2 tokens


def test_ids_equal_the_library(docs):
    texts = [r["text"] for r in docs.limit(60).collect()] + ["", "it's 's x'rex  \n\n a\n b \t c'd 12½²", "'", "' s", "a<|endoftext|>b", "😀　é́ don't'll", " \r\n x"]
    e = token_output.Encoder(VOCABULARY)
    got, at = e.encode(texts, 2)
    for i, x in enumerate(e.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert got[at[i] : at[i + 1]].tolist() == [*x.ids, 2], texts[i]


def test_pre_tokens_as_the_pattern():
    import regex

    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice("ab 's1.é\n\t ½tvelmdr") for _ in range(30))
        start = token_output.pre_tokens(np.frombuffer(t.encode("utf-32-le"), np.uint32), np.array([0]))
        assert start.tolist() == [m.start() for m in pattern.finditer(t)], repr(t)


def test_token_files(spark, odd_docs, no_docs):
    rows = token_output.positions(token_output.write_tokens(odd_docs, VOCABULARY)).orderBy("start").collect()
    tk, at = Tokenizer.from_file(VOCABULARY), 0
    tk.encode_special_tokens = True
    source = sorted((r["doc_id"], r["text"] or "") for r in odd_docs.collect())
    for r, (i, t) in zip(rows, source, strict=True):
        x = np.array([*tk.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    assert token_output.positions(token_output.write_tokens(no_docs, VOCABULARY)).count() == 0


def test_token_file_layout(spark, docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    df = token_output.tokenized(docs.limit(50), VOCABULARY, 2)
    df.write.options(**{k: str(v) for k, v in token_output.OPTIONS.items()}).parquet(f"{tmp_path}/t")
    meta = pq.ParquetFile(sorted(glob.glob(f"{tmp_path}/t/*.parquet"))[0]).metadata
    col = meta.row_group(0).column(4)
    assert col.path_in_schema.startswith("ids") and col.has_offset_index and "RLE_DICTIONARY" in col.encodings and col.compression == "ZSTD"


# 3 fingerprints


def jaccard(a, b):
    row, term, n = fingerprint.terms([a, b])
    x, y = (collections.Counter(dict(zip(term[row == k].tolist(), n[row == k].tolist(), strict=True))) for k in (0, 1))
    return sum((x & y).values()) / sum((x | y).values())


def test_collisions_follow_generalised_jaccard():
    rng, gaps = random.Random(5), []
    for _ in range(60):
        base = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(120)]
        other = list(base)
        for i in range(rng.randrange(1, 60)):
            other[rng.randrange(120)] = f"z{i}"
        a, b = " ".join(base * 2), " ".join(other)
        s = fingerprint.signatures([a, b])
        gaps.append(float(fingerprint._likeness(s[:1], s[1:])[0]) - jaccard(a, b))
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.08


def test_edited_texts(spark, odd_docs, no_docs):
    got = collections.defaultdict(list)
    for r in fingerprint.compare_edited(odd_docs).collect():
        got[r["doc_id"]].append(r)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd_docs.collect()), key=lambda x: (-x[0], x[1]))
    assert sum(map(len, got.values())) == len(rows)
    for k, (i, t) in enumerate(rows):
        n, following = len(t), rows[(k + 1) % len(rows)][1]
        edited = t[: n - n // 2] + following[: n // 2]
        r = [x for x in got[i] if x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()]
        assert r and r[0]["n_chars"] == n
    by_text = collections.defaultdict(set)
    for i, t in rows:
        by_text[t] |= {x["fingerprint"] for x in got[i]}
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprint.compare_edited(no_docs).count() == 0
    alone = fingerprint.compare_edited(odd_docs.where("doc_id = 8")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_near_edited_beats_next(spark, sf):
    r = queries.op3_fingerprints(spark, sf).agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("int")), F.avg("near_next")).first()
    assert r[0] > 0.97 and r[1] < 0.02


# 4 simhash


def brute_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(pairs):
    """doc -> smallest doc reachable, of (doc, fingerprint)."""
    parent = {i: i for i, _ in pairs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in pairs:
        for b, y in pairs:
            if a < b and (x ^ y).bit_count() <= 3:
                a1, b1 = find(a), find(b)
                parent[max(a1, b1)] = min(a1, b1)
    return {i: find(i) for i in parent}


def test_simhash_against_all_pairs(spark, docs, odd_docs, no_docs):
    for df in (docs, odd_docs.dropDuplicates(["doc_id"])):
        rows = df.select("doc_id", "text").collect()
        fps = [(r["doc_id"], brute_simhash(r["text"])) for r in rows]
        want = brute_components(fps)
        got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
        assert {i: got[i]["fingerprint"] for i in got} == {i: f"{f:016x}" for i, f in fps}
        assert {i: got[i]["component_id"] for i in got} == want
    assert simhash.near_duplicates(odd_docs).count() == odd_docs.count()
    assert simhash.near_duplicates(no_docs).count() == 0
    assert ids(simhash.one_of_each(odd_docs)) == sorted(set(brute_components([(r["doc_id"], brute_simhash(r["text"])) for r in odd_docs.dropDuplicates(["doc_id"]).collect()]).values()))


@pytest.mark.parametrize("large", [4096, 16])
def test_links_connect_dense_and_sparse_cells(spark, monkeypatch, large):
    """Every link's ends are near, and what is near is connected, in small cells and in cut ones."""
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")).collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 3 for r in found)
    parent = {f: f for f in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in found:
        parent[find(r["a"] % 2**64)] = find(r["b"] % 2**64)
    want = brute_components(list(enumerate(sorted(fps))))
    order = sorted(fps)
    assert all((find(order[i]) == find(order[j])) == (want[i] == want[j]) for i in range(0, len(order), 7) for j in range(len(order)))


def brute_alike(rows):
    """doc -> smallest doc reachable over five-word Jaccard of 0.8 or more."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while True:
        before = dict(root)
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return root


def test_one_of_each_drops_near_copies(spark, docs):
    """Five words and 0.8 in the pipeline, also where 64 bits are far apart."""
    want = brute_alike([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: r["component_id"] for r in simhash.alike(docs).collect()} == want
    assert ids(simhash.one_of_each(docs)) == sorted(set(want.values()))
    assert len(set(want.values())) < len({r["component_id"] for r in simhash.near_duplicates(docs).collect()})


def test_a_large_group_of_near_copies_is_one(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 64)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.alike(df).collect()} == brute_alike(rows)


# 8 decontamination


def test_planted_passages_are_found(spark, docs, no_docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    rng, rows = random.Random(1), []
    base = [r["text"] for r in docs.limit(60).collect()]
    for k, r in enumerate(bench.orderBy("item_id").limit(30).collect()):
        w = r["text"].split()
        if k % 3 == 1:  # every sixth word another one
            w = [f"new{i}" if i % 6 == 5 else x for i, x in enumerate(w)]
        if k % 3 == 2:  # some words left out
            w = [x for i, x in enumerate(w) if i % 9 != 8]
        t = base[k].split()
        cut = rng.randrange(len(t) + 1)
        rows.append((10_000 + k, " ".join([*t[:cut], *w, *t[cut:]]), r["item_id"]))
    made = spark.createDataFrame(rows, "doc_id bigint, text string, item bigint")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(made, bench).collect()}
    assert {(i, j) for i, _, j in rows} <= set(got)
    assert all(0.5 <= r["score"] <= 1 for r in got.values()) and all(got[i, j]["score"] == 1.0 for k, (i, _, j) in enumerate(rows) if k % 3 == 0)
    assert decontaminate.contaminated(no_docs, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def brute_align(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_by_rows_equals_the_recurrence():
    rng = np.random.default_rng(4)
    a, b = rng.integers(1, 6, (40, 12)).astype(np.uint64), rng.integers(1, 6, (40, 30)).astype(np.uint64)
    assert decontaminate.align(a, b)[0].tolist() == [brute_align(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]


def test_whole_search_against_all_alignments(spark, docs, sf):
    """No document that any item aligns with at the least score is missed; no other is reported."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    some = docs.where("length(text) < 2500").limit(60)
    want = set()
    for r in some.collect():
        w = words(r["text"])
        for b in bench:
            v = words(b["text"])
            if len(set(v) & set(w)) * 3 >= len(set(v)) and brute_align(v, w) >= len(v):
                want.add((r["doc_id"], b["item_id"]))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(some, spark.createDataFrame(bench)).collect()}
    assert got == want


def test_clean_keeps_columns(spark, odd_docs, sf):
    out = decontaminate.clean(odd_docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()


def test_a_common_passage_has_seeds(spark):
    item = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(i, f"a{i} {item} b{i}" if i % 3 else f"only {i} here") for i in range(90)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    assert ids(decontaminate.contaminated(rows, bench)) == [i for i in range(90) if i % 3]


# 1 toxicity


def test_index_is_exact():
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(400):
        t = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        x = rng.random(len(t)) + 0.1
        rows.append((t, (x / np.linalg.norm(x)).astype(np.float32)))
    toxic = rng.integers(0, 2, 400)
    ix = toxicity.Index(np.arange(400), toxic, rows, 60, 9)
    dense = np.zeros((400, 60), np.float32)
    for i, (t, x) in enumerate(ix.rows):
        dense[i, t] = x
    for t, x in rows[:60]:
        q = np.zeros(60, np.float32)
        q[t] = x
        sims = dense @ q
        pos, sim = ix.nearest(t, x)
        best = np.sort(sims)[::-1][:9]
        assert np.allclose(sim, best[best > 0][:9], atol=1e-5)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = queries.op1_toxicity(spark, sf).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    rank = r["score"].rank()
    pos = int(r["toxic"].sum())
    auc = (rank[r["toxic"] == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(r) - pos))
    assert auc > 0.93 and (r["predicted"] == r["toxic"]).mean() > 0.97


def test_toxicity_odd_input(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(1, 10)] + [(4, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.learn(odd_docs, labels)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert toxicity.score(no_docs, model).count() == 0
    none = toxicity.learn(no_docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd_docs, none).collect()} == {0.5}
    assert toxicity.reject(odd_docs, model).columns == odd_docs.columns


def test_copies_lend_no_weight():
    words_ = [np.array([1, 2, 3], np.uint64)] * 30 + [np.array([5], np.uint64)] * 30
    toxic, sign = np.array([1] * 30 + [0] * 30), np.array([7] * 30 + list(range(30)), np.uint64)
    assert len(toxicity.informative(toxic, sign, words_, 10)) == 0


def test_a_copy_of_a_toxic_example_without_telling_words(spark):
    """Neighbours are over all words: what equals a labelled example has its label, what is near it finds it."""
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(40))
    rows = [(i, text()) for i in range(200)]
    labels = spark.createDataFrame([(i, 0, int(i % 9 == 0)) for i in range(200)], "doc_id bigint, quality int, toxic int")
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 0 and i % 9 == 0]
    docs = spark.createDataFrame(rows + [(1000 + i, rows[i][1]) for i in held] + [(2000 + i, rows[i][1] + " more words") for i in held], "doc_id bigint, text string")
    model = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[k + i]["neighbours"][0] == i for i in held for k in (1000, 2000))
    plain = np.mean([got[i]["score"] for i in range(200) if i % 9])
    assert all(got[1000 + i]["score"] > plain and got[1000 + i]["similarities"][0] > 0.999 for i in held)


def test_without_labels_nothing_is_rejected(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.reject(odd_docs, toxicity.learn(odd_docs, none)).count() == odd_docs.count()


def test_postings_are_exact():
    rng = np.random.default_rng(8)
    dense = rng.random((90, 50)).astype(np.float32) * (rng.random((90, 50)) < 0.2)
    rows = [(np.flatnonzero(x), x[x > 0]) for x in dense]
    index = toxicity.Postings(rows, 50)
    for i, (t, x) in enumerate(rows):
        sims = dense @ dense[i]
        sims[i] = 0
        pos, sim = index.nearest(t, x, 9, i)
        best = np.sort(sims)[::-1][:9]
        assert np.allclose(sim, best[best > 0], atol=1e-5) and np.allclose(sims[pos], sim, atol=1e-5)


# 5 language


def test_language_held_out(spark, docs, sf):
    r = queries.op5_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert r.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_odd_input(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in language_id.predict(odd_docs, language_id.learn(odd_docs)).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 9)] == ["und"] * 4 and got[1]["score"] == 0
    assert got[5]["lang_pred"] in ("en", "de") and 0 < got[5]["score"] <= 1
    assert language_id.predict(no_docs, language_id.learn(no_docs)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd_docs, language_id.learn(no_docs)).collect()} == {"und"}


def test_presence_products_equal_the_kernel():
    """Scores by one product are those of the kernel with the landmarks."""
    texts = ["the cat sat", "the dog ran", "der hund lief", "die katze sass"]
    m = language_id.fit(texts, ["en", "en", "de", "de"], 2, 1e-3)
    x = language_id.presence(*language_id.points_of(pa.array(texts))).astype(float)
    k = (x @ x.T) / np.sqrt(np.outer(x.sum(1), x.sum(1)))
    margins = m.margins(*language_id.points_of(pa.array(texts)))
    # margins lie in the span of the kernel's columns, plus the bias
    fit = np.linalg.lstsq(k, margins - m.bias, rcond=None)[0]
    assert np.allclose(k @ fit + m.bias, margins, atol=1e-4) and [m.languages[i] for i in margins.argmax(1)] == ["en", "en", "de", "de"]


# 7 personal data

RULES = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_rules(text):
    out = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if (True, k == 1 and all(int(p) <= 255 for p in m[0].split(".")), 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_rules_in_linear_time_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(2000):
        t = "".join(rng.choice("1234567890 .-+()@ab") for _ in range(40))
        assert pii.base_spans(t) == plain_rules(t), t
    pii.base_spans("a" * 300_000 + "1" * 300_000 + "@" * 1000 + "+1 " * 50_000)


def test_added_spans_and_odd_input(spark, odd_docs, no_docs, docs):
    model = pii.learn(docs)
    for text, kind in (("mail bob at example dot com now", 0), ("call (312) 555-0199 today", 3), ("ip 10[.]0[.]0[.]1 x", 1)):
        spans = model.spans(text, pii.base_spans(text))
        assert [s[1] for s in spans] == [kind] and pii.redact(text, spans).count("[") == 1
    for text in ("on 2024-05-11 we met", "License, version 3.0", "token = 04dbebab91ab85687d33", "page 12 of 400"):
        assert model.spans(text, []) == []
    got = {r["doc_id"]: r for r in pii.find(odd_docs, model).collect()}
    assert got[1]["spans"] == "" and got[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[5]["n_phone"] == 0
    assert pii.find(no_docs, model).count() == 0


def test_pii_on_documents(spark, docs):
    model = pii.learn(docs)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.find(docs, model).collect():
        base = plain_rules(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii._joined(base).encode()).hexdigest()
        assert set(filter(None, pii._joined(base).split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == i for b in base) for i in range(4)]


