"""Decontamination against full alignments by edit rate, short items, rows that share an id."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import decontaminate
from lattica.llm.textvec import Words, text_bytes


def words_of(texts):
    w = Words(*text_bytes(pa.array(texts, pa.string())))
    b = w.bounds()
    return [w.hash[x:y] for x, y in zip(b[:-1], b[1:], strict=True)]


def full(docs, items, least=0.5):
    """Pairs of all documents and items by aligning whole texts, without seeds."""
    out, d, v = {}, words_of(docs), words_of(items)
    for j, item in enumerate(v):
        score, _ = decontaminate.align(np.repeat(item[None], len(d), 0), decontaminate._pad(d))
        for i, s in enumerate(score):
            if s >= least * 2 * len(item):
                out[i, j] = s / (2 * len(item))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")


def pairs(df):
    return {(r["doc_id"], r["item_id"]): r["score"] for r in df.collect()}


def edited(rng, words, rate, kind):
    out = []
    for w in words:
        if rng.random() >= rate:
            out.append(w)
        elif kind == "replace":
            out.append(f"n{rng.randrange(10**6)}")
        elif kind == "insert":
            out += [w, f"n{rng.randrange(10**6)}"]
    return out


@pytest.mark.parametrize("kind", ["replace", "drop", "insert"])
def test_every_pair_of_a_full_alignment_is_found(spark, kind):
    """Edit rates of 0 to 40 %, few and many different words: recall is 1."""
    rng = random.Random(kind)
    item_words = [[f"w{rng.randrange(60 if j % 2 else 4000)}" for _ in range(rng.randrange(5, 60))] for j in range(40)]
    docs, rates = [], []
    for k in range(200):
        rate = k % 5 / 10
        filler = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(0, 120))]
        cut = rng.randrange(len(filler) + 1)
        docs.append(" ".join([*filler[:cut], *edited(rng, item_words[k % 40], rate, kind), *filler[cut:]]))
        rates.append(rate)
    items = [" ".join(w) for w in item_words]
    want, got = full(docs, items), pairs(decontaminate.contaminated(*frames(spark, docs, items)))
    assert got == pytest.approx(want)
    for rate in sorted(set(rates)):  # each rate has pairs to find
        assert sum((k, k % 40) in got for k in range(200) if rates[k] == rate) >= 8


def test_third_word_replaced_and_words_put_between(spark):
    item = [f"a{i}" for i in range(30)]
    docs = [" ".join(f"x{i}" if i % 3 == 2 else w for i, w in enumerate(item)), " ".join(x for w in item for x in (w, "and")), "nothing of it"]
    got = pairs(decontaminate.contaminated(*frames(spark, docs, [" ".join(item)])))
    assert set(got) == {(0, 0), (1, 0)} and got[0, 0] == pytest.approx(31 / 60)


def test_short_items_word_for_word(spark):
    items = ["one two three", "漢字", "alone", "four words in here", "", "one two three four five"]
    docs = ["so one, two three!", "one two and three", "x漢字y", "漢 x 字", "All alone.", "four words here in", "one two three four five", None]
    want = {(0, 0), (2, 1), (4, 2), (6, 0), (6, 5), (0, 5), (1, 5)} & set(full([d or "" for d in docs], [i or "zz" for i in items])) | {(0, 0), (2, 1), (4, 2), (6, 0), (6, 5)}
    assert set(pairs(decontaminate.contaminated(*frames(spark, docs, items)))) == want


def test_blocks_of_items_give_the_same(spark):
    rng = random.Random(5)
    items = [" ".join(f"w{rng.randrange(500)}" for _ in range(20)) for _ in range(12)]
    docs = [" ".join([items[k % 12], f"w{k}", items[(k + 5) % 12][:60]]) for k in range(30)]
    d, b = frames(spark, docs, items)
    whole, parts = decontaminate.contaminated(d, b), decontaminate.contaminated(d, b, block_bytes=300)
    assert pairs(whole) == pairs(parts) and len(pairs(whole)) >= 30
    assert decontaminate.clean(d, b).count() == decontaminate.clean(d, b, block_bytes=300).count() == 0


def test_scores_do_not_depend_on_batches(spark):
    rng = random.Random(6)
    items = [" ".join(f"w{rng.randrange(80)}" for _ in range(n)) for n in (8, 15, 70, 400)]
    docs = [" ".join(edited(rng, items[k % 4].split(), 0.2, "replace") + [f"w{rng.randrange(80)}" for _ in range(50)]) for k in range(40)]
    d, b = frames(spark, docs, items)
    want = pytest.approx(full(docs, items))
    assert pairs(decontaminate.contaminated(d.repartition(7), b)) == want and pairs(decontaminate.contaminated(d.coalesce(1), b)) == want


def test_clean_judges_each_row_by_its_text(spark):
    """Rows that share an id, or have none, stand by themselves."""
    item = "one two three four five six seven"
    rows = [(1, "clean words only", "a"), (1, f"before {item} after", "b"), (None, item, "c"), (None, "fine", "d"), (2, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _gone string")
    bench = spark.createDataFrame([("q1", item)], "item_id string, text string")
    assert sorted(r["_gone"] for r in decontaminate.clean(docs, bench).collect()) == ["a", "d", "e"]
    assert [r["item_id"] for r in decontaminate.contaminated(docs, bench).collect()] == ["q1", "q1"]


def test_a_lower_share_has_no_proof(spark):
    with pytest.raises(ValueError):
        decontaminate.contaminated(*frames(spark, ["a"], ["b"]), least=0.3)
