"""Ids that many rows share, or lack: order, spread over tasks, and reads of single documents."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import fingerprint, token_output

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def hot(spark):
    """A third without an id, a third on one id (half of it equal rows), and single ids."""
    rng = random.Random(1)
    text = lambda i: f"text {i} " + "w " * rng.randrange(6)
    rows = [(None, text(i)) for i in range(200)] + [(7, "equal rows" if i % 2 else text(i)) for i in range(200)] + [(i * 3, text(i)) for i in range(-100, 100)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)


def test_edited_texts_of_a_chain(spark, hot):
    """Every document is followed by one of the next id, or of its own; each text follows exactly once."""
    rows = [(r["doc_id"], r["text"]) for r in hot.collect()]
    got = fingerprint.compare_edited(hot).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in rows)
    by_id = collections.defaultdict(list)
    for i, t in rows:
        by_id[i].append(t)
    order = sorted((i for i in by_id if i is not None), reverse=True) + [None]
    seen = collections.Counter()
    for k, i in enumerate(order):
        after = order[(k + 1) % len(order)]
        edits = {hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest() for t in by_id[i] for u in by_id[i] + by_id[after]}
        mine = [r for r in got if r["doc_id"] == i]
        assert all(r["edited_sha256"] in edits for r in mine)
        seen[i] = len(mine)
    assert seen == collections.Counter(i for i, _ in rows)


def test_hot_ids_are_ranges_of_their_own(spark, hot):
    rows = fingerprint.with_next(hot).where("guest = 0").groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).collect()
    assert sum(r["n"] for r in rows) == 600 and max(r["n"] for r in rows) < 150
    assert fingerprint.with_next(hot).where("guest = 1").count() == len(rows)


def test_token_files_deal_hot_ids(spark, hot, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows are one partition
    try:
        tokens = token_output.write_tokens(hot, VOCABULARY, path=f"{tmp_path}/t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["n"] for r in tokens.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 600 and max(sizes) < 300
    tk = Tokenizer.from_file(VOCABULARY)
    tk.encode_special_tokens = True
    want = collections.Counter((i, zlib.crc32(np.array([*tk.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in ((r["doc_id"], r["text"]) for r in hot.collect()))
    rows = token_output.positions(tokens).orderBy("start").collect()
    assert collections.Counter((r["doc_id"], r["ids_crc32"]) for r in rows) == want
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]


def test_selective_reads(spark, hot, tmp_path):
    tokens = token_output.write_tokens(hot, VOCABULARY, path=f"{tmp_path}/t")
    one = token_output.tokens_of(tokens, [9])
    assert one.count() == hot.where("doc_id = 9").count() and one.first()["ids"][-1] == 2
    plan = one._jdf.queryExecution().toString()
    assert "In(doc_id, [9])" in plan or "EqualTo(doc_id,9)" in plan
    plan = token_output.metadata(tokens)._jdf.queryExecution().toString()
    assert "ids" not in plan[plan.index("ReadSchema") :]
