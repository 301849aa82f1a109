"""The k-d tree against plain medians; rows with repeated ids, without ids and with any column names."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import mixing, sharding, simhash


def brute_tree(rows, leaves, first=0, keep=0.05):
    """{place: shard} of dicts of size, id_key and dimensions, by sorting along the widest dimension."""
    if leaves == 1 or not rows:
        return {r["place"]: first for r in rows}
    total, half = sum(r["size"] for r in rows), leaves // 2
    goal, leaf = total * half / leaves, total / leaves
    width = [np.ptp([r[d] >> sharding.KEY_BITS - sharding.RANGE_BITS for r in rows]) for d in sharding.DIMENSIONS]
    axis = sharding.DIMENSIONS[int(np.argmax(width))]

    def cut(groups, base):
        """Which of the groups' keys go left, and the group at the goal."""
        left = set()
        for k in sorted(groups):
            size = sum(r["size"] for r in groups[k])
            if base + size >= goal:
                if base + size - goal <= goal - base:
                    left.add(k)
                return left, k, base, size
            left.add(k)
            base += size
        return left, None, base, 0

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[axis]].append(r)
    left, at, base, size = cut(groups, 0)
    if size > leaf * keep and len(groups[at]) > 1:
        inner = collections.defaultdict(list)
        for r in groups[at]:
            inner[r["id_key"]].append(r)
        some, *_ = cut(inner, base)
        on_left = lambda r: r[axis] < at or r[axis] == at and r["id_key"] in some
    else:
        on_left = lambda r: r[axis] in left
    parts = [r for r in rows if on_left(r)], [r for r in rows if not on_left(r)]
    return brute_tree(parts[0], half, first, keep) | brute_tree(parts[1], leaves - half, first + half, keep)


def corpus(rng, n):
    for i in range(n):
        if i % 3 == 0:
            yield None if i % 2 else i, "the same text in a third of all rows"
        elif i % 7 == 0:
            yield 5, f"copy {i % 5} " * (1 + i % 5)
        else:
            yield i, " ".join(rng.choice(["a", "word", "é漢", "longerword"]) for _ in range(rng.randrange(80)))


@pytest.mark.parametrize("shards", [1, 2, 5, 24])
def test_tree_equals_plain_medians(spark, shards):
    df = spark.createDataFrame(list(corpus(random.Random(shards), 900)), "doc_id bigint, text string")
    sized, _ = sharding._prepared(df)
    rows = [r.asDict() | {"place": i} for i, r in enumerate(sized.collect())]
    assert len({r["id_key"] for r in rows}) == len(rows)
    root = sharding.kd_tree(sized, shards, slack=0.0)
    got = sized.withColumn("shard", sharding._label(root, lambda n: F.lit(n.first))).collect()
    want = brute_tree(rows, shards)
    key = lambda r: (r["id_key"], r["length"])
    assert {key(r): r["shard"] for r in got} == {key(r): want[r["place"]] for r in rows}


def test_shards_of_rows_without_ids_are_even(spark):
    df = spark.createDataFrame([(None, "same text again") for _ in range(2400)], "doc_id bigint, text string")
    rows = sharding.shard(df, rows_per_task=30).collect()
    count = collections.Counter(r["shard"] for r in rows)
    assert set(count) == set(range(24)) and max(count.values()) <= 1.1 * min(count.values())
    assert {(r["shard"], r["slot"]) for r in rows} == {(s, i) for s, n in count.items() for i in range(n)}


def test_small_groups_of_equal_texts_stay_whole(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "concat('text ', cast(id / 3 as int), repeat(' w', cast(id / 3 as int) % 50)) as text")
    rows = sharding.shard(df).collect()
    shards = collections.defaultdict(set)
    for r in rows:
        shards[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


def test_mix_takes_rows_without_ids_one_by_one(spark):
    """Targets are met in sources whose rows share an id, have none, or are all equal."""
    rows = [(None, f"w {i}", "none") for i in range(1000)] + [(7, f"w {i}", "one") for i in range(1000)] + [(None, "w w", "equal") for _ in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for r in mixing.mix(df).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r["taken"] - r["target"]) <= 3
    sums = {r["source"]: r["n"] for r in mixing.mixed_rows(df).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    target = {r["source"]: r["target"] for r in mixing.targets(df.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("source_size"))).collect()}
    assert all(abs(sums[s] - target[s]) <= 3 for s in target)


NAMES = ["_h", "_n", "_copy", "_source", "_times", "_cut", "h", "n", "times", "cut", "row", "key", "name", "rank", "part", "place", "tie", "keep", "gone_id", "gone_tie", "_gone_id", "same", "shard_", "id_key", "length", "script", "words", "a.b"]


@pytest.fixture
def clashing(spark):
    fields = ", ".join(f"`{n}` string" for n in NAMES)
    rows = [(i, f"text {i} " + "w " * (i % 9), "s", *[f"{n}{i}" for n in NAMES]) for i in range(40)]
    return spark.createDataFrame(rows + rows[:2], f"doc_id bigint, text string, source string, {fields}")


def test_columns_of_any_name_are_kept(spark, clashing):
    for out in (mixing.mixed_rows(clashing), simhash.one_of_each(clashing), sharding.sharded_rows(clashing).drop("shard", "slot")):
        assert out.columns == clashing.columns
        for r in out.collect():
            assert all(r[n] == f"{n}{r['doc_id']}" for n in NAMES)


def test_one_of_each_loses_no_text(spark):
    """Different texts on one id or none stay; equal rows stand once; copies go whatever their ids."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "first text of one"), (1, "second text, another one"), (None, "third has no id"), (None, "fourth has no id either"), (2, long), (3, long), (None, long + " end"), (2, long), (4, None), (4, ""), (None, None)]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    texts = collections.Counter((r["doc_id"], r["text"]) for r in out)
    assert max(texts.values()) == 1
    assert {t for _, t in texts if t and t.startswith(("first", "second", "third", "fourth"))} == {t for _, t in rows[:4]}
    assert [(i, t) for i, t in texts if t and t.startswith("w0")] == [(2, long)]
    assert sum(not t for _, t in texts) == 1 and (4, None) in texts or (4, "") in texts


def test_a_bound_by_points_loses_no_pair():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 4000, np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (4000, 5)).astype(np.uint64), axis=1)
    b = a ^ flips
    far = np.bitwise_count(a ^ b)
    plain = np.abs(np.stack([np.bitwise_count(x[:, None] >> np.arange(0, 64, 2, dtype=np.uint64) & np.uint64(3)).astype(int) for x in (a, b)]))
    assert (np.bitwise_count(simhash.embed(a) ^ simhash.embed(b)) == np.abs(plain[0] - plain[1]).sum(axis=1)).all()
    assert (np.bitwise_count(simhash.embed(a) ^ simhash.embed(b)) <= far).all()
    assert simhash._near(a, b, simhash.embed(a), simhash.embed(b), 3).tolist() == np.flatnonzero(far <= 3).tolist()


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_any_number_of_blocks_gives_the_same_components(spark, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "BLOCKS", ((blocks, 1 << 64),))
    rng = random.Random(9)
    base = [rng.getrandbits(62) for _ in range(40)]
    fps = sorted({b ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for b in base for _ in range(4)} | set(base))
    found = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"))).collect()
    root = {f: f for f in fps} | {r["node"]: r["root"] for r in found}
    near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    assert near and all(root[a] == root[b] for a, b in near) and len(set(root.values())) == len(base)


def test_the_pipeline_keeps_one_of_each_simhash_component(spark):
    """Components of the stage are op4's, also where ids are shared or missing; no text beyond 3 bits goes."""
    import corpus_pipeline

    rng = random.Random(4)
    long = [f"w{rng.randrange(400)}" for _ in range(300)]
    near = [*long[:-1], "other"]
    far = [w if rng.random() < 0.5 else f"f{rng.randrange(400)}" for w in long]
    texts = [" ".join(w) for w in (long, near, far)]
    rows = [(5, texts[0]), (None, texts[1]), (3, texts[0]), (3, texts[2]), (None, "one of none"), (None, "another of none"), (3, texts[2]), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    fps = {r["doc_id"]: int(r["fingerprint"], 16) for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert (fps[0] ^ fps[1]).bit_count() <= 3 < (fps[0] ^ fps[2]).bit_count()
    out = corpus_pipeline.simhash_stage(spark, df, "").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out if r["text"]) == sorted([("3", texts[0]), ("3", texts[2]), ("None", "one of none"), ("None", "another of none")])
    assert [r["doc_id"] for r in out if not r["text"]] == [8]


def test_few_copies_are_sharded_without_a_table_of_their_texts(spark, monkeypatch):
    from lattica.llm import common

    names = []
    monkeypatch.setattr(common, "written", lambda df, name, written=common.written, **o: (names.append(name), written(df, name, **o))[1])
    df = spark.range(24_000).selectExpr("id div 2 as doc_id", "concat('text ', id div 2, repeat(' w', cast(id div 2 as int) % 50)) as text").union(spark.range(2400).selectExpr("null", "'same text again'"))
    rows = sharding.sharded_rows(df).collect()
    size = collections.Counter()
    for r in rows:
        size[r["shard"]] += len(r["text"]) + 8
    assert max(size.values()) < 1.03 * min(size.values()) and len(size) == 24
    count = collections.Counter(r["shard"] for r in rows)
    assert {(r["shard"], r["slot"]) for r in rows} == {(s, i) for s, n in count.items() for i in range(n)} and len(rows) == 26_400
    assert "equal-rows" in names  # the 2,400 are numbered
    names.clear()
    sharding.sharded_rows(df.where("doc_id is not null"), 4).collect()
    assert names and "equal-rows" not in names
