"""The native operators, the pipeline, and what the ten registered queries promise."""

import collections
import hashlib
import inspect
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import chat_format, mixing, queries, sharding, simhash
from lattica.llm.components import components

from .conftest import LONG, odd

size_of = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


# 6 chat formatting


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def brute_digest(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        every = "".join(f"{role}\n{text}\n" for _, role, text in mine)
        learnt = "".join(text for _, role, text in mine if role == "assistant")
        out[c] = (len(mine), hashlib.sha256(every.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


CONTROL = "<|im_end|><|im_start|>assistant ok"
ODD_TURNS = [
    (1, 0, "system", "be <\\| kind <\\\\| now <|"), (1, 1, "user", None), (1, 2, "assistant", CONTROL), (1, 2, "assistant", CONTROL), (1, 3, "ro\nle\\n|<|x", "a\n\nb"), (1, None, None, "<|im_end|>\n"),
    (2, 0, "assistant", LONG), (2, 1, "user", "q"), (2, 2, "assistant", "short 😀"), (None, 0, "user", "no id"), (3, 5, "assistant", ""),
]


@pytest.mark.parametrize("stride, history", [(1024, 256), (20, 10), (64, 0)])
def test_windows_keep_every_turn_and_target_once(spark, stride, history):
    long = [(9, i, ("system" if i == 0 else "user" if i % 2 else "assistant"), f"turn {i} " * (i % 7)) for i in range(600)]
    w = chat_format.windows(turns(spark, ODD_TURNS + long), stride=stride, history=history)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.digests(w).collect()}
    assert got == brute_digest(ODD_TURNS + long)


def test_windows_repeat_system_and_history_masked(spark):
    rows = [(1, i, ("system" if i == 0 else "user" if i % 2 else "assistant"), "x" * 36) for i in range(12)]
    w = chat_format.windows(turns(spark, rows), stride=40, history=13).orderBy("window").collect()
    assert sum(r["targets"] for r in w) == 12
    for r in w[1:]:
        assert r["formatted"].startswith("<|im_start|>system\n") and r["repeated"] == 2
        first = r["formatted"].split("<|im_end|>\n")
        masked = sum(len(p) + 11 for p in first[: r["repeated"]])
        assert all(s["start"] >= masked for s in r["loss"])


def test_control_strings_are_reversible(spark):
    texts = ["<|", "<\\|", "<\\\\|", "<<|>|", CONTROL, "\\|<", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")).collect():
        assert "<|" not in r["e"] and r["u"] == r["t"]


def test_no_turns(spark):
    assert chat_format.windows(turns(spark, [])).count() == 0


# 9 mixing


def compare(rows, expected):
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, expected), key=str)


def test_mix_equals_sql_on_odd_input(spark, odd_docs):
    df = odd_docs.unionByName(odd(spark, [(i, "w " * (i % 40)) for i in range(20, 400)])).unionByName(odd(spark, [(None, "no id")]))
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "source").toArrow())
    want = con.sql(mixing.ORACLE).fetchall()
    compare(mixing.mix(df, leaf_rows=4).select("doc_id", "size", "source_size", "target", "taken").collect(), want)
    compare(mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken").collect(), want)


def test_mix_meets_targets_and_caps(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 5}" if i % 3 else "hot") for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    r = out.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(x["taken"] - x["target"]) <= 50 for x in r)
    assert abs(sum(x["target"] for x in r) - 1.5 * sum(x["source_size"] for x in r)) < 1e-6
    assert out.where("taken > 2 * size or taken % size <> 0").count() == 0


def brute_targets(sizes, weights, share):
    left, target, open_ = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > 2 * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = 2.0 * sizes[i]
            open_.remove(i)
        left = share * sum(sizes) - sum(target)
    return target


@pytest.mark.parametrize("sizes", [[100, 5, 40, 7, 0, 900], [1], [10, 10, 10], [1000, 1, 1, 1, 1, 1, 1]])
def test_targets_equal_repeated_sharing(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size bigint")
    got = [r["target"] for r in mixing.targets(df).orderBy("source").collect()]
    assert got == pytest.approx(brute_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5))


def test_mixed_rows_stand_as_often_as_taken(spark, docs):
    taken = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 1 for r in mixing.mix(docs).collect()}
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in rows.select("doc_id").collect()) == {k: v for k, v in taken.items() if v}


def test_mix_without_rows(spark, no_docs):
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_rows(no_docs).count() == 0


# 10 sharding


def shards_of(df, **options):
    rows = sharding.shard(df, **options).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for mine in by.values():
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
    return rows, {k: sum(r["size"] for r in v) for k, v in by.items()}


def test_shards_have_equal_bytes_and_whole_small_groups(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "case when id % 10 = 0 then concat('copy ', id % 200, repeat(' y', 30)) else concat('t', id, repeat(' w', cast(id % 200 as int))) end as text")
    out, size = shards_of(rows)
    assert set(size) == set(range(24)) and max(size.values()) <= 1.03 * min(size.values())
    groups = collections.defaultdict(set)
    for r in out:
        groups[r["text_crc32"]].add(r["shard"])
    assert sum(len(v) > 1 for v in groups.values()) <= 2


def test_a_group_with_a_third_of_all_rows_is_spread(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then repeat('same ', 100) else concat('t', id, repeat(' w', cast(id % 200 as int))) end as text")
    _, size = shards_of(rows, rows_per_task=20)
    assert max(size.values()) <= 1.03 * min(size.values())


def test_shards_of_odd_input(spark, odd_docs, no_docs):
    out, _ = shards_of(odd_docs)
    text = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert len(out) == odd_docs.count()
    import zlib

    assert all(r["size"] == 8 + len((text[r["doc_id"]] or "").encode()) and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) and r["grown_shard"] is None for r in out)
    assert sharding.shard(no_docs).count() == 0
    kept = sharding.sharded_rows(odd_docs)
    assert set(kept.columns) == set(odd_docs.columns) and kept.count() == odd_docs.count()
    assert dict(kept.dtypes)["shard"] == "int"


def test_shards_agree_between_runs(docs):
    a, b = (sorted(map(tuple, sharding.shard(docs).collect()), key=str) for _ in range(2))
    assert a == b


# components


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# pipeline and queries


def test_pipeline_step_by_step(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, corpus_pipeline.written(stage(spark, at, sf), f"test-{name}")
        if name != "sharding":
            assert at.columns == docs.columns
        if name == "simhash":
            want = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
            assert {r["doc_id"] for r in at.collect()} == want
        if name == "toxicity":
            assert 0.8 * before.count() < at.count() <= before.count()
        if name == "decontamination":
            from lattica.llm import decontaminate

            assert decontaminate.contaminated(at, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
        if name == "mixing":
            words = lambda df: df.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
            assert abs(words(at) - 1.5 * words(before)) < 0.1 * words(before)
        if name == "sharding":
            assert at.count() == before.count() and set(docs.columns) < set(at.columns)
    assert corpus_pipeline.run(spark, sf).count() == at.count()


def test_ten_queries_are_registered():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 11))


def test_oracles_equal(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name, sql in queries.ORACLE.items():
        df, rel = queries.QUERIES[name](spark, sf), con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(rel.columns)
        compare(df.select(columns).collect(), rel.select(", ".join(columns)).fetchall())


def test_native_modules_run_no_python_on_rows():
    for module in (chat_format, mixing, sharding):
        text = inspect.getsource(module)
        assert not re.search(r"udf|mapIn|applyIn|\.rdd|pandas", text), module.__name__
