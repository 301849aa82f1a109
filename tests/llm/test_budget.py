"""Chat windows under their budget, turn by turn against plain Python."""

import random

import pytest

from lattica.llm import chat_format

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n int"


def conversation(rng, conv, turns, head, longest):
    rows = [(conv, 0, "system", "s" * 4 * max(0, head - 4), head)] if head else []
    for i in range(len(rows), turns):
        n = rng.choice([4, 5, rng.randrange(4, longest)])
        rows.append((conv, i, "user" if i % 2 else "assistant", f"{conv}-{i} ".ljust(4 * (n - 4), "x")[: 4 * (n - 4)], n))
    return rows


def parsed(w):
    parts = w["formatted"].split("<|im_end|>\n")[:-1]
    turns = [p[len(chat_format.START) :].split("\n", 1) for p in parts]
    return turns, sum(-(-len(t) // 4) + 4 for _, t in turns)


CASES = [(1024, 256), (200, 60), (64, 64), (100, 0)]


@pytest.mark.parametrize("budget, history", CASES)
def test_no_window_exceeds_its_budget(spark, budget, history):
    """Turns near the budget, long system turns, and turns that are too long by themselves."""
    rng = random.Random(budget)
    rows = [r for c in range(12) for r in conversation(rng, c, 40 + 90 * (c % 4), (0, 10, budget // 2, budget * 5)[c % 4], (budget // 8, budget // 2, budget, 2 * budget)[c // 3])]
    rows += [(99, i, "assistant", "x" * 4 * (n - 4), n) for i, n in enumerate([budget - 2, budget - 26, 9, budget, budget + 1, 30])]
    seen = {}
    for w in chat_format.windows(spark.createDataFrame(rows, SCHEMA), budget=budget, history=history).collect():
        turns, size = parsed(w)
        assert size == w["tokens"] and len(turns) == w["repeated"] + w["targets"]
        assert size <= budget or len(turns) == 1, (w["conv_id"], size)
        seen.setdefault(w["conv_id"], []).append((w["window"], w, turns))
    for conv, mine in seen.items():
        source = [[r[2], r[3]] for r in rows if r[0] == conv]
        head = source[0] if source[0][0] == "system" and 2 * rows_tokens(source[0]) <= budget else None
        at = 0
        for k, (_, w, turns) in enumerate(sorted(mine, key=lambda x: x[0])):
            targets, again = turns[w["repeated"] :], turns[: w["repeated"]]
            assert targets == source[at : at + w["targets"]]
            kept = bool(again) and head is not None and again[0] == head
            if kept:
                again = again[1:]
            size = sum(map(rows_tokens, targets))
            if head and k:
                assert kept == (rows_tokens(head) + size <= budget)
            assert again == source[at - len(again) : at] and sum(map(rows_tokens, again)) <= history
            at += w["targets"]
        assert at == len(source)


def rows_tokens(turn):
    return -(-len(turn[1]) // 4) + 4


def test_windows_of_short_turns_are_well_filled(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", "x" * 36, 13) for i in range(2000)]
    w = chat_format.windows(spark.createDataFrame(rows, SCHEMA), budget=1024, history=128).collect()
    targets = [r["targets"] * 13 for r in w]
    assert sum(targets) == 26000 and sorted(targets)[len(targets) // 2] > 0.9 * (1024 - 128)
    assert sum(r["repeated"] > 0 for r in w) == len(w) - 1


def test_a_column_of_tokens_is_taken(spark):
    rows = [(1, i, "assistant", f"turn {i}", 40) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    w = chat_format.windows(df, budget=300, history=100, tokens="n").collect()
    assert all(r["tokens"] == 40 * (r["repeated"] + r["targets"]) <= 300 for r in w) and len(w) < 20
    assert sum(r["targets"] for r in chat_format.windows(df.selectExpr("conv_id", "turn", "role", "text", "cast(null as int) as n"), tokens="n").collect()) == 20
