"""Sharding by a k-d tree over text metadata, cut at distributed weighted medians.

The tree starts with all documents and ``shards`` leaves. A node with ``k`` leaves is cut along
its widest dimension at the key below which ``floor(k/2)/k`` of its bytes lie, until every node
is one leaf, so leaves hold equal bytes. The cut key is found by histograms: bytes by node and
1,024 key ranges, then the crossing range alone again, all nodes of a level together; the driver
sees these sums alone, whose number depends on the shards. A node is
an expression over the keys, so no level writes or shuffles the documents; a round shuffles one
row per node, range and task.

Dimensions are metadata of the text: its length, its bytes a character and its bytes a space. Their
keys have the text's hash as low bits, so equal texts lie side by side whatever their other columns.
A group of equal texts at a cut stays whole if it has at most ``keep`` of a leaf's bytes, as bytes
are to be near equal; else it is cut inside by a hash of the row, so a group of any size is spread
evenly, also where its rows share an id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import equal_keys, hashed, keyed, small, written

RANGE_BITS = 10
VALUE_BITS, TIE_BITS = 20, 40
KEY_BITS = VALUE_BITS + TIE_BITS
DIMENSIONS = ("length", "script", "words")


@dataclass
class _Node:
    first: int
    leaves: int
    split: tuple | None = None  # (dimension, key, id key or None)
    sides: list = field(default_factory=list)


def _keys(text: Column) -> dict[str, Column]:
    """The dimensions as integers of VALUE_BITS (log size, bytes a code point, log bytes a space), and the text's hash below."""
    full = (1 << VALUE_BITS) - 1
    size, chars = F.octet_length(text), F.length(text)
    log = F.least(F.log2(size + F.lit(1.0)) / 40, F.lit(1.0))
    wide = F.when(chars == 0, F.lit(0.0)).otherwise((size / chars - 1) / 3)
    spaces = size - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    tie = F.shiftrightunsigned(F.xxhash64(text), 64 - TIE_BITS)
    value = {
        "length": F.floor(log * full),
        "script": F.floor(wide * full),
        "words": F.floor(F.least(F.log2((size + 1) / spaces) / 40, F.lit(1.0)) * full),
    }
    return {k: F.shiftleft(v.cast("bigint"), TIE_BITS).bitwiseOR(tie) for k, v in value.items()}


def _left(split: tuple) -> Column:
    dimension, key, id_key = split
    less = F.col(dimension) < F.lit(key)
    return less if id_key is None else less | ((F.col(dimension) == F.lit(key)) & (F.col("id_key") < F.lit(id_key)))


def _label(node: _Node, of) -> Column:
    if not node.sides:
        return of(node)
    return F.when(_left(node.split), _label(node.sides[0], of)).otherwise(_label(node.sides[1], of))


def _open(node: _Node) -> list[_Node]:
    return [x for s in node.sides for x in _open(s)] if node.sides else [node] * (node.leaves > 1)


def _of_node(values: dict[int, int]) -> Column:
    return F.create_map(*[x for n, v in values.items() for x in (F.lit(n), F.lit(v).cast("bigint"))])[F.col("node")]


def _histogram(rows: DataFrame, spans: list[Column]) -> dict[tuple[int, int], np.ndarray]:
    """Bytes and rows by (node, place in ``spans``) and span: at most nodes x spans x 1,024 rows come back."""
    each = rows.select("node", "size", F.posexplode(F.array(*spans)).alias("which", "span"))
    sums = each.groupBy("node", "which", "span").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).toArrow()
    out: dict[tuple[int, int], np.ndarray] = {}
    for n, w, s, b, c in zip(*(sums[c].to_pylist() for c in ("node", "which", "span", "bytes", "n")), strict=True):
        out.setdefault((n, w), np.zeros((2, 1 << RANGE_BITS), np.int64))[:, s & ((1 << RANGE_BITS) - 1)] = b, c
    return out


def kd_tree(rows: DataFrame, shards: int, *, keep: float = 0.05, slack: float = 0.002) -> _Node:
    """``rows``: size, id_key and the dimensions. A cut may miss its goal by ``slack`` of a leaf."""
    root = _Node(0, shards)
    while level := _open(root):
        by_id = {n.first: n for n in level}
        live = rows.withColumn("node", _label(root, lambda n: F.lit(n.first if n.leaves > 1 else None).cast("int"))).where("node is not null")
        hist = _histogram(live, [F.shiftright(d, KEY_BITS - RANGE_BITS) for d in DIMENSIONS])
        goal, leaf, axis, first = {}, {}, {}, {}
        for i, n in by_id.items():
            half = n.leaves // 2
            n.sides, n.split = [_Node(i, half), _Node(i + half, n.leaves - half)], (DIMENSIONS[0], 0, None)
            if (i, 0) in hist:
                width = [np.ptp(np.flatnonzero(hist[i, k][1])) for k in range(len(DIMENSIONS))]
                at = int(np.argmax(width))
                axis[i], first[i], total = DIMENSIONS[at], hist[i, at], int(hist[i, at][0].sum())
                goal[i], leaf[i] = total * half / n.leaves, total / n.leaves
        if not goal:
            continue
        axes = _of_node({i: DIMENSIONS.index(d) for i, d in axis.items()}).cast("int")
        key = F.element_at(F.array(*DIMENSIONS), axes + 1)
        for name, base in (("key", dict.fromkeys(goal, 0)), ("id_key", {})):
            if name == "id_key":  # equal texts at a cut, too many bytes to stay whole
                base = {i: whole[i] for i in goal}
                live = live.where(key == _of_node({i: by_id[i].split[1] for i in goal}))
                key, first = F.col("id_key"), {}
            todo, low, shift, whole = dict(goal), dict.fromkeys(goal, 0), KEY_BITS, {}
            while todo and shift > 0:
                shift -= RANGE_BITS
                if shift + RANGE_BITS < KEY_BITS or not first:
                    part = live.where(F.shiftright(key, shift + RANGE_BITS) == _of_node({i: low[i] for i in todo}))
                    first = {i: h for (i, _), h in _histogram(part, [F.shiftright(key, shift)]).items()}
                for i in list(todo):
                    upto = base[i] + np.cumsum(first[i][0])
                    s = int(np.searchsorted(upto, goal[i]))
                    (size, rows_in), n = first[i][:, s].tolist(), by_id[i]
                    low[i], base[i] = (low[i] << RANGE_BITS) + s, int(upto[s]) - size
                    stays = shift == 0 and (name == "id_key" or size <= leaf[i] * keep)
                    if size <= leaf[i] * slack or rows_in == 1 or stays:
                        cut = (low[i] + (base[i] + size - goal[i] <= goal[i] - base[i])) << shift
                        n.split = (axis[i], cut, None) if name == "key" else (axis[i], n.split[1], cut)
                        del todo[i]
                    elif shift == 0:
                        n.split = (axis[i], low[i], None)
                        whole[i] = base[i]
            goal = {i: goal[i] for i in whole}
            if not goal:
                break
    return root


def _prepared(docs: DataFrame, shards: int | None = None, *, slack: float = 0.002, most: int = 1000) -> tuple[DataFrame, DataFrame | None]:
    """(written table of doc_id, size, text_crc32, id_key and the dimensions; keys of rows that are numbered).

    Rows that are equal in id and text get an id_key each. With ``shards`` those of up to ``most`` rows and
    ``slack`` of a shard's bytes, by which a cut may miss its goal anyway, share one: they stay together.
    """
    text = F.coalesce("text", F.lit(""))
    key, name = keyed(F.col)
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"), name.alias("name"), *[c.alias(k) for k, c in _keys(text).items()]
    )
    rows = written(rows, "shard-rows")
    if shards is None:
        several = equal_keys(rows)
    else:
        room = (rows.agg(F.sum("size")).first()[0] or 0) / shards * slack
        several = equal_keys(rows, (F.count("*") > most) | (F.sum("size") > room))
    return written(hashed(rows, several).withColumnRenamed("h", "id_key").drop("key", "name"), "shard-keys"), several


def _placed(rows: DataFrame, sized: DataFrame, root: _Node, rows_per_task: int) -> DataFrame:
    """``rows`` (id_key, dimensions, doc_id and more) with shard and slot.

    Slots number a shard's rows from 0 by hash range of the id, then id: ranges are counted
    first, so no shard is ordered in one task.
    """
    ranges = max(1, sized.count() // max(1, root.leaves) // rows_per_task + 1)
    place = lambda df: df.withColumn("shard", _label(root, lambda n: F.lit(n.first))).withColumn("_range", (F.shiftright("id_key", 28) * ranges / F.lit(float(1 << 32))).cast("int"))
    counts = place(sized).groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    starts = counts.select("shard", "_range", (F.sum("_n").over(W.partitionBy("shard").orderBy("_range")) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(W.partitionBy("shard", "_range").orderBy("id_key", "doc_id")) - 1
    rows = place(rows).withColumn("_place", inside).join(small(written(starts, "shard-starts")), ["shard", "_range"])
    return rows.withColumn("slot", (F.col("_start") + F.col("_place")).cast("bigint"))


def shard(docs: DataFrame, shards: int = 24, *, rows_per_task: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    Null text counts as empty (size 8, crc32 0); repeated rows are rows of their own; with
    fewer documents than shards some shards are empty; an empty table gives no rows; other
    columns are not read. The law is ``bytes``.
    """
    sized, _ = _prepared(docs)
    return _placed(sized, sized, kd_tree(sized, shards), rows_per_task).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def sharded_rows(docs: DataFrame, shards: int = 24, *, rows_per_task: int = 10_000) -> DataFrame:
    """The rows of ``docs`` with shard and slot; columns of these names are replaced.

    Only equal rows that must be told apart are written with their texts, to be numbered.
    """
    sized, several = _prepared(docs, shards)
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("shard", "slot")])
    text = F.coalesce(F.col("row")["text"], F.lit(""))
    key, name = keyed(lambda c: F.col("row")[c])
    rows = docs.select(row.alias("row")).select("row", F.col("row")["doc_id"].alias("doc_id"), key.alias("key"), name.alias("name"), *[v.alias(k) for k, v in _keys(text).items()])
    rows = hashed(rows, several).withColumnRenamed("h", "id_key")
    return _placed(rows, sized, kd_tree(sized, shards), rows_per_task).select("row.*", "shard", "slot")
