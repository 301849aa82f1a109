"""Z-order codes: 16 bits an axis, y in the odd bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.numbers import clamp, finite
from lattica.model import Bounds

AXIS_BITS = 16
TOP = (1 << AXIS_BITS) - 1
#: Fixed shift and mask pairs that spread 16 bits to the even places of 32.
_SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def spread(v: Column) -> Column:
    v = v.cast("bigint").bitwiseAND(F.lit(TOP))
    for shift, mask in _SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def interleave(qx: Column, qy: Column) -> Column:
    return spread(qx).bitwiseOR(F.shiftleft(spread(qy), 1))


def quantise(v: Column, low: Column | float, high: Column | float) -> Column:
    """0..65535 by clipping and truncation; NaN, null and a single-valued axis give 0."""
    low, high = (c if isinstance(c, Column) else F.lit(c) for c in (low, high))
    t = clamp((v - low) / F.nullif(high - low, F.lit(0.0)), 0.0, 1.0) * TOP
    return F.when(finite(v) & (high > low), F.floor(t)).otherwise(0).cast("bigint")


def code(x: Column, y: Column, bounds: Bounds) -> Column:
    return interleave(quantise(x, bounds.min_x, bounds.max_x), quantise(y, bounds.min_y, bounds.max_y))


def corner(x: float, y: float, b: Bounds) -> tuple[int, int]:
    """A query corner on the grid; both are 0 if either axis has a single value."""
    if b.max_x <= b.min_x or b.max_y <= b.min_y:
        return 0, 0
    place = lambda v, a, c: int(min(max((v - a) / (c - a), 0.0), 1.0) * TOP)
    return place(x, b.min_x, b.max_x), place(y, b.min_y, b.max_y)


def corner_of(x: Column, y: Column, b: Bounds) -> tuple[Column, Column]:
    """``corner`` of columns."""
    if b.max_x <= b.min_x or b.max_y <= b.min_y:
        return F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    return quantise(x, b.min_x, b.max_x), quantise(y, b.min_y, b.max_y)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed integer spans, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def cover(x0: int, y0: int, x1: int, y1: int, depth: int = AXIS_BITS) -> list[tuple[int, int]]:
    """Spans of codes that cover a rectangle of the grid.

    Quarters are cut down to ``depth`` halvings; cells of that depth count as a whole, so a
    smaller depth gives fewer and coarser spans (the exact box filter follows anyway).
    """
    x0, x1, y0, y1 = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    spans, todo = [], [(0, 0, 0, 0)]  # prefix, level, left, bottom
    while todo:
        prefix, level, left, bottom = todo.pop()
        side = 1 << (AXIS_BITS - level)
        right, top = left + side - 1, bottom + side - 1
        if right < x0 or left > x1 or top < y0 or bottom > y1:
            continue
        inside = x0 <= left and right <= x1 and y0 <= bottom and top <= y1
        if inside or level == depth:
            width = side * side
            spans.append((prefix * width, (prefix + 1) * width - 1))
            continue
        half = side // 2
        todo += [(prefix * 4 + dx + 2 * dy, level + 1, left + dx * half, bottom + dy * half) for dx in (0, 1) for dy in (0, 1)]
    return merge_spans(spans)


def spans_for_bounds(every: Bounds, query: Bounds, depth: int = AXIS_BITS) -> list[tuple[int, int]]:
    return cover(*corner(query.min_x, query.min_y, every), *corner(query.max_x, query.max_y, every), depth)


def merge_intervals(df: DataFrame, low: str = "lo", high: str = "hi", by: tuple[str, ...] = ()) -> DataFrame:
    """Gaps and islands: intervals of each ``by`` that touch or overlap become one.

    A null bound comes last and opens no island but the first. Both windows read one sort, so that
    equal intervals keep their order from the first to the second.
    """
    order = W.partitionBy(*by).orderBy(F.asc_nulls_last(low), F.asc_nulls_last(high))
    reach = F.max(high).over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(low) > reach + 1), 1).otherwise(0)
    island = F.sum("_opens").over(order.rowsBetween(W.unboundedPreceding, 0))
    marked = df.withColumn("_opens", opens).withColumn("_island", island)
    return marked.groupBy(*by, "_island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_island")
