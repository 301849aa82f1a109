"""Sorted layouts of points: markers, sort orders, row-group pruning and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions import morton
from lattica.functions.numbers import finite
from lattica.model import Bounds, PointColumns

#: Sort orders of the benchmark's physical layouts.
LAYOUTS = {
    "canonical": (),
    "morton": ("morton",),
    "morton_then_feature": ("morton", "feature"),
    "feature_then_morton": ("feature", "morton"),
}
Z_LEVELS = 100


def extent(df: DataFrame, c: PointColumns) -> Bounds | None:
    r = df.where(finite(F.col(c.x)) & finite(F.col(c.y))).agg(F.min(c.x), F.min(c.y), F.max(c.x), F.max(c.y)).first()
    return None if r[0] is None else Bounds(*map(float, r))


def with_codes(df: DataFrame, c: PointColumns, bounds: Bounds) -> DataFrame:
    return df.withColumn("morton", morton.code(F.col(c.x).cast("double"), F.col(c.y).cast("double"), bounds))


def extremes(df: DataFrame, c: PointColumns) -> DataFrame:
    """place, row_id: the first rows that reach min x, max x, min y, max y; a row counts once."""
    at = lambda col, most: (F.min_by if most == "min" else F.max_by)(c.row_id, F.struct(F.col(col), (F.col(c.row_id) if most == "min" else -F.col(c.row_id))))
    one = df.agg(F.array(at(c.x, "min"), at(c.x, "max"), at(c.y, "min"), at(c.y, "max")).alias("ids"))
    placed = one.select(F.posexplode(F.array_distinct("ids")).alias("place", "row_id"))
    return placed.where("row_id is not null")


def sort_keys(df: DataFrame, c: PointColumns, layout: str = "morton") -> list[str]:
    """The layout's columns; with few z levels the z axis comes first."""
    names = {"morton": "morton", "feature": c.name or c.code}
    keys = [names[k] for k in LAYOUTS[layout]]
    if layout == "morton" and c.z and few_levels(df, c.z):
        keys = [c.z, *keys]
    return [*keys, c.row_id]


def few_levels(df: DataFrame, z: str) -> bool:
    r = df.agg(F.approx_count_distinct(z, 0.02).alias("about")).first()["about"]
    if r > 4 * Z_LEVELS:
        return False
    return df.agg((F.count_distinct(F.col(z)) + F.max(F.col(z).isNull().cast("int"))).alias("n")).first()["n"] < Z_LEVELS


def sort_points(df: DataFrame, c: PointColumns, layout: str = "morton", markers: bool = True) -> DataFrame:
    """Rows in the layout's order; the extreme rows stand in front with code 0."""
    bounds = extent(df, c) or Bounds(0, 0, 0, 0)
    coded = with_codes(df, c, bounds)
    if not markers or layout == "canonical":
        return coded.orderBy(*sort_keys(df, c, layout))
    marks = F.broadcast(extremes(df, c).withColumnRenamed("row_id", "_mark"))  # four rows at most
    coded = coded.join(marks, F.col(c.row_id) == F.col("_mark"), "left").drop("_mark")
    coded = coded.withColumn("morton", F.when(F.col("place").isNotNull(), F.lit(0).cast("bigint")).otherwise(F.col("morton")))
    return coded.orderBy(F.col("place").asc_nulls_last(), *sort_keys(df, c, layout)).drop("place")


def row_groups(df: DataFrame, key: Column, value: str) -> DataFrame:
    """group_id, rows, lo, hi: extents of a column by group."""
    return df.groupBy(key.cast("bigint").alias("group_id")).agg(F.count("*").alias("rows"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def groups_for_codes(groups: DataFrame, codes: Sequence[int]) -> DataFrame:
    """Groups whose extent may hold a selected code; an unknown extent may."""
    low, high = min(codes), max(codes)
    return groups.where(F.col("lo").isNull() | ((F.col("lo") <= high) & (F.col("hi") >= low)))


def groups_for_spans(groups: DataFrame, spans: DataFrame) -> DataFrame:
    """Groups that overlap one of a few spans (broadcast: a cover has a bounded number)."""
    return groups.join(F.broadcast(spans), (F.col("span_lo") <= F.col("hi")) & (F.col("span_hi") >= F.col("lo")), "left_semi")


def spans(every: Bounds, query: Bounds, depth: int = 6) -> list[tuple[int, int]]:
    """Merged spans of codes that cover a box, few by the depth."""
    return [tuple(map(int, s)) for s in morton.spans_for_bounds(every, query, depth)]


def covering_spans(spark, every: Bounds, query: Bounds, depth: int = 6) -> DataFrame:
    return spark.createDataFrame(morton.spans_for_bounds(every, query, depth), "span_lo bigint, span_hi bigint")


def until_cap(groups: DataFrame, order: str, cap: int) -> DataFrame:
    """Groups to open, in order, until the cap is reached. One row for each row group."""
    before = F.coalesce(F.sum("rows").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return groups.withColumn("rows_before", before).where(F.col("rows_before") < cap)


def marker_bounds(df: DataFrame, c: PointColumns, row_index: str) -> DataFrame:
    """The box of the marker rows at the head; null unless two finite ones stand there."""
    head = df.where((F.col(row_index) < 4) & (F.col("morton") == 0) & finite(F.col(c.x)) & finite(F.col(c.y)))
    low = head.agg(F.min(c.x).alias("min_x"), F.min(c.y).alias("min_y"), F.max(c.x).alias("max_x"), F.max(c.y).alias("max_y"), F.count("*").alias("n"))
    return low.select(*[F.when(F.col("n") >= 2, F.col(k)).alias(k) for k in ("min_x", "min_y", "max_x", "max_y")], "n")


def verify(df: DataFrame, c: PointColumns, row_index: str) -> DataFrame:
    """id, passed: the marker prefix, its box, and the order of the tail.

    The order is checked between neighbours by row index: within ranges of rows, and between the
    last of a range and the first of the next, so no task sees all rows.
    """
    span = F.floor(F.col(row_index) / 65536)
    head = df.where((F.col(row_index) < 4) & (F.col("morton") == 0)).agg(F.count("*").alias("marks"), F.min(c.x).alias("hx0"), F.max(c.x).alias("hx1"), F.min(c.y).alias("hy0"), F.max(c.y).alias("hy1"))
    box = df.agg(F.min(c.x).alias("x0"), F.max(c.x).alias("x1"), F.min(c.y).alias("y0"), F.max(c.y).alias("y1"))
    tail = df.where(~((F.col(row_index) < 4) & (F.col("morton") == 0))).select(F.col(row_index).alias("i"), "morton", span.alias("span"))
    step = F.col("morton") - F.lag("morton").over(W.partitionBy("span").orderBy("i"))
    spans = tail.withColumn("step", step).groupBy("span").agg(F.min("step").alias("least"), F.min_by("morton", "i").alias("first"), F.max_by("morton", "i").alias("last"))
    between = F.col("first") - F.lag("last").over(W.orderBy("span"))
    falls = spans.withColumn("between", between).agg(F.coalesce(F.min(F.least("least", "between")), F.lit(0)).alias("fall"))
    one = head.crossJoin(box).crossJoin(falls)  # one row each
    checks = {
        "marker_prefix": F.col("marks").between(2, 4),
        "marker_box": F.expr("hx0 <=> x0 and hx1 <=> x1 and hy0 <=> y0 and hy1 <=> y1"),
        "tail_sorted": F.col("fall") >= 0,
    }
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("id"), v.alias("passed")) for k, v in checks.items()])))
