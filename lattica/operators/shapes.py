"""Circles and polygons: bounds, areas, edges and vertex offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.numbers import finite
from lattica.functions.transforms import apply

BOX = ("min_x", "min_y", "max_x", "max_y")


def _box(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    df = df.where(finite(F.col(x)) & finite(F.col(y)))
    return df.groupBy(*by).agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def point_bounds(df: DataFrame, x: str, y: str, matrix=None) -> DataFrame:
    """The box of transformed points, finite before and after."""
    df = df.where(finite(F.col(x)) & finite(F.col(y)))
    tx, ty = apply(matrix, F.col(x).cast("double"), F.col(y).cast("double"))
    return _box(df.select(tx.alias("tx"), ty.alias("ty")), "tx", "ty")


def circle_bounds(df: DataFrame, x: str, y: str, radius: str, matrix=None) -> DataFrame:
    """Four corners of each circle with a finite radius of 0 or more, else its centre."""
    good = finite(F.col(radius)) & (F.col(radius) >= 0)
    r = F.when(good, F.col(radius).cast("double")).otherwise(F.lit(0.0))
    corner = lambda sx, sy: F.struct((F.col(x) + sx * r).alias("cx"), (F.col(y) + sy * r).alias("cy"))
    corners = df.where(finite(F.col(x)) & finite(F.col(y))).select(F.inline(F.array(*[corner(a, b) for a in (-1, 1) for b in (-1, 1)])))
    return point_bounds(corners, "cx", "cy", matrix)


def polygon_bounds(df: DataFrame, ring: str, matrix=None) -> DataFrame:
    return point_bounds(df.select(F.inline(ring)), "x", "y", matrix)


def image_bounds(spark, width: float, height: float, matrix=None, scale=(1.0, 1.0)) -> DataFrame:
    w, h = width * scale[0], height * scale[1]
    return point_bounds(spark.createDataFrame([(0.0, 0.0), (w, 0.0), (0.0, h), (w, h)], "x double, y double"), "x", "y", matrix)


def union_bounds(*boxes: DataFrame) -> DataFrame:
    every = boxes[0].select(*BOX)
    for b in boxes[1:]:
        every = every.unionByName(b.select(*BOX))
    return every.agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def view_fit(boxes: DataFrame, width: float, height: float, backoff: float = 0.2) -> DataFrame:
    """Centre of the box and the zoom that shows it whole."""
    least = F.lit(1e-9)
    fit = F.least(F.lit(width) / F.greatest(F.col("max_x") - F.col("min_x"), least), F.lit(height) / F.greatest(F.col("max_y") - F.col("min_y"), least))
    return boxes.select(((F.col("min_x") + F.col("max_x")) / 2).alias("center_x"), ((F.col("min_y") + F.col("max_y")) / 2).alias("center_y"), (F.log2(fit) - F.lit(backoff)).alias("zoom"))


def twice_area(ring: Column) -> Column:
    """Signed double area of a ring by the cross products of its edges."""
    follow = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, follow, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)


def area(ring: Column) -> Column:
    return F.abs(twice_area(ring)) / 2


def characteristic_size(ring: Column) -> Column:
    return F.sqrt(area(ring))


def edges(df: DataFrame, key: str, ring: str) -> DataFrame:
    """key, i, j: each vertex and the next, the last one's being the first."""
    n = F.size(ring)
    return df.select(key, n.alias("_n"), F.posexplode(ring).alias("i", "_v")).select(key, "i", ((F.col("i") + 1) % F.col("_n")).alias("j"))


def start_indices(df: DataFrame, order: str, size: Column, block: int = 65_536) -> DataFrame:
    """start: the number of vertices before each ring in order, by sums of ranges of the order."""
    sized = df.withColumn("_size", size.cast("bigint")).withColumn("_block", F.floor(F.col(order) / block))
    sums = sized.groupBy("_block").agg(F.sum("_size").alias("_sum"))
    sums = sums.select("_block", (F.sum("_sum").over(W.orderBy("_block")) - F.col("_sum")).alias("_before"))
    inside = F.coalesce(F.sum("_size").over(W.partitionBy("_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("start", inside).join(sums, "_block").withColumn("start", F.col("start") + F.col("_before")).drop("_size", "_block", "_before")


def visible(df: DataFrame, key: str, hidden: DataFrame, radius: str | None = None) -> DataFrame:
    """Features that aren't hidden; circles need a finite radius of 0 or more."""
    rows = df.join(hidden, key, "left_anti")
    return rows if radius is None else rows.where(finite(F.col(radius)) & (F.col(radius) >= 0))


def kind_of(columns, geometry_types=()) -> str:
    """circle with a radius, point if all geometries are points, else polygon."""
    if "radius" in columns:
        return "circle"
    return "point" if geometry_types and all(t == "Point" for t in geometry_types) else "polygon"
