"""Rasters as chunk and pixel tables: planes, tiles, statistics, pyramids."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GLOBAL_AXES = ("t", "z")
SI_METRES = {"m": 1.0, "cm": 1e-2, "mm": 1e-3, "µm": 1e-6, "um": 1e-6, "nm": 1e-9, "pm": 1e-12, "Å": 1e-10}
#: Colours of channels without one, in order, which must be these for equal pictures.
PALETTE = ((0, 0, 255), (0, 255, 0), (255, 0, 255), (255, 255, 0), (255, 128, 0), (0, 255, 255), (255, 255, 255), (255, 0, 0))
MAX_CHANNELS = 6


def pixels(df: DataFrame, y: str, values: str) -> DataFrame:
    """One row a pixel of rows stored as arrays."""
    rest = [c for c in df.columns if c not in (y, values)]
    return df.select(*rest, F.col(y).alias("y"), F.posexplode(values).alias("x", "value"))


def check_selection(axes: Sequence[str], selection: dict[str, int]) -> None:
    if len(set(axes)) != len(axes):
        raise ValueError("axis labels must differ")
    for axis in selection:
        if axis not in axes:
            raise KeyError(f"no axis {axis!r} among {list(axes)}")


def select(df: DataFrame, axes: Sequence[str], selection: dict[str, int]) -> DataFrame:
    """The plane of a selection of pixels; unknown axes and repeated labels are errors. ``Store.plane`` reads only its chunks."""
    check_selection(axes, selection)
    keep = F.lit(True)
    for axis, i in selection.items():
        keep = keep & (F.col(axis) == i)
    return df.where(keep)


def indexer(axes: Sequence[str], selection: dict[str, int]) -> list[int | slice]:
    """What to take of each axis: the selection's index, or everything."""
    check_selection(axes, selection)
    return [selection.get(a, slice(None)) for a in axes]


def checked_chunks(axes: Sequence[str], chunks: Sequence[int]) -> tuple[int, ...]:
    """A chunk shape: as long as the axes, positive, and one along every axis that isn't in space."""
    if len(chunks) != len(axes) or min(chunks) < 1:
        raise ValueError(f"chunks {list(chunks)} don't fit the axes {list(axes)}")
    if any(c != 1 for a, c in zip(axes, chunks, strict=True) if a not in ("x", "y", "z")):
        raise ValueError("chunks hold one index of an axis that isn't in space")
    return tuple(chunks)


def auto_chunks(shape: Sequence[int], axes: Sequence[str], side: int = 512) -> tuple[int, ...]:
    """A tile of a plane: up to ``side`` along x and y, one along the others."""
    return tuple(min(n, side) if a in ("x", "y") else 1 for a, n in zip(axes, shape, strict=True))


def tile_box(tx: int, ty: int, size: int, width: int, height: int) -> dict[str, tuple[int, int]]:
    """Half-open ranges of a tile; edge tiles are clipped, a tile outside is an error."""
    if tx < 0 or ty < 0 or tx * size >= width or ty * size >= height:
        raise IndexError(f"tile ({tx}, {ty}) lies outside {width} x {height}")
    return {"x": (tx * size, min((tx + 1) * size, width)), "y": (ty * size, min((ty + 1) * size, height))}


def tile(df: DataFrame, tx: int, ty: int, size: int, width: int, height: int) -> DataFrame:
    """The pixels of one tile of a table of pixels. ``Store.tile`` reads only its chunks."""
    box = tile_box(tx, ty, size, width, height)
    return df.where(F.col("x").between(box["x"][0], box["x"][1] - 1) & F.col("y").between(box["y"][0], box["y"][1] - 1))


def stats(df: DataFrame, by: Sequence[str], value: str = "value", low: float = 0.005, high: float = 0.995, accuracy: int | None = None) -> DataFrame:
    """Domain (min, max) and contrast limits of each selection.

    Limits are quantiles of the positive values (the domain where none is positive, or where
    they are equal). They are exact, which keeps a count of every distinct value of a selection:
    right for integer pixels. With ``accuracy`` they come from a sketch of bounded size.
    """
    v = F.col(value).cast("double")
    ends = F.array(F.lit(low), F.lit(high))
    positive = F.when(v > 0, v)
    q = F.percentile(positive, ends) if accuracy is None else F.percentile_approx(positive, ends, accuracy)
    g = df.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), q.alias("q"))
    usable = F.col("q").isNotNull() & (F.col("q")[0] < F.col("q")[1])
    return g.select(*by, "lo", "hi", F.when(usable, F.col("q")[0]).otherwise(F.col("lo")).alias("limit_lo"), F.when(usable, F.col("q")[1]).otherwise(F.col("hi")).alias("limit_hi"))


def middle_planes(size: int) -> list[int]:
    return sorted({0, size // 2, max(size - 1, 0)})


def stats_3d(df: DataFrame, by: Sequence[str], z: str, size: int, value: str = "value") -> DataFrame:
    """Statistics over the first, middle and last plane: widest domain and limits."""
    planes = stats(df.where(F.col(z).isin(middle_planes(size))), [*by, z], value)
    return planes.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("limit_lo").alias("limit_lo"), F.max("limit_hi").alias("limit_hi"))


def downsample(df: DataFrame, by: Sequence[str], factor: int = 2, how: str = "mean") -> DataFrame:
    """Blocks of pixels as one: the mean of images, the commonest value of labels (least of equals)."""
    fx, fy = F.floor(F.col("x") / factor).cast("bigint").alias("x"), F.floor(F.col("y") / factor).cast("bigint").alias("y")
    agg = F.avg("value") if how == "mean" else F.mode("value", True)
    return df.groupBy(*by, fy, fx).agg(agg.alias("value"))


def stride(df: DataFrame, factor: int = 2) -> DataFrame:
    """Every factor-th pixel."""
    return df.where((F.col("x") % factor == 0) & (F.col("y") % factor == 0)).withColumn("x", F.floor(F.col("x") / factor).cast("bigint")).withColumn("y", F.floor(F.col("y") / factor).cast("bigint"))


def scale_factors(shape: Sequence[int], levels: int | None = None, factor: int = 2, least: int = 256) -> list[int]:
    """Factors of each level below the full one."""
    out, width = [], list(shape)
    while (levels is None or len(out) < levels) and (levels is not None or max(width) > least) and min(w // factor for w in width) >= 1:
        out.append(factor)
        width = [w // factor for w in width]
    return out


def guess_tile_size(chunk: Sequence[int]) -> int:
    return 2 ** int(math.log2(min(chunk[-2:])))


def interleaved(shape: Sequence[int]) -> bool:
    return shape[-1] in (3, 4)


def axis_sizes(axes: Column, shape: Column) -> Column:
    return F.map_from_arrays(axes, shape)


def clamp_selection(value: Column, size: Column) -> Column:
    """A selection on an axis: floored and held in 0..size-1; null where there is no such axis."""
    return F.when(size.isNotNull(), F.least(F.greatest(F.floor(value), F.lit(0)), size - 1))


def default_selections(sizes: dict[str, int]) -> list[dict[str, int]]:
    """Middle of the global axes, and the first four of the first other one."""
    base = {a: sizes[a] // 2 for a in GLOBAL_AXES if a in sizes}
    other = next((a for a in sizes if a not in (*GLOBAL_AXES, "x", "y")), None)
    if other is None:
        return [base]
    return [{**base, other: i} for i in range(min(4, sizes[other]))]


def chunk_grid(df: DataFrame, height: Column, width: Column, size: int) -> DataFrame:
    """y0, x0, h, w of each chunk of a plane; those at the edge are smaller."""
    axis = lambda n: F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    grid = df.select("*", F.explode(axis(height)).alias("y0")).select("*", F.explode(axis(width)).alias("x0"))
    return grid.withColumn("h", F.least(F.lit(size), height - F.col("y0"))).withColumn("w", F.least(F.lit(size), width - F.col("x0")))


def pad(values: Column, n: Column, fill: Column) -> Column:
    """An array cut or filled to n."""
    return F.concat(F.slice(values, 1, F.least(n, F.size(values))), F.array_repeat(fill, F.greatest(n - F.size(values), F.lit(0))))


def strides(shape: Column) -> Column:
    """Row-major strides of a shape."""
    i = F.sequence(F.lit(1), F.size(shape))
    return F.transform(i, lambda k: F.aggregate(F.slice(shape, k + 1, F.size(shape) - k), F.lit(1).cast("bigint"), lambda a, b: a * b))


def first_unused(n: Column, used: Column) -> Column:
    return F.get(F.array_except(F.sequence(F.lit(0), n - 1), used), 0)


def dtype_max(dtype: Column, bits: Column) -> Column:
    """Largest value: by bits if known, else by the type's name; floats are 1."""
    by_name = F.when(dtype.startswith("float"), F.lit(1.0))
    for n in (8, 16, 32):
        by_name = by_name.when(dtype == f"uint{n}", F.lit(float(2**n - 1))).when(dtype == f"int{n}", F.lit(float(2 ** (n - 1) - 1)))
    return F.when(bits.isNotNull(), F.pow(F.lit(2.0), bits) - 1).otherwise(by_name)


def metres(size: Column, unit: Column) -> Column:
    table = F.create_map(*[x for k, v in SI_METRES.items() for x in (F.lit(k), F.lit(v))])
    return size * table[unit]


def csc(df: DataFrame, row: str, col: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Entries dealt by range of column and sorted in it; and the columns' pointers.

    Pointers are running sums over one row for each column.
    """
    from pyspark.sql import Window as W

    entries = df.where(F.col(value) != 0).repartitionByRange(F.col(col)).sortWithinPartitions(col, row)
    counts = df.where(F.col(value) != 0).groupBy(col).agg(F.count("*").alias("nnz"))
    pointer = counts.withColumn("indptr", F.coalesce(F.sum("nnz").over(W.orderBy(col).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return entries, pointer


def clamp_selection_value(value: float, size: int) -> int:
    return min(max(math.floor(value), 0), size - 1)


def pyramid(df: DataFrame, by: Sequence[str], factors: Sequence[int], how: str = "mean") -> list[DataFrame]:
    """The full level and those below; each is made from the one above, so keep or write them in order."""
    levels = [df]
    for f in factors:
        levels.append(downsample(levels[-1], by, f, how))
    return levels


def synthetic(spark, height: int, width: int, channels: int = 1, planes: int = 1) -> DataFrame:
    """Indexed planes for tests: c, z, y, x, value; dealt by Spark's range."""
    n = height * width
    ids = spark.range(channels * planes * n)
    at = F.col("id") % n
    return ids.select(
        F.floor(F.col("id") / (n * planes)).alias("c"), (F.floor(F.col("id") / n) % planes).alias("z"), F.floor(at / width).alias("y"), (at % width).alias("x"),
        (F.col("id") % 251).cast("double").alias("value"),
    )


def to_tczyx(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """Pixels on all five axes; those that are missing have index 0."""
    return df.select(*[(F.col(a) if a in axes else F.lit(0)).cast("bigint").alias(a) for a in "tczyx"], "value")


def is_rgb(samples: int, channels: int, dtype: str) -> bool:
    """Three interleaved or separate 8-bit channels."""
    return dtype == "uint8" and (samples == 3 or channels == 3)


def stats_key(image: Column, z: Column, c: Column, t: Column) -> Column:
    """What statistics of a selection are kept by: id:z:c:t."""
    return F.concat_ws(":", image, z.cast("string"), c.cast("string"), t.cast("string"))


class StatsCache:
    """Statistics by image and selection: only selections that aren't held are computed, all in one scan."""

    def __init__(self, by: Sequence[str], compute=stats):
        self.by, self.compute = list(by), compute
        self.held: dict[tuple, dict] = {}
        self.scans = 0

    def get(self, image: str, df: DataFrame, selections: Sequence[dict[str, int]]) -> list[dict | None]:
        key = lambda s: (image, *(s[b] for b in self.by))
        missing = [s for s in selections if key(s) not in self.held]
        if missing:
            self.scans += 1
            keep = F.lit(False)
            for s in missing:
                mine = F.lit(True)
                for b in self.by:
                    mine = mine & (F.col(b) == s[b])
                keep = keep | mine
            for r in self.compute(df.where(keep), self.by).collect():  # one row for each selection
                self.held[(image, *(r[b] for b in self.by))] = r.asDict()
        return [self.held.get(key(s)) for s in selections]

    def drop(self, image: str) -> None:
        self.held = {k: v for k, v in self.held.items() if k[0] != image}


def physical_ratio(size: Column, of_size: Column) -> Column:
    """How much longer a pixel is than another's, for scales of one physical unit; null without either."""
    return size / F.nullif(of_size, F.lit(0.0))


def bounding_cube(shape: dict[str, int], sizes: dict[str, float] | None = None) -> tuple[tuple[float, float], ...]:
    """x, y and z ranges of a raster, in physical units where pixel sizes are given; without z its depth is 1."""
    sizes = sizes or {}
    return tuple((0.0, shape.get(a, 1) * sizes.get(a, 1.0)) for a in "xyz")


def channel_count(shape: Sequence[int], axes: Sequence[str] = (), declared: int | None = None) -> int:
    """The channel axis's size, else the third axis from the end, else what is declared, else 1."""
    if "c" in axes:
        return shape[list(axes).index("c")]
    return shape[-3] if len(shape) >= 3 else declared or 1


def channels_of(df: DataFrame, channel: str) -> DataFrame:
    """n, channels: rows and distinct channels of a table of pixels or planes."""
    return df.agg(F.count("*").alias("n"), F.count_distinct(channel).alias("channels"))
