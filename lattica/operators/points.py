"""Scans and filters of point tables.

Rules that hold throughout: a selection of None is everything and an empty one nothing; a code
filter without a code column matches nothing; boxes are closed; rows with a non-finite x or y
are dropped and a non-finite z is 0; order is that of the row id.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.numbers import finite
from lattica.model import Bounds, PointColumns, resolve_cap
from lattica.operators import catalog, index
from lattica.session import checkpointed


def code_predicate(code: Column | None, codes: Sequence[int] | None) -> Column:
    if codes is None:
        return F.lit(True)
    if not codes or code is None:
        return F.lit(False)
    return code.isin([int(c) for c in codes])


def filter_codes(df: DataFrame, code: str | None, codes: Sequence[int] | None) -> DataFrame:
    return df if codes is None else df.where(code_predicate(None if code is None else F.col(code), codes))


def filter_names(df: DataFrame, name: str, names: Sequence[str] | None) -> DataFrame:
    if names is None:
        return df
    return df.where(F.col(name).isin(list(names))) if names else df.where(F.lit(False))


def in_bounds(df: DataFrame, c: PointColumns, bounds: Bounds) -> DataFrame:
    """The box as plain range predicates, which reach the Parquet scan and its statistics."""
    x, y = F.col(c.x), F.col(c.y)
    return df.where(x.between(bounds.min_x, bounds.max_x) & y.between(bounds.min_y, bounds.max_y) & finite(x) & finite(y))


def not_sentinel(row_index: Column, morton: Column) -> Column:
    """False for the marker rows at the head of a sorted file: its first four, with code 0."""
    return ~((row_index < 4) & (morton == 0))


#: Integer types, whose rows can be cut at a threshold.
_WHOLE = ("tinyint", "smallint", "int", "bigint")
BUCKETS = 4096


def in_view(df: DataFrame, c: PointColumns, every: Bounds, box: Bounds, codes: Sequence[int] | None = None, depth: int = 6) -> DataFrame:
    """The box over a table sorted by Morton code: spans of codes as plain predicates, then the exact box.

    The spans cover the box, and reach the scan's row-group and page statistics, so groups that hold
    none of them aren't read; marker rows (code 0 in front) lie in the first. Without a Morton
    column the whole table is filtered.
    """
    rows = in_bounds(df, c, box)
    if c.morton is not None:
        morton = F.col(c.morton)
        spans = index.spans(every, box, depth)
        keep = F.lit(False)
        for low, high in spans:  # a cover has a bounded number of spans
            keep = keep | morton.between(low, high)
        rows = rows.where(keep | (morton == 0))
    return filter_codes(rows, c.code, codes)


def _cut(ids: DataFrame, n: int) -> tuple[int, int, int, int]:
    """(id of the n-th row, rows below it, rows with it, all rows) of a column ``id`` without ordering.

    Histograms of equal ranges, the crossing one again: BUCKETS rows a round come to the driver."""
    r = ids.agg(F.min("id"), F.max("id"), F.count("id")).first()
    low, high, total = r
    if total <= n:
        return high if high is not None else 0, total, 0, total
    below = 0
    while True:
        width = (high - low) // BUCKETS + 1
        some = ids.where(F.col("id").between(low, high)).groupBy(F.floor((F.col("id") - F.lit(low)) / width).alias("b")).agg(F.count("*").alias("n"))
        for x in sorted(some.collect(), key=lambda x: x["b"]):
            if below + x["n"] >= n:
                break
            below += x["n"]
        if width == 1:
            return low + x["b"], below, x["n"], total
        low, high = low + x["b"] * width, min(high, low + (x["b"] + 1) * width - 1)


def _first(df: DataFrame, row_id: str, n: int) -> tuple[DataFrame, int | None]:
    """(the first n rows, the number of all where it was counted)."""
    if dict(df.dtypes).get(row_id) not in _WHOLE:
        return df.orderBy(row_id).limit(n), None
    at, below, here, total = _cut(df.select(F.col(row_id).cast("bigint").alias("id")).where("id is not null"), n)
    if total <= n:
        return df, total
    if below + here == n:
        return df.where(F.col(row_id) <= at), total
    return df.where(F.col(row_id) < at).unionByName(df.where(F.col(row_id) == at).limit(n - below)), total


def first_rows(df: DataFrame, row_id: str, cap: float | None) -> tuple[DataFrame, int]:
    """(the rows of the least ids up to the cap, the cap): by a threshold, so nothing is ordered or brought together."""
    n = resolve_cap(cap)
    return _first(df, row_id, n)[0], n


def preload(df: DataFrame, row_id: str, cap: float | None) -> DataFrame:
    """The first rows up to the cap, with total_rows and truncated (total over the cap)."""
    n = resolve_cap(cap)
    rows, total = _first(df, row_id, n)
    total = df.count() if total is None else total
    return rows.withColumn("total_rows", F.lit(total).cast("bigint")).withColumn("truncated", F.lit(total > n))


def matching(df: DataFrame, c: PointColumns, keep: Column, cap: float | None) -> DataFrame:
    """Matching finite rows up to the cap; truncated is true if the cap was reached."""
    found = df.where(keep & finite(F.col(c.x)) & finite(F.col(c.y)))
    if c.z:
        found = found.withColumn(c.z, F.when(finite(F.col(c.z)), F.col(c.z)).otherwise(F.lit(0.0)))
    n = resolve_cap(cap)
    rows, total = _first(found, c.row_id, n)
    return rows.withColumn("truncated", F.lit((found.count() if total is None else total) >= n))


def _code(c: PointColumns, codes: bool) -> list[Column]:
    return [F.coalesce(F.col(c.code).cast("int"), F.lit(catalog.MISSING)).alias("code")] if codes and c.code else []


def geometry(df: DataFrame, c: PointColumns, codes: bool = False) -> DataFrame:
    """row_id and the axes as 32-bit floats; z where there is one, and the code if it is wanted and there is one."""
    axes = [F.col(a).cast("float").alias(n) for n, a in (("x", c.x), ("y", c.y), ("z", c.z)) if a]
    return df.select(F.col(c.row_id).alias("row_id"), *axes, *_code(c, codes))


def positions(df: DataFrame, c: PointColumns, codes: bool = False) -> DataFrame:
    """row_id and [x, y, z], z being 0 in two dimensions; the code if it is wanted and there is one."""
    z = F.coalesce(F.col(c.z), F.lit(0.0)) if c.z else F.lit(0.0)
    return df.select(F.col(c.row_id).alias("row_id"), F.array(F.col(c.x).cast("double"), F.col(c.y).cast("double"), z.cast("double")).alias("position"), *_code(c, codes))


def decoded(df: DataFrame, c: PointColumns) -> tuple[DataFrame, DataFrame]:
    """(row_id, axes and code of each row; the catalogue of names): by the code column, else in order of first sight."""
    if c.code:
        return geometry(df, c, codes=True), catalog.by_code(df, c.code, c.name, c.row_id)
    found = checkpointed(catalog.first_seen(df, c.name, c.row_id))
    return geometry(catalog.row_codes(df, found, c.name), replace(c, code="code"), codes=True), found


def tile_counts(df: DataFrame, c: PointColumns, origin: tuple[float, float], size: float) -> DataFrame:
    tile = lambda a, o: F.floor((F.col(a) - F.lit(o)) / F.lit(size)).cast("bigint")
    return df.where(finite(F.col(c.x)) & finite(F.col(c.y))).groupBy(tile(c.x, origin[0]).alias("tile_x"), tile(c.y, origin[1]).alias("tile_y")).agg(F.count("*").alias("n"))


def tiled(df: DataFrame, c: PointColumns, view: Bounds, size: float, codes: Sequence[int] | None = None) -> DataFrame:
    """The points of each tile of a view, with tile_x and tile_y: tiles begin at 0, and those that the view meets are whole."""
    low_x, low_y = (int(v // size) for v in (view.min_x, view.min_y))
    high_x, high_y = (int(v // size) for v in (view.max_x, view.max_y))
    box = Bounds(low_x * size, low_y * size, (high_x + 1) * size, (high_y + 1) * size)
    tile = lambda a: F.floor(F.col(a) / F.lit(size)).cast("bigint")
    rows = filter_codes(in_bounds(df, c, box), c.code, codes).withColumn("tile_x", tile(c.x)).withColumn("tile_y", tile(c.y))
    return rows.where(F.col("tile_x").between(low_x, high_x) & F.col("tile_y").between(low_y, high_y))


def seeded_sample(df: DataFrame, row_id: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, the same ones whenever the seed is: those of the least hash of seed and row id.

    The hash is 60 bits of an MD5 digest; rows beyond its n-th value are cut by a threshold.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    return _first(df.withColumn("_hash", h), "_hash", n)[0].drop("_hash")


def hide(df: DataFrame, key: str, hidden: DataFrame) -> DataFrame:
    """The rows whose key isn't hidden."""
    return df.join(hidden.select(key).distinct(), key, "left_anti")


def concat_chunks(chunks: Sequence[DataFrame], code: str | None = None) -> DataFrame:
    """All chunks as one; the code column stays only if every chunk has it."""
    if code is not None and not all(code in c.columns for c in chunks):
        chunks = [c.drop(code) for c in chunks]
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c)
    return out


def to_batch(df: DataFrame, c: PointColumns) -> DataFrame:
    """Point data as a columnar batch: x, y, z (0 without one), code where there is one, all as numbers."""
    z = F.coalesce(F.col(c.z), F.lit(0.0)) if c.z else F.lit(0.0)
    code = [F.col(c.code).cast("int").alias("code")] if c.code else []
    return df.select(F.col(c.row_id).alias("row_id"), F.col(c.x).cast("float").alias("x"), F.col(c.y).cast("float").alias("y"), z.cast("float").alias("z"), *code)


def from_batch(batch: DataFrame) -> DataFrame:
    """A columnar batch as point data: row_id, position [x, y, z], and code (-1 without one)."""
    code = F.coalesce("code", F.lit(-1)) if "code" in batch.columns else F.lit(-1)
    return batch.select("row_id", F.array(*[F.col(a).cast("double") for a in "xyz"]).alias("position"), code.cast("int").alias("code"))
