"""Well-known binary geometries, decoded by Arrow batches."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT_XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT_XY)
POINT, POLYGON, MULTIPOINT, MULTIPOLYGON, COLLECTION = 1, 3, 4, 6, 7


def check_column(df: DataFrame, name: str = "geometry") -> None:
    if name not in df.columns:
        raise KeyError(f"no geometry column {name!r}")
    if not isinstance(df.schema[name].dataType, T.BinaryType):
        raise TypeError("the geometry column must be binary")
    encoding = df.schema[name].metadata.get("ARROW:extension:name", "geoarrow.wkb")
    if encoding != "geoarrow.wkb":
        raise ValueError(f"geometry encoding {encoding!r} isn't known")


def _header(b: bytes, at: int) -> tuple[str, int, int, int]:
    """(byte order, kind, dimensions, next position); Z, M and SRID forms are read."""
    end = "<" if b[at] == 1 else ">"
    (code,) = struct.unpack_from(f"{end}I", b, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    kind, dims = code & 0xFF if code >= 1 << 28 else code % 1000, 2
    dims += bool(code & 0x80000000) + bool(code & 0x40000000) + {1: 1, 2: 1, 3: 2}.get(code % (1 << 28) // 1000, 0)
    return end, kind, dims, at


def exterior(b: bytes | None) -> list[dict]:
    """The first polygon's exterior ring; an empty list for other kinds."""
    if not b:
        return []
    end, kind, dims, at = _header(b, 0)
    if kind == MULTIPOLYGON:
        (n,) = struct.unpack_from(f"{end}I", b, at)
        if not n:
            return []
        end, kind, dims, at = _header(b, at + 4)
    if kind != POLYGON:
        return []
    (rings,) = struct.unpack_from(f"{end}I", b, at)
    if not rings:
        return []
    (n,) = struct.unpack_from(f"{end}I", b, at + 4)
    v = struct.unpack_from(f"{end}{n * dims}d", b, at + 8)
    return [{"x": v[i], "y": v[i + 1]} for i in range(0, len(v), dims)]


def first_point(b: bytes | None) -> dict | None:
    """The first coordinate of a geometry of any kind."""
    at = 0
    while b:
        end, kind, dims, at = _header(b, at)
        if kind == POINT:
            x, y = struct.unpack_from(f"{end}2d", b, at)
            return {"x": x, "y": y}
        (n,) = struct.unpack_from(f"{end}I", b, at)
        at += 4
        if not n:
            return None
        if kind == POLYGON:
            at += 4
        if kind in (2, POLYGON):
            x, y = struct.unpack_from(f"{end}2d", b, at)
            return {"x": x, "y": y}
    return None


@F.pandas_udf(RING)
def exterior_ring(wkb: pd.Series) -> pd.Series:
    return wkb.map(exterior)


@F.pandas_udf(POINT_XY)
def point_xy(wkb: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([first_point(b) or {"x": None, "y": None} for b in wkb], columns=["x", "y"])


def encode_polygon(ring: list[tuple[float, float]]) -> bytes:
    return struct.pack("<BIII", 1, POLYGON, 1, len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring)


def encode_point(x: float, y: float) -> bytes:
    return struct.pack("<BI2d", 1, POINT, x, y)


@F.pandas_udf(T.BinaryType())
def polygon_wkb(ring: pd.Series) -> pd.Series:
    return ring.map(lambda r: None if r is None else encode_polygon([(p["x"], p["y"]) for p in r]))
