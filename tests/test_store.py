"""Variables, matrices and numeric arrays of a store; decoded points and tiles; results and chunk rules."""

import json
import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lattica.functions import colours
from lattica.model import Bounds, PointColumns
from lattica.operators import points, raster
from lattica.sources import write, zarr
from lattica.sources.store import Store
from lattica.streaming.slots import Resolution


def group(path, attrs=None):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/.zgroup", "w") as f:
        json.dump({"zarr_format": 2}, f)
    with open(f"{path}/.zattrs", "w") as f:
        json.dump(attrs or {}, f)


def array(path, values, chunks=None):
    """A format-2 array; text is of variable length."""
    os.makedirs(path, exist_ok=True)
    v = np.array(values)
    text = v.dtype.kind == "U"
    chunks = chunks or list(v.shape)
    meta = {"zarr_format": 2, "shape": v.shape, "chunks": chunks, "dtype": "|O" if text else v.dtype.str, "compressor": None, "fill_value": None if text else 0, "order": "C", "filters": [{"id": "vlen-utf8"}] if text else None}
    with open(f"{path}/.zarray", "w") as f:
        json.dump(meta, f)
    for at in np.ndindex(*[-(-n // c) for n, c in zip(v.shape, chunks, strict=True)]):
        part = v[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        if text:
            data = struct.pack("<I", len(part)) + b"".join(struct.pack("<I", len(s.encode())) + s.encode() for s in part)
        else:
            full = np.zeros(chunks, v.dtype)
            full[tuple(map(slice, part.shape))] = part
            data = full.tobytes()
        with open(f"{path}/{'.'.join(map(str, at))}", "wb") as f:
            f.write(data)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = f"{tmp_path_factory.mktemp('store')}/s.zarr"
    for g in ("", "tables", "tables/t/obsm", "points"):
        group(f"{root}/{g}")
    group(f"{root}/tables/t", {"region": "cells", "region_key": "region", "instance_key": "cell"})
    group(f"{root}/tables/t/obs", {"_index": "cell", "column-order": []})
    array(f"{root}/tables/t/obs/cell", [1, 2, 3])
    group(f"{root}/tables/t/var", {"_index": "gene"})
    array(f"{root}/tables/t/var/gene", ["g1", "g2"])
    array(f"{root}/tables/t/var/symbol", ["ABC", ""])
    array(f"{root}/tables/t/obsm/umap", np.arange(12.0).reshape(3, 4), [2, 2])
    array(f"{root}/tables/t/X", np.arange(6).reshape(3, 2))
    group(f"{root}/points/tx", {"axes": ["x", "y"], "spatialdata_attrs": {"feature_key": "gene"}})
    os.makedirs(f"{root}/points/tx/points.parquet")
    for i in range(2):
        pq.write_table(pa.table({"x": np.arange(100.0) + i, "y": np.arange(100.0)[::-1] * (i + 1), "gene": ["a", "b"] * 50}), f"{root}/points/tx/points.parquet/part.{i}.parquet")
    return Store.open(spark, root)


def test_variables_and_aliases(store):
    assert [r["id"] for r in store.var("t").orderBy("row_index").collect()] == ["g1", "g2"]
    assert [r["label"] for r in store.var("t", "symbol").orderBy("row_index").collect()] == ["ABC (g1)", "g2"]


def test_matrices(store):
    assert [tuple(r) for r in store.obsm("t", "umap", [0, 3]).orderBy("row_index").collect()] == [(0, 0.0, 3.0), (1, 4.0, 7.0), (2, 8.0, 11.0)]
    assert {(r["row"], r["col"]): r["value"] for r in store.matrix("t").collect()} == {(i, j): 2 * i + j for i in range(3) for j in range(2)}
    with pytest.raises(ValueError):
        zarr.numeric(store.spark, store.root, store.nodes, "tables/t/var/gene")
    with pytest.raises(KeyError):
        zarr.numeric(store.spark, store.root, store.nodes, "tables/t/none")


def test_keys_of_a_table(store):
    keys = store.table_keys("t")
    assert keys.regions == ("cells",) and keys.instance_key == "cell"


def test_morton_layout_of_a_store(store, tmp_path):
    done = write.morton_from_store(store, folder=f"{tmp_path}/sorted")
    assert done["points"] == "tx" and done["rows"] == 200
    back = store.spark.read.parquet(f"{tmp_path}/sorted")
    assert back.count() == 200 and back.select("row_id").distinct().count() == 200
    with pytest.raises(KeyError):
        write.morton_from_store(store, "none")


def test_decoded_points(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0, "b", 4), (1, 3.0, 4.0, None, None), (2, 5.0, 6.0, "b", 4)], "row_id long, x double, y double, gene string, code int")
    c = PointColumns("x", "y", "row_id", name="gene")
    rows, found = points.decoded(df.drop("code"), c)
    assert [r["code"] for r in rows.orderBy("row_id").collect()] == [0, -1, 0] and {r["name"]: r["count"] for r in found.collect()} == {"b": 2, "": 1}
    rows, found = points.decoded(df, PointColumns("x", "y", "row_id", name="gene", code="code"))
    assert [r["code"] for r in rows.orderBy("row_id").collect()] == [4, -1, 4] and found.first()["code"] == 4
    assert points.positions(df, PointColumns("x", "y", "row_id", code="code"), codes=True).columns == ["row_id", "position", "code"]
    tiles = points.tiled(df, c, Bounds(0.5, 0.5, 3.5, 4.0), 2.0)
    assert sorted((r["row_id"], r["tile_x"], r["tile_y"]) for r in tiles.collect()) == [(0, 0, 1), (1, 1, 2)]


def test_results():
    assert Resolution("ready", 3).unwrap() == 3 == Resolution("ready", 3).unwrap_or(4)
    assert Resolution("failed", 3, OSError()).unwrap_or(4) == 4 == Resolution().unwrap_or(4)
    for r, e in ((Resolution("failed", None, OSError("x")), OSError), (Resolution(), LookupError)):
        with pytest.raises(e):
            r.unwrap()


def test_indexers_and_chunks():
    assert raster.indexer(["c", "y", "x"], {"c": 2}) == [2, slice(None), slice(None)]
    assert raster.checked_chunks(["c", "y", "x"], [1, 64, 64]) == (1, 64, 64) and raster.auto_chunks([3, 700, 40], ["c", "y", "x"]) == (1, 512, 40)
    for bad in ([2, 64, 64], [1, 64], [1, 0, 4]):
        with pytest.raises(ValueError):
            raster.checked_chunks(["c", "y", "x"], bad)


def test_palettes_by_value(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "v string")
    assert [r[0] for r in df.select(colours.palette_by_value(F.col("v"), {"a": [1, 2, 3, 4]}, [9, 9, 9, 9])).collect()] == [[1, 2, 3, 4], [9, 9, 9, 9], [9, 9, 9, 9]]
    assert df.select(colours.palette_by_value(F.col("v"), {})).first()[0] == [128, 128, 128, 255]
