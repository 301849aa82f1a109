"""Rules on small cases: Morton codes, transforms, associations, colours, slots, geometries, stores."""

import json
import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions import colours, morton, numbers, transforms
from lattica.model import Bounds, PointColumns, resolve_cap, resolve_render_cap
from lattica.operators import associations, catalog, index, points, raster, shapes
from lattica.sources import parquet, wkb, write, zarr
from lattica.sources.store import ENCODING_KEY, EXTRA_KEY, TABLE_TYPE, Store
from lattica.streaming.slots import Planner, Held, Resolution, Slot, adequate, classify

POINTS = PointColumns("x", "y", "row_id", name="name")


@pytest.mark.parametrize("n", [0, 1, 3])
def test_numbered_counts_rows_in_order(spark, n):
    df = spark.createDataFrame([(7 * i,) for i in reversed(range(n))], "k bigint")
    rows = associations.numbered(df, "k", "i").orderBy("i").collect()
    assert [(r["k"], r["i"]) for r in rows] == [(7 * i, i) for i in range(n)]


# Morton codes


def test_cover_of_the_whole_square():
    assert morton.cover(0, 0, 65535, 65535) == [(0, 2**32 - 1)]


def test_merge_spans():
    assert morton.merge_spans([(8, 9), (0, 3), (4, 5), (2, 2)]) == [(0, 5), (8, 9)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=4, max_size=4), st.integers(0, 255), st.integers(0, 255))
def test_cover_holds_exactly_what_lies_inside(c, px, py):
    x0, x1, y0, y1 = min(c[:2]), max(c[:2]), min(c[2:]), max(c[2:])
    code = sum(((px >> i) & 1) << (2 * i) | ((py >> i) & 1) << (2 * i + 1) for i in range(16))
    inside = x0 <= px <= x1 and y0 <= py <= y1
    assert any(lo <= code <= hi for lo, hi in morton.cover(x0, y0, x1, y1)) == inside


def test_codes_by_bits(spark):
    rows = spark.range(300).select((F.col("id") * 211 % 65536).alias("x"), (F.col("id") * 977 % 65536).alias("y"))
    for r in rows.withColumn("m", morton.interleave(F.col("x"), F.col("y"))).collect():
        assert r["m"] == sum(((r["x"] >> i) & 1) << (2 * i) | ((r["y"] >> i) & 1) << (2 * i + 1) for i in range(16))


def test_quantise_guards(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (-5.0,), (20.0,), (5.0,)], "v double")
    got = [r[0] for r in df.select(morton.quantise(F.col("v"), 0.0, 10.0)).collect()]
    assert got == [0, 0, 0, 65535, 32767]
    assert df.select(morton.quantise(F.col("v"), 3.0, 3.0)).distinct().collect()[0][0] == 0


def test_degenerate_corner():
    assert morton.corner(5, 5, Bounds(0, 3, 10, 3)) == (0, 0)


def test_markers_stand_in_front_once(spark):
    rows = [(0, 0.0, 3.0, "b"), (1, 10.0, 4.0, "a"), (2, 5.0, 20.0, "b"), (3, 2.0, 0.0, "c"), (4, 1e-5, 1e-5, "c")]
    df = spark.createDataFrame(rows, "row_id bigint, x double, y double, name string")
    got = index.sort_points(df, POINTS).select("row_id", "morton").collect()
    assert [r["row_id"] for r in got] == [0, 1, 3, 2, 4]
    assert [r["morton"] for r in got[:4]] == [0, 0, 0, 0]
    assert index.extremes(df.limit(1), POINTS).count() == 1


def test_verify_finds_a_fall(spark):
    rows = [(i, float(i % 10), float(i // 10), "a") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id bigint, x double, y double, name string")
    good = spark.createDataFrame([(*r, i) for i, r in enumerate(map(tuple, index.sort_points(df, POINTS).collect()))], "row_id bigint, x double, y double, name string, morton bigint, row_index bigint")
    assert {r["id"]: r["passed"] for r in index.verify(good, POINTS, "row_index").collect()} == {"marker_prefix": True, "marker_box": True, "tail_sorted": True}
    bad = good.withColumn("morton", F.when(F.col("row_index") == 20, 10**9).otherwise(F.col("morton")))
    assert not {r["id"]: r["passed"] for r in index.verify(bad, POINTS, "row_index").collect()}["tail_sorted"]


# scans


def test_selection_rules(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 1), (1, float("nan"), 1.0, 1), (2, 2.0, 2.0, None)], "row_id bigint, x double, y double, code int")
    assert points.filter_codes(df, "code", None).count() == 3
    assert points.filter_codes(df, "code", []).count() == 0
    assert points.filter_codes(df, None, [1]).count() == 0
    assert points.in_bounds(df, POINTS, Bounds(0, 0, 9, 9)).count() == 2


def test_matching_at_the_cap_is_truncated(spark):
    df = spark.createDataFrame([(i, 1.0, 1.0) for i in range(5)], "row_id bigint, x double, y double")
    assert points.matching(df, POINTS, F.lit(True), 5).first()["truncated"]
    assert not points.preload(df, "row_id", 5).first()["truncated"]


def test_caps():
    assert (resolve_cap(None), resolve_cap(-1), resolve_cap(2.9)) == (4_000_000, 4_000_000, 2)
    assert (resolve_render_cap(0), resolve_render_cap(float("inf")), resolve_render_cap(7.5)) == (None, None, 7)


def test_catalog_by_code_takes_the_first_name(spark):
    df = spark.createDataFrame([(0, 1, "b"), (1, 1, "z"), (2, None, "x"), (3, 0, None)], "row_id bigint, code int, name string")
    got = {r["code"]: (r["name"], r["count"]) for r in catalog.by_code(df, "code", "name", "row_id").collect()}
    assert got == {1: ("b", 2), 0: ("", 1)}


def test_code_column_choice():
    assert catalog.code_column(["feature_name_codes", "gene_codes"], "gene") == "gene_codes"
    assert catalog.code_column(["x", "feature_index"], "gene") == "feature_index"
    assert catalog.code_column(["x"], "gene") is None


# associations


def test_last_duplicate_wins_and_fallback(spark):
    rows = spark.createDataFrame([(0, "1", "a"), (1, "1", "a"), (2, "2", "b"), (3, "3", None)], "row_index int, id2 string, region string")
    feats = spark.createDataFrame([(1,), (2,), (9,)], "fid int")
    kept = associations.rows_of(rows, "region", associations.accepted_regions("shapes", "a"))
    got = {r["fid"]: r["row_index"] for r in associations.associate(feats, "fid", kept, "id2", "row_index").collect()}
    assert got == {1: 1, 2: -1, 9: -1}
    none = rows.where("region is not null")
    assert associations.rows_of(none, "region", ["zzz"]).count() == 3


# transforms


def test_sequence_order_and_permutation():
    m = transforms.sequence([transforms.translation([10.0, 20.0]), transforms.scale([2.0, 2.0])])
    assert (m @ [1, 1, 0, 1])[:3].tolist() == [22.0, 42.0, 0.0]
    assert (transforms.map_axis([1, 0]) @ [3, 4, 0, 1])[:2].tolist() == [4.0, 3.0]
    with pytest.raises(ValueError):
        transforms.map_axis([0, 0])


def test_affine_with_channel_axis():
    axes = [{"name": "c", "type": "channel"}, {"name": "y", "type": "space"}, {"name": "x", "type": "space"}]
    m = transforms.affine([[1, 0, 0, 0], [0, 2, 0, 5], [0, 0, 3, 7]], axes, axes)
    assert (m @ [1, 1, 0, 1])[:2].tolist() == [10.0, 7.0]


def test_missing_system_and_singular():
    with pytest.raises(transforms.MissingCoordinateSystemError) as e:
        transforms.to_system([{"type": "identity"}], "aligned")
    assert e.value.available == ["global"]
    with pytest.raises(transforms.SingularTransformError):
        transforms.inverse(transforms.scale([0.0, 1.0]))


def test_path_takes_edges_backwards():
    m = transforms.path([("b", "a", transforms.translation([1.0, 2.0]))], "a", "b")
    assert m[:2, 3].tolist() == [-1.0, -2.0]


# colours


def test_numbers_in_text(spark):
    rows = spark.createDataFrame([("1e3",), (" 2 ",), ("0x10",), ("NaN",), ("",), ("1d",)], "v string")
    assert [r[0] for r in rows.select(numbers.number(F.col("v"), True)).collect()] == [1000.0, 2.0, None, None, None, None]


def test_ramp_ends_and_middle(spark):
    got = [r[0] for r in spark.createDataFrame([(-1.0,), (0.5,), (2.0,)], "t double").select(colours.ramp(F.col("t"), [[0, 0, 0], [10, 20, 30], [255, 255, 255]])).collect()]
    assert got == [[0, 0, 0], [10, 20, 30], [255, 255, 255]]


def test_bounds_of_circles_and_empty(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (9.0, 9.0, -1.0), (5.0, float("nan"), 100.0)], "x double, y double, r double")
    assert tuple(shapes.circle_bounds(df, "x", "y", "r").first()) == (-1.0, -1.0, 9.0, 9.0)
    assert shapes.circle_bounds(df.limit(0), "x", "y", "r").first()[0] is None
    assert shapes.kind_of(["radius"]) == "circle" and shapes.kind_of([], ["Point"]) == "point" and shapes.kind_of([], ["Polygon"]) == "polygon"


def test_scale_factors():
    assert raster.scale_factors([1024, 600], None, 2, 256) == [2, 2]
    assert raster.scale_factors([4, 4], 5) == [2, 2]


# geometries


def test_wkb_forms():
    ring = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    one = wkb.encode_polygon(ring)
    many = struct.pack("<BII", 1, 6, 2) + one + wkb.encode_polygon([(5.0, 5.0)] * 4)
    assert [(p["x"], p["y"]) for p in wkb.exterior(one)] == ring == [(p["x"], p["y"]) for p in wkb.exterior(many)]
    assert wkb.exterior(wkb.encode_point(1, 2)) == [] and wkb.exterior(None) == []
    assert wkb.first_point(many) == {"x": 0.0, "y": 0.0}
    big = struct.pack(">BI3d", 0, 1001, 1, 2, 3)
    assert wkb.first_point(big) == {"x": 1.0, "y": 2.0}


# slots


def test_slot_shares_supersedes_and_keeps():
    s = Slot()
    assert s.request("a", lambda p: 1).value == 1
    assert s.request("a", lambda p: 2).value == 1
    assert s.request("b", lambda p: 3) == Resolution("ready", 3)

    def cancelled(p):
        raise InterruptedError

    assert s.request("c", cancelled).value == 3 and s.key == "b"
    failed = s.request("d", lambda p: 1 / 0)
    assert failed.state == "failed" and failed.value == 3
    assert classify(TimeoutError()) == ("timeout", True)


def test_superseded_result_is_dropped():
    s = Slot()

    def outer(progress):
        s.request("new", lambda p: "new")
        progress("late")
        return "old"

    s.request("old", outer)
    assert s.now == Resolution("ready", "new")


def test_reuse_rules():
    assert adequate(False, 1, 100) and adequate(True, 100, 100) and not adequate(True, 99, 100)
    p = Planner(Held(frozenset({1, 2}), 10, False), (frozenset({3, 4}), 100))
    assert [p.plan(c, 100) for c in ([1], [3], [5], None)] == ["reuse", "wait", "scan", "scan"]
    assert Planner(Held(frozenset({1}), 10, True)).plan([1], 50) == "scan"


# stores


def _v2(path, name, values, text=False, attrs=None):
    os.makedirs(f"{path}/{name}", exist_ok=True)
    meta = {"zarr_format": 2, "shape": [len(values)], "chunks": [2], "order": "C", "fill_value": 0, "compressor": {"id": "zlib", "level": 1}, "filters": [{"id": "vlen-utf8"}] if text else None, "dtype": "|O" if text else "<i4"}
    json.dump(meta, open(f"{path}/{name}/.zarray", "w"))
    json.dump(attrs or {}, open(f"{path}/{name}/.zattrs", "w"))
    import zlib

    for i in range(0, len(values), 2):
        part = list(values[i : i + 2]) + [values[-1]] * (2 - len(values[i : i + 2]))
        body = struct.pack("<I", 2) + b"".join(struct.pack("<I", len(v)) + v.encode() for v in part) if text else np.array(part, "<i4").tobytes()
        open(f"{path}/{name}/{i // 2}", "wb").write(zlib.compress(body))


def _group(path, attrs=None):
    os.makedirs(path, exist_ok=True)
    json.dump({"zarr_format": 2}, open(f"{path}/.zgroup", "w"))
    json.dump(attrs or {}, open(f"{path}/.zattrs", "w"))


@pytest.fixture
def store(spark, tmp_path):
    root = f"{tmp_path}/s.zarr"
    _group(root)
    for k in ("points", "shapes", "tables"):
        _group(f"{root}/{k}")
    _group(f"{root}/points/tx", {"axes": ["x", "y"], EXTRA_KEY: {"feature_key": "gene", "instance_key": "cell"}, "coordinateTransformations": [{"type": "scale", "scale": [2.0, 2.0], "output": {"name": "aligned"}}]})
    _group(f"{root}/points/broken", {})
    pq.write_table(pa.table({"x": [0.0, 1.0], "y": [0.0, 1.0], "gene": ["a", "b"], "gene_codes": [0, 1]}), f"{root}/points/tx/points.parquet")
    _group(f"{root}/tables/t", {"region": "cells", "region_key": "region", "instance_key": "cell", ENCODING_KEY: TABLE_TYPE})
    _group(f"{root}/tables/t/obs", {"_index": "cell", "column-order": ["region", "kind"]})
    _v2(f"{root}/tables/t/obs", "cell", [10, 11, 12])
    _v2(f"{root}/tables/t/obs", "region", ["cells", "cells", "other"], text=True)
    _group(f"{root}/tables/t/obs/kind", {"encoding-type": "categorical"})
    _v2(f"{root}/tables/t/obs/kind", "codes", [1, -1, 0])
    _v2(f"{root}/tables/t/obs/kind", "categories", ["T", "B"], text=True)
    return Store.open(spark, root)


def test_store_isolates_faults_and_lists(store):
    assert list(store.elements["points"]) == ["tx"] and store.bad_files().first()["path"] == "points/broken"
    assert store.systems() == ["aligned"] and store.available("aligned") == [("points", "tx")]
    assert store.tables_for("shapes", "cells") == ["t"]
    df, c = store.points("tx")
    assert (c.x, c.name, c.code) == ("x", "gene", "gene_codes") and df.count() == 2
    assert "tx" in str(store)


def test_store_columns(store):
    assert store.obs_kinds("t") == {"region": "string", "kind": "categorical"}
    got = {r["id"]: r["kind"] for r in store.obs("t", ["kind"]).collect()}
    assert got == {"10": "B", "11": None, "12": "T"}
    assert store.annotation_rows("shapes", "cells", "t").count() == 2
    assert zarr.node_table(store.spark, store.nodes).where("kind = 'array'").count() == 4


def test_unknown_codec_is_reported():
    with pytest.raises(zarr.UnsupportedCodecError):
        zarr._codec({"dtype": "<i4", "compressor": {"id": "blosc"}})


def test_consolidation():
    out = write.consolidate({"a/b": {"meta": {"node_type": "group"}, "attrs": {}}})
    assert set(out["metadata"]) == {"a", "a/b"}
    assert "points/p" in write.register(out, "points", "p", {})["metadata"]


# sinks


def test_exact_row_groups_and_footers(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 11), f"g{i % 3}") for i in range(50)], "row_id bigint, x double, y double, name string")
    write.write_exact_groups(df, POINTS, f"{tmp_path}/p/part.0.parquet", 20)
    meta = pq.ParquetFile(f"{tmp_path}/p/part.0.parquet").metadata
    marks = index.extremes(df, POINTS).count()
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)][:2] == [marks, 20] and meta.num_rows == 50
    footer = parquet.row_groups(spark, parquet.parts(f"{tmp_path}/p"))
    t = parquet.tiling(footer)
    assert (t.rows, t.row_groups, t.rows_by_part) == (50, meta.num_row_groups, {0: 50})
    back = parquet.read(spark, f"{tmp_path}/p")
    assert {r["passed"] for r in index.verify(back, POINTS, "row_index").collect()} == {True}


def test_layouts(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i), float(i % 5), f"g{i % 2}") for i in range(20)], "row_id bigint, x double, y double, name string")
    m = write.write_layouts(df, POINTS, str(tmp_path))
    assert m["rows"] == 20 and m["scenario"]["min_x"] == 4.75
    for name in index.LAYOUTS:
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == 20
    assert json.loads(write.multiscale_metadata(df, POINTS))["n_points"] == 20
