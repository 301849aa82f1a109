"""Small cases of joins, colours, caches, resolvers, settings and progressive catalogues."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import colours, text
from lattica.operators import associations, catalog, decisions, raster, render, shapes
from lattica.sources import zarr
from lattica.streaming import progressive, slots


def test_catalogues_are_broadcast_by_their_count(spark):
    """However large the table is that a catalogue was made from, its joins don't shuffle rows."""
    rows = spark.range(50_000).selectExpr("id", "concat('g', id % 7) as gene")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        known = catalog.sorted_codes(rows, "gene")
        for df in (
            catalog.row_codes(rows, known, "gene"),
            catalog.remap(rows.withColumn("code", (F.col("id") % 3).cast("int")), "code", known, known),
            associations.decode(rows.withColumn("c", (F.col("id") % 3).cast("int")), "c", known.select("code", "name"), "name"),
        ):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_values_of_annotation_rows(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (3, 2, None)], "inst int, n int, t string")
    features = spark.createDataFrame([("1",), ("2",), ("3",)], "id_ string")
    got = {r["id_"]: r["value"] for r in associations.column_for(features, "id_", rows, "inst", "n", "t").collect()}
    assert got == {"1": "b", "2": None, "3": None}
    assert {r["id_"]: r["tooltip"] for r in associations.label_tooltips(features, "id_", rows, "inst", "n", "t").collect()} == {"1": "b", "2": "", "3": ""}
    aligned = features.withColumn("row_index", F.lit(7))
    assert {r["row_index"] for r in associations.shape_tooltips(aligned, "id_", rows, "inst", "n", True).collect()} == {7}
    assert {r["id_"]: r["row_index"] for r in associations.shape_tooltips(aligned, "id_", rows, "inst", "n", False).collect()} == {"1": 1, "2": -1, "3": 2}


def test_systems_in_order_of_appearance(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 0)], "s string, n int")
    assert [r["s"] for r in associations.systems_of(rows, "s", "n").collect()] == ["c", "b", "a"]
    elements = spark.createDataFrame([("x", ["a", "b"]), ("y", ["b"])], "e string, systems array<string>")
    assert [r["e"] for r in associations.in_system(elements, "systems", "a").collect()] == ["x"]


def test_codes_follow_a_better_catalogue(spark):
    preview = spark.createDataFrame([(0, "b"), (1, "a")], "code int, name string")
    full = spark.createDataFrame([(0, "a"), (1, "c")], "code int, name string")
    rows = spark.createDataFrame([(0,), (1,), (-1,)], "code int")
    assert sorted(r["code"] for r in catalog.upgraded(rows, "code", preview, full).collect()) == [-1, -1, 0]
    assert catalog.code_space(None, spark).first()["size"] == 0 and catalog.code_space(full).first()["size"] == 2
    assert sorted(r["name"] for r in catalog.names_of(preview, full, name="name").collect()) == ["a", "b", "c"]


def test_two_phases_show_the_preview_first(spark):
    shown = []
    progressive.two_phase_catalog(lambda: 1, lambda: 2, lambda c, phase: shown.append((c, phase)))
    assert shown == [(1, "preview"), (2, "full")]

    def broken():
        raise OSError

    shown.clear()
    assert progressive.two_phase_catalog(broken, lambda: 3, lambda c, phase: shown.append(phase)) == 3 and shown == ["full"]


def test_progressive_codes_never_change(spark, tmp_path):
    for i, names in enumerate((["b", "d"], ["a", "b", None], ["c", "a"])):
        spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    df = spark.readStream.schema("name string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    seen = []
    out = progressive.catalog(spark, df, "name", f"{tmp_path}/state", lambda c: seen.append({r["name"]: r["code"] for r in c.collect()}))
    last = {r["name"]: r["code"] for r in out.collect()}
    assert sorted(last.values()) == list(range(5)) and set(last) == {"a", "b", "c", "d", ""}
    assert all(s.items() <= last.items() for s in seen)


def test_colours_and_picks(spark):
    df = spark.createDataFrame([(1.0, [9, 8, 7]), (2.6, [9, 8, 7]), (float("nan"), [9, 8, 7]), (-1.0, [9, 8, 7])], "v double, b array<int>")
    alphas = F.array(F.lit(255), F.lit(0), F.lit(255), F.lit(255))
    r = df.select(
        colours.colour_at(F.col("b"), F.lit(2), 2).alias("out"), colours.colour_at(F.col("b"), F.lit(1), 2).alias("in"), colours.colour_at(F.col("b"), F.lit(5)).alias("far"),
        colours.picked_label(F.col("v"), alphas).alias("pick"), colours.highlight_id(F.col("v"), alphas).alias("light"), colours.signature(F.lit("a"), F.lit("b")).alias("s"),
    ).collect()
    assert {x["out"] for x in r} == {None} == {x["far"] for x in r} and {x["in"] for x in r} == {8} and r[0]["s"] == "a:b"
    assert [x["pick"] for x in r] == [None, 2, None, None] and [x["light"] for x in r] == [None, 3, None, None]
    table = colours.palette_table(spark, 5000, spark.createDataFrame([(1, [1, 2, 3])], "code bigint, colour array<int>"))
    assert table.count() == 5001 and table.where("code = 1").first()["colour"] == [1, 2, 3]
    shared = colours.SharedColours(lambda *a: list(a))
    assert shared.get("ramp", 1) is shared.get("ramp", 1) and shared.get("ramp", 2) is not shared.get("ramp", 1)


def test_stack_entries_and_layers(spark):
    stack = spark.createDataFrame([("b", 0, "h1", "points", {"size": "2.5"}), (None, 1, "h1", "points", None), ("a", 2, "h2", "points", {"size": "x"}), ("b", 3, "h1", "points", {"size": "NaN"})], "id string, ord int, host string, kind string, props map<string,string>")
    assert [r["id"] for r in render.entry_ids(stack).collect()] == ["b", "a"] and [r["id"] for r in render.entry_ids(stack, host="h2").collect()] == ["a"]
    assert sorted(r["size"] for r in render.layer_inputs(stack, "points", {"size": 1.0}).collect()) == [1.0, 1.0, 1.0, 2.5]
    assert spark.range(1).select(render.zoom_size(F.lit(3), 1, 0.5, 3.0)).first()[0] == 3.0


def test_caches_compute_once(spark):
    df = raster.synthetic(spark, 8, 8, channels=3)
    cache = raster.StatsCache(["c", "z"])
    first = cache.get("im", df, [{"c": 0, "z": 0}, {"c": 2, "z": 0}])
    assert cache.scans == 1 and first[0]["lo"] == 0.0 and cache.get("im", df, [{"c": 2, "z": 0}]) == first[1:] and cache.scans == 1
    cache.get("im", df, [{"c": 2, "z": 0}, {"c": 1, "z": 0}])
    assert cache.scans == 2 and len(cache.held) == 3
    cache.drop("im")
    assert not cache.held
    bounds, runs = render.BoundsCache(), []

    def compute():
        runs.append(1)
        return shapes.point_bounds(spark.range(5).selectExpr("id * 1.0 as x", "-id * 1.0 as y"), "x", "y")

    m = np.eye(4)
    assert bounds.get("e", 1, m, compute) == bounds.get("e", 1, m.copy(), compute) and len(runs) == 1
    bounds.get("e", 2, m, compute)
    bounds.drop("e")
    assert len(runs) == 2 and not bounds.held


def test_raster_shapes():
    assert raster.bounding_cube({"x": 4, "y": 6, "z": 2}, {"z": 3.0}) == ((0.0, 4.0), (0.0, 6.0), (0.0, 6.0))
    assert [raster.channel_count(s, a, d) for s, a, d in (((5, 9, 9), ("c", "y", "x"), None), ((7, 9, 9), (), None), ((9, 9), ("y", "x"), 3), ((9, 9), (), None))] == [5, 7, 3, 1]
    assert decisions.label_channels([{"z": 1}], 255.0) == decisions.Channels([(255, 255, 255)], [(0.0, 255.0)], [True], [{"z": 1}])
    assert len(raster.PALETTE) == 8 and raster.PALETTE[4] == (255, 128, 0)


def test_settings_are_merged_by_key():
    config = {"codec": {"id": "a", "level": 5}, "chunk": 4, "elements": {"im": {"codec": {"level": 9}, "extra": [1]}}}
    assert text.settings_for(config, "im") == {"codec": {"id": "a", "level": 9}, "chunk": 4, "extra": [1]}
    assert text.settings_for(config, "other") == {"codec": {"id": "a", "level": 5}, "chunk": 4}
    assert text.merged({"a": {"b": 1}}, {"a": 2}) == {"a": 2} and config["codec"]["level"] == 5


def test_keys_paths_and_json(spark):
    df = spark.createDataFrame([("a b",), ("a/b",), (" ",), ("..",), (".x",)], "k string")
    assert [r[0] for r in df.select(text.points_key(F.col("k"))).collect()] == [True, False, False, False, True]
    doc = spark.createDataFrame([('{"k": 1, "__proto__": 2}',)], "d string")
    assert doc.select(text.json_value(F.col("d"), "k"), text.json_value(F.col("d"), "__proto__")).first()[:] == ("1", None)
    paths = spark.createDataFrame([("a/b",), ("a",), ("a/b/c",), ("b",)], "p string")
    assert [r["p"] for r in zarr.depth_sorted(paths, "p").collect()] == ["a", "b", "a/b", "a/b/c"]


def test_shapes_resolver_keeps_what_was_there():
    calls = []
    r = slots.ShapesResolver()
    load = {k: (lambda progress, k=k: calls.append(k) or k) for k in r.RESOURCES}
    entry = {"element": "cells", "table": "t", "tooltip": ["a"]}
    assert {k: v.value for k, v in r.resolve(entry, load).items()} == {"geometry": "geometry", "tooltip": "tooltip"}
    r.resolve(entry, load)
    assert calls == ["geometry", "tooltip"]

    def cancelled(progress):
        raise InterruptedError

    after = r.resolve({**entry, "tooltip": ["b"]}, {**load, "tooltip": cancelled})
    assert after["tooltip"].value == "tooltip" and calls == ["geometry", "tooltip"]
    assert r.resolve({**entry, "fill": "gene"}, load)["fill"].value == "fill"


def test_raster_resolver_by_element_and_version():
    loads = []
    r = slots.RasterResolver(lambda e: loads.append(e) or [e], lambda levels: len(levels))
    entry = {"id": "1", "element": "im", "version": 1}
    assert r.resolve(entry).value == {"levels": ["im"], "channels": 1} and r.resolve(entry).state == "ready" and loads == ["im"]
    r.resolve({**entry, "version": 2})
    r.evict(["1"])
    r.resolve(entry)
    assert len(loads) == 3
    assert slots.RasterResolver(lambda e: 1 / 0, len).resolve(entry).state == "failed"


def test_descriptions_differ_by_any_input(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (1, "a")], "n int, s string")
    assert df.select(text.description(n=F.col("n"), s=F.col("s")).alias("d")).distinct().count() == 3


@pytest.mark.parametrize("raw, left", [('{"layers":[{"id":"a","kind":"points"},{"id":"b","kind":"x"}]}', ["a"]), ("{}", None)])
def test_stored_layers_of_unknown_kinds_are_dropped(spark, raw, left):
    r = spark.createDataFrame([(raw,)], "raw string").select(render.migrated_layers(F.col("raw")).alias("l")).first()["l"]
    assert (None if r is None else [x["id"] for x in r]) == left


def test_islands_with_null_bounds_equal_sql(spark, tmp_path):
    """A null bound comes last, as in the query's SQL, and makes no island of its own beside others."""
    import duckdb

    from lattica.plans import all as plans

    rows = [(1, 10, 2), (1, None, 1), (1, 10, None), (1, 30, None), (1, 30, 5), (51, 36, 1), (2, None, 1), (None, 4, 1), (None, None, None), (3, 7, None)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.sql(plans.SQL["merge_intervals"]).fetchall()
    got = [(r["k"], r["lo"], r["hi"]) for r in plans.QUERIES["merge_intervals"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
