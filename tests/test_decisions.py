"""Driver-side choices and raster helpers."""

import pytest
from pyspark.sql import functions as F

from lattica.model import Bounds, TilingMeta
from lattica.operators import decisions as d
from lattica.operators import raster

TILED = TilingMeta(Bounds(0, 0, 1, 1), 10, 1, 10)


def test_load_choices():
    assert d.load_plan(True, False, None, False) == {"probe": True, "preload": False}
    assert d.load_plan(True, True, None, False) == {"probe": False, "preload": True}
    assert d.load_plan(False, False, None, True) == {"probe": False, "preload": False}
    assert d.encoding(False, TILED, True) == "morton-tiled" and d.encoding(True, TILED, True) == d.encoding(False, None, True) == "preloaded-columnar"
    assert d.needs_row_codes([1], None, "gene", ["gene"]) and not d.needs_row_codes(None, "c", "gene", []) and not d.needs_row_codes([1], None, "gene", ["x"])
    assert d.awaits_row_codes([1], None) and not d.awaits_row_codes([], None)
    assert d.catalog_by_column(4_000_001) and not d.catalog_by_column(4_000_000)
    assert d.fits_view(True, True, 1, 1, False, False) and not d.fits_view(True, True, 0, 1, False, False)


def test_truncation_follows_the_covering_scan():
    resident, matched = d.Truncation(True, 4, 9), d.Truncation(False, 2)
    assert d.active_truncation(resident, matched, [1, 2], [1]) == d.Truncation(False, 2, None, True)
    assert d.active_truncation(resident, matched, [2], [1]) == resident
    assert d.merged_colours({"a": 1}, {"a": 2, "b": 3}) == {"a": 1, "b": 3}


def test_channels_are_merged_and_capped():
    base = d.default_channels(3, 255.0, [{"c": i} for i in range(3)])
    m = d.merge_channels(d.Channels(shown=[False], selections=[{"c": 9.7}]), base, "img", {"c": 3, "z": 2})
    assert m.ids == ["img:ch:0", "img:ch:1", "img:ch:2"] and m.shown == [False, True, True]
    assert m.selections[0] == {"c": 2, "z": 0} and len(m.colours) == 3
    assert len(d.merge_channels(d.Channels(shown=[True] * 9), base, "x", {}).ids) == raster.MAX_CHANNELS
    declared = d.default_channels(1, 9.0, [{}], [{"color": "FF8000", "window": {"start": 1, "end": 5}}])
    assert declared.colours == [(255, 128, 0)] and declared.limits == [(1, 5)]


def test_pyramid_of_synthetic_planes(spark):
    df = raster.synthetic(spark, 8, 8, channels=2, planes=2)
    levels = raster.pyramid(df, ["c", "z"], raster.scale_factors([8, 8], 2))
    assert [x.count() for x in levels] == [256, 64, 16]
    assert levels[1].agg(F.avg("value")).first()[0] == pytest.approx(df.agg(F.avg("value")).first()[0])
    assert raster.to_tczyx(df, ["c", "z", "y", "x"]).columns == ["t", "c", "z", "y", "x", "value"]
    near = raster.stats(df, ["c"], accuracy=1000).orderBy("c").first()
    assert near["lo"] <= near["limit_lo"] < near["limit_hi"] <= near["hi"]
    assert raster.default_selections({"t": 3, "c": 9, "z": 5, "y": 1, "x": 1})[3] == {"t": 1, "z": 2, "c": 3}
    with pytest.raises(IndexError):
        raster.tile(df, 9, 0, 4, 8, 8)
    with pytest.raises(KeyError):
        raster.select(df, ["c"], {"q": 0})
