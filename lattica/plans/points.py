"""Queries of point scans, catalogues, counts and selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.functions import numbers, text
from lattica.model import Bounds, PointColumns
from lattica.operators import associations, catalog, points, render
from lattica.plans.registry import query

EV = PointColumns("event_id", "value", "event_id", name="event_type", instance="user_id")
LI = PointColumns("l_extendedprice", "l_quantity", "l_orderkey", z="l_discount", name="l_returnflag")
BOX = Bounds(100, 5, 700, 60)
LI_BOX = Bounds(20000, 10, 60000, 40)


def coded(t):
    """Events with a code column: the position of the type in sorted order."""
    return catalog.row_codes(t.events, catalog.sorted_codes(t.events, "event_type"), "event_type")


CODED = "(SELECT *, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS code FROM events)"
SORTED = "(SELECT event_type AS name, (row_number() OVER (ORDER BY event_type) - 1)::INT AS code, count(*)::BIGINT AS n FROM events GROUP BY event_type)"


@query("""SELECT event_id, value, event_type FROM events WHERE event_id BETWEEN 100 AND 700 AND value BETWEEN 5 AND 60 AND event_type IN ('click', 'purchase', 'view') AND isfinite(value)""")
def points_in_bounds_by_feature(t):
    return points.filter_names(points.in_bounds(t.events, EV, BOX), "event_type", ["click", "purchase", "view"]).select("event_id", "value", "event_type")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_returnflag FROM lineitem WHERE l_extendedprice BETWEEN 20000 AND 60000 AND l_quantity BETWEEN 10 AND 40 AND l_returnflag IN ('A', 'R')""")
def lineitem_in_bounds(t):
    rows = points.filter_names(points.in_bounds(t.lineitem, LI, LI_BOX), "l_returnflag", ["A", "R"])
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag")


@query("SELECT event_id, value, event_type FROM events")
def feature_filter_all(t):
    return points.filter_codes(t.events, None, None).select("event_id", "value", "event_type")


@query("SELECT event_id, value, event_type FROM events WHERE false")
def feature_filter_none(t):
    return points.filter_codes(coded(t), "code", []).select("event_id", "value", "event_type")


@query("SELECT event_id FROM events WHERE false")
def feature_filter_without_codes(t):
    return points.filter_codes(t.events, None, [1]).select("event_id")


@query(f"SELECT event_id, code::BIGINT AS code FROM {CODED} WHERE code IN (0, 2)")
def feature_filter_codes(t):
    return points.filter_codes(coded(t), "code", [0, 2]).select("event_id", F.col("code").cast("bigint").alias("code"))


@query(f"""SELECT event_id, value, code::BIGINT AS code, (SELECT count(*) FROM {CODED} WHERE code IN (1, 3)) >= 200 AS truncated FROM {CODED} WHERE code IN (1, 3) ORDER BY event_id LIMIT 200""")
def matching_scan_capped(t):
    rows = points.matching(coded(t), EV, points.code_predicate(F.col("code"), [1, 3]), 200)
    return rows.select("event_id", "value", F.col("code").cast("bigint").alias("code"), "truncated")


@query("SELECT event_id FROM events WHERE false")
def matching_scan_empty(t):
    return points.matching(coded(t), EV, points.code_predicate(F.col("code"), []), 200).select("event_id")


@query("SELECT event_id, value, event_type, (SELECT count(*) FROM events)::BIGINT AS total_rows, (SELECT count(*) FROM events) > 300 AS truncated FROM events ORDER BY event_id LIMIT 300")
def preload_capped(t):
    return points.preload(t.events, "event_id", 300.9).select("event_id", "value", "event_type", "total_rows", "truncated")


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 50")
def render_cap(t):
    return points.first_rows(t.events, "event_id", 50)[0].select("event_id")


@query("SELECT event_id, true AS truncated FROM (SELECT * FROM events ORDER BY event_id LIMIT 300) ORDER BY event_id LIMIT 100")
def cap_shed(t):
    held = points.preload(t.events, "event_id", 300)
    return points.first_rows(held, "event_id", 100)[0].select("event_id", F.lit(True).alias("truncated"))


@query(f"SELECT code::BIGINT AS code, name, n AS count FROM {SORTED}")
def catalog_with_codes(t):
    return catalog.by_code(coded(t), "code", "event_type", "event_id").select(F.col("code").cast("bigint").alias("code"), "name", "count")


@query("SELECT (row_number() OVER (ORDER BY min(event_id)) - 1)::BIGINT AS code, event_type AS name, count(*)::BIGINT AS count FROM events GROUP BY event_type")
def catalog_first_seen(t):
    return catalog.first_seen(t.events, "event_type", "event_id").select(F.col("code").cast("bigint").alias("code"), "name", "count")


@query("""SELECT (row_number() OVER (ORDER BY min(event_id)) - 1)::BIGINT AS code, coalesce(CASE WHEN event_id % 7 <> 0 THEN event_type END, '') AS name, count(*)::BIGINT AS count FROM events GROUP BY coalesce(CASE WHEN event_id % 7 <> 0 THEN event_type END, '')""")
def catalog_first_seen_nulls(t):
    rows = t.events.withColumn("event_type", F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
    return catalog.first_seen(rows, "event_type", "event_id").select(F.col("code").cast("bigint").alias("code"), "name", "count")


@query("SELECT (row_number() OVER (ORDER BY min(event_id)) - 1)::BIGINT AS code, event_type AS name FROM (SELECT * FROM events WHERE event_id % 3 = 0 UNION ALL SELECT * FROM events WHERE event_id % 3 <> 0) GROUP BY event_type")
def catalog_chunked(t):
    parts = t.events.where("event_id % 3 = 0").unionByName(t.events.where("event_id % 3 <> 0"))
    return catalog.first_seen(parts, "event_type", "event_id").select(F.col("code").cast("bigint").alias("code"), "name")


@query("SELECT DISTINCT event_type AS name FROM events")
def distinct_names(t):
    return catalog.names_of(t.events, name="event_type")


@query(f"SELECT code::BIGINT AS code, count(*)::BIGINT AS count FROM (SELECT CASE WHEN event_id % 11 = 0 THEN -1 ELSE code END AS code FROM {CODED}) GROUP BY code")
def feature_counts_histogram(t):
    rows = coded(t).withColumn("code", F.when(F.col("event_id") % 11 == 0, F.lit(-1)).otherwise(F.col("code")))
    return catalog.histogram(rows, "code").select(F.col("code").cast("bigint").alias("code"), "count")


@query(f"SELECT c.code::BIGINT AS code, count(*)::BIGINT AS count FROM events e JOIN (SELECT * FROM {SORTED} WHERE code < 3) c ON e.event_type = c.name GROUP BY c.code")
def name_tally(t):
    known = catalog.sorted_codes(t.events, "event_type").where("code < 3")
    return catalog.tally(t.events, known, "event_type").select(F.col("code").cast("bigint").alias("code"), "count")


@query(f"SELECT e.event_id, coalesce(c.code, -1)::BIGINT AS code FROM events e LEFT JOIN (SELECT * FROM {SORTED} WHERE code < 3) c ON e.event_type = c.name")
def row_feature_codes(t):
    known = catalog.sorted_codes(t.events, "event_type").where("code < 3")
    return catalog.row_codes(t.events, known, "event_type").select("event_id", F.col("code").cast("bigint").alias("code"))


@query("SELECT event_id, (dense_rank() OVER (ORDER BY first) - 1)::BIGINT AS code FROM (SELECT event_id, min(event_id) OVER (PARTITION BY event_type) AS first FROM events)")
def first_seen_codes_rows(t):
    return catalog.row_codes(t.events, catalog.first_seen(t.events, "event_type", "event_id"), "event_type").select("event_id", F.col("code").cast("bigint").alias("code"))


@query(f"""SELECT e.event_id, e.code::BIGINT AS code, coalesce(n.new_code, -1)::BIGINT AS new_code FROM {CODED} e LEFT JOIN (SELECT name, (row_number() OVER (ORDER BY name DESC) - 1) AS new_code FROM {SORTED} WHERE code <> 1) n ON e.event_type = n.name""")
def remap_codes(t):
    old = catalog.sorted_codes(t.events, "event_type")
    rank = F.row_number().over(Window.orderBy(F.desc("name"))) - 1
    new = old.where("code <> 1").select("name").withColumn("code", rank)
    return catalog.remap(coded(t), "code", old, new).select("event_id", F.col("code").cast("bigint").alias("code"), F.col("new_code").cast("bigint").alias("new_code"))


@query(f"SELECT s.code::BIGINT AS code, s.name, coalesce(h.c, s.n)::BIGINT AS count FROM {SORTED} s LEFT JOIN (SELECT code, count(*) AS c FROM {CODED} WHERE code < 2 AND event_id < 500 GROUP BY code) h ON s.code = h.code")
def merge_counts(t):
    some = catalog.histogram(coded(t).where("code < 2 and event_id < 500"), "code")
    return catalog.merge_counts(catalog.sorted_codes(t.events, "event_type"), some).select(F.col("code").cast("bigint").alias("code"), "name", "count")


@query(f"SELECT code::BIGINT AS code, name, n AS count FROM {SORTED}")
def catalog_with_counts(t):
    known = catalog.sorted_codes(t.events, "event_type")
    counted = catalog.merge_counts(known.withColumn("count", F.lit(None).cast("bigint")), catalog.histogram(coded(t), "code"))
    return counted.select(F.col("code").cast("bigint").alias("code"), "name", "count")


@query("SELECT code::BIGINT AS code, count(*)::BIGINT AS count FROM (SELECT * FROM " + CODED + " ORDER BY event_id LIMIT 400) GROUP BY code")
def resident_counts(t):
    return catalog.histogram(points.first_rows(coded(t), "event_id", 400)[0], "code").select(F.col("code").cast("bigint").alias("code"), "count")


@query(f"SELECT code::BIGINT AS code FROM {SORTED} WHERE name IN ('click', 'view', 'no such name')")
def selection_names_to_codes(t):
    wanted = t.spark.createDataFrame([("click",), ("view",), ("no such name",)], "name string")
    return catalog.names_to_codes(catalog.sorted_codes(t.events, "event_type"), wanted, None).select(F.col("code").cast("bigint").alias("code"))


@query(f"SELECT name FROM {SORTED} WHERE code IN (0, 2)")
def selection_codes_to_names(t):
    wanted = catalog.names_to_codes(None, None, [0, 2, 99], t.spark)
    return catalog.codes_to_names(catalog.sorted_codes(t.events, "event_type"), wanted)


@query(f"SELECT code::BIGINT AS code, '#ff0000' AS colour FROM {SORTED} WHERE name = 'click'")
def colour_overrides_by_name(t):
    given = t.spark.createDataFrame([("click", "#ff0000"), ("no such name", "#00ff00")], "name string, colour string")
    return catalog.overrides_by_name(catalog.sorted_codes(t.events, "event_type"), given).select(F.col("code").cast("bigint").alias("code"), "colour")


@query(f"SELECT string_agg(code::VARCHAR, ',' ORDER BY code) AS codes, string_agg(name, ',' ORDER BY name) AS names FROM {SORTED}")
def sorted_lists(t):
    c = catalog.sorted_names(catalog.sorted_codes(t.events, "event_type"))
    return c.select(catalog.signature("codes").alias("codes"), F.array_join("names", ",").alias("names"))


@query(f"SELECT (max(code) + 1)::BIGINT AS size FROM {SORTED}")
def code_space(t):
    return catalog.code_space(catalog.sorted_codes(t.events, "event_type"))


@query("SELECT * FROM (VALUES ('0,1', true), ('1,9', false), ('', true)) v(codes, covered)")
def coverage_reuse(t):
    rows = t.spark.createDataFrame([([1, 0], [0, 1, 2]), ([9, 1], [0, 1, 2]), ([], [0])], "want array<int>, held array<int>")
    return rows.select(catalog.signature("want").alias("codes"), catalog.covers("want", "held").alias("covered"))


@query("SELECT event_id AS row_id, event_id::FLOAT AS x, value::FLOAT AS y FROM events")
def geometry_projection(t):
    return points.geometry(t.events, EV)


@query("SELECT event_id AS row_id, event_id::DOUBLE AS x, value AS y, 0.0::DOUBLE AS z FROM events")
def positions_array(t):
    p = points.positions(t.events, EV)
    return p.select("row_id", F.col("position")[0].alias("x"), F.col("position")[1].alias("y"), F.col("position")[2].alias("z"))


@query("SELECT event_id, isnan(CASE WHEN event_id % 5 = 0 THEN 'NaN'::DOUBLE ELSE value END) AS absent FROM events")
def numeric_column_nan(t):
    c = F.when(F.col("event_id") % 5 == 0, F.lit("none")).otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", F.isnan(numbers.or_nan(c)).alias("absent"))


@query("SELECT event_id, value FROM events WHERE NOT (event_id < 4 AND (event_id * 3) % 2 = 0)")
def sentinel_skip_scan(t):
    return t.events.where(points.not_sentinel(F.col("event_id"), (F.col("event_id") * 3) % 2)).select("event_id", "value")


@query("SELECT floor(event_id / 128.0)::BIGINT AS tile_x, floor((value - 2.5) / 128.0)::BIGINT AS tile_y, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def tile_counts(t):
    return points.tile_counts(t.events, EV, (0.0, 2.5), 128.0)


@query("SELECT count(*)::BIGINT AS n FROM lineitem")
def row_count(t):
    return t.lineitem.agg(F.count("*").alias("n"))


@query("SELECT event_id, value FROM (SELECT event_id, value, ('0x' || substr(md5('0:' || event_id), 1, 15))::BIGINT AS h FROM events) ORDER BY h LIMIT 100")
def sample_seeded(t):
    return points.seeded_sample(t.events, "event_id", 100, 0).select("event_id", "value")


@query("SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def first_picks(t):
    return render.one_pick_per_layer(t.events, "event_type", "event_id").select("event_id", "event_type", "value")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click')")
def hidden_features(t):
    return points.hide(t.events, "event_type", t.spark.createDataFrame([("click",)], "event_type string")).select("event_id", "event_type")


@query("SELECT event_type, count(*)::BIGINT AS n FROM (SELECT event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_type FROM events WHERE event_id % 2 = 1) GROUP BY event_type")
def multipart_union(t):
    both = points.concat_chunks([t.events.where("event_id % 2 = 0"), t.events.where("event_id % 2 = 1")])
    return both.groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events""")
def json_attr(t):
    return t.events.select("event_id", text.json_value(F.col("props"), "k").cast("bigint").alias("k"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value FROM events")
def nullable_decode(t):
    masked = t.events.select("event_id", F.struct("value", (F.col("event_id") % 4 == 0).alias("mask")).alias("v"))
    return masked.select("event_id", associations.masked(F.col("v.value"), F.col("v.mask")).alias("value"))


@query("SELECT e.event_id, n.n_name AS category FROM (SELECT event_id, (user_id % 26) - 1 AS code FROM events) e LEFT JOIN nation n ON e.code = n.n_nationkey")
def categorical_decode(t):
    rows = t.events.select("event_id", ((F.col("user_id") % 26) - 1).alias("code"))
    cats = t.nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("category"))
    return associations.decode(rows, "code", cats).select("event_id", "category")


@query("SELECT event_type, floor(100.0 * n / total + 0.5)::BIGINT || '%' AS share FROM (SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS total FROM events GROUP BY event_type)")
def coverage_percent(t):
    n = t.events.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(t.events.agg(F.count("*").alias("total"))))
    return n.select("event_type", text.percent(F.col("n"), F.col("total")).alias("share"))


@query("SELECT event_id AS row_id, event_id::FLOAT AS x, value::FLOAT AS y, 0.0::FLOAT AS z, code::INT AS code FROM " + CODED)
def columnar_batch(t):
    return points.to_batch(coded(t), PointColumns("event_id", "value", "event_id", code="code"))


@query(f"SELECT event_id AS row_id, event_id::DOUBLE AS x, (value::FLOAT)::DOUBLE AS y, code::INT AS code FROM {CODED}")
def point_data(t):
    """Batches and back: positions and codes on one row."""
    back = points.from_batch(points.to_batch(coded(t), PointColumns("event_id", "value", "event_id", code="code")))
    return back.select("row_id", F.col("position")[0].alias("x"), F.col("position")[1].alias("y"), "code")


@query(f"SELECT (event_id % 2)::BIGINT AS chunk, count(*)::BIGINT AS n, count(code)::BIGINT AS coded FROM {CODED} GROUP BY 1")
def chunk_concat(t):
    rows = coded(t)
    both = points.concat_chunks([rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")], "code")
    return both.groupBy((F.col("event_id") % 2).alias("chunk")).agg(F.count("*").alias("n"), F.count("code").alias("coded"))


@query(f"SELECT name || '=' || code AS entry FROM {SORTED}")
def code_map_entries(t):
    m = catalog.code_map(catalog.sorted_codes(t.events, "event_type"))
    return m.select(F.explode("codes").alias("name", "code")).select(F.concat_ws("=", "name", F.col("code").cast("string")).alias("entry"))


@query(f"SELECT e.event_id, CASE WHEN s.code < 3 THEN s.code ELSE -1 END::BIGINT AS code FROM events e JOIN {SORTED} s ON e.event_type = s.name")
def catalog_upgrade(t):
    """Rows coded by a preview of first-seen names get the codes of the full catalogue, here one that lacks names."""
    preview = catalog.first_seen(t.events, "event_type", "event_id")
    rows = catalog.row_codes(t.events, preview, "event_type")
    full = catalog.sorted_codes(t.events, "event_type").where("code < 3")
    return catalog.upgraded(rows, "code", preview, full).select("event_id", F.col("code").cast("bigint").alias("code"))


@query("SELECT event_id, regexp_matches(trim(event_type || CASE WHEN event_id % 4 = 0 THEN '/x' ELSE '' END), '^[^/]+$') AS valid FROM events")
def key_validation(t):
    key = F.concat("event_type", F.when(F.col("event_id") % 4 == 0, "/x").otherwise(""))
    return t.events.select("event_id", text.points_key(key).alias("valid"))


@query(f"SELECT event_id AS row_id, event_id::FLOAT AS x, value::FLOAT AS y, code::INT AS code FROM {CODED}")
def geometry_with_codes(t):
    return points.decoded(coded(t), PointColumns("event_id", "value", "event_id", name="event_type", code="code"))[0]


@query("SELECT event_id AS row_id, (dense_rank() OVER (ORDER BY first) - 1)::INT AS code FROM (SELECT event_id, min(event_id) OVER (PARTITION BY event_type) AS first FROM events)")
def geometry_with_first_seen_codes(t):
    return points.decoded(t.events, EV)[0].select("row_id", "code")


@query("SELECT floor(event_id / 64.0)::BIGINT AS tile_x, floor(value / 64.0)::BIGINT AS tile_y, event_id FROM events WHERE event_id / 64.0 >= 1 AND event_id / 64.0 < 11 AND value / 64.0 >= 0 AND value / 64.0 < 1")
def tiled_view(t):
    return points.tiled(t.events, EV, Bounds(100, 5, 700, 60), 64.0).select("tile_x", "tile_y", "event_id")
