"""Queries of annotation joins, indexes and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import morton
from lattica.functions.transforms import rotation, scale, sequence, translation
from lattica.model import Bounds, PointColumns
from lattica.operators import associations, index, shapes
from lattica.plans.registry import query

EV = PointColumns("event_id", "value", "event_id", name="event_type", instance="user_id")
CIRCLES = "(SELECT c_custkey AS feature_id, c_acctbal AS x, c_nationkey::DOUBLE AS y, abs(c_acctbal) / 100 AS radius FROM customer)"
RANKED = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders)"
MATRIX = sequence([scale([2.0, 3.0]), translation([10.0, -5.0])])


def circles(t):
    return t.customer.select(F.col("c_custkey").alias("feature_id"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"), (F.abs("c_acctbal") / 100).alias("radius"))


def polygons(t):
    """Squares around the parts, of half-width p_size."""
    x, y, h = F.col("p_retailprice"), F.col("p_partkey").cast("double"), F.col("p_size").cast("double")
    at = lambda a, b: F.struct((x + a * h).alias("x"), (y + b * h).alias("y"))
    return t.part.select("p_partkey", "p_size", F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1)).alias("ring"))


def annotation(t):
    return associations.numbered(t.orders, "o_orderkey", "row_index")


def _box(sql_x, sql_y, source):
    return f"SELECT round(min({sql_x}), 6) AS min_x, round(min({sql_y}), 6) AS min_y, round(max({sql_x}), 6) AS max_x, round(max({sql_y}), 6) AS max_y FROM {source}"


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) for c in shapes.BOX])


META = "(VALUES ('cells', ['cells'], 'region', 'id'), ('path', ['shapes/cells'], 'region', 'id'), ('many', ['a', 'cells', 'b'], 'region', 'id'), ('orphan', ['none'], 'region', 'id'), ('null', NULL, NULL, NULL)) m(table_name, region, region_key, instance_key)"


def table_meta(t):
    rows = [("cells", ["cells"]), ("path", ["shapes/cells"]), ("many", ["a", "cells", "b"]), ("orphan", ["none"]), ("null", None)]
    return t.spark.createDataFrame(rows, "table_name string, region array<string>")


@query(f"SELECT table_name FROM {META} WHERE list_contains(region, 'cells') OR list_contains(region, 'shapes/cells')")
def tables_for_element(t):
    return associations.tables_for(table_meta(t), "shapes", "cells").select("table_name")


@query(f"""SELECT c.feature_id, coalesce(m.row_index, -1)::BIGINT AS row_index FROM {CIRCLES} c LEFT JOIN (SELECT o_custkey::VARCHAR AS id, max(row_index) AS row_index FROM {RANKED} WHERE o_orderstatus IN ('F', 'shapes/F') OR o_orderstatus IS NULL OR o_orderstatus = '' GROUP BY 1) m ON c.feature_id::VARCHAR = m.id""")
def associate_rows(t):
    rows = associations.rows_of(annotation(t), "o_orderstatus", associations.accepted_regions("shapes", "F"))
    return associations.associate(circles(t), "feature_id", rows, "o_custkey", "row_index").select("feature_id", F.col("row_index").cast("bigint").alias("row_index"))


@query(f"SELECT c.feature_id, coalesce(m.row_index, -1)::BIGINT AS row_index FROM {CIRCLES} c LEFT JOIN (SELECT o_custkey::VARCHAR AS id, max(row_index) AS row_index FROM {RANKED} GROUP BY 1) m ON c.feature_id::VARCHAR = m.id")
def associate_region_fallback(t):
    rows = associations.rows_of(annotation(t), "o_orderstatus", associations.accepted_regions("shapes", "no such region"))
    return associations.associate(circles(t), "feature_id", rows, "o_custkey", "row_index").select("feature_id", F.col("row_index").cast("bigint").alias("row_index"))


@query("SELECT * FROM (VALUES ('cells'), ('shapes/cells'), ('a'), ('shapes/a'), ('b'), ('shapes/b')) v(region)")
def accepted_regions(t):
    return t.spark.createDataFrame([(r,) for r in associations.accepted_regions("shapes", "cells", ["a", "b"])], "region string")


@query("SELECT c.c_custkey, o.o_orderkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS p FROM customer) c JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders) o USING (p)")
def associate_positional(t):
    return associations.by_position(t.customer.select("c_custkey"), t.orders.select("o_orderkey"), "c_custkey", "o_orderkey").select("c_custkey", "o_orderkey")


@query("SELECT true AS by_position")
def aligns_by_position(t):
    f = t.customer.select((F.col("c_custkey") - 1).alias("id")) if t.customer.agg(F.min("c_custkey")).first()[0] == 1 else t.customer.select(F.col("c_custkey").alias("id"))
    return associations.aligns_by_position(f, "id", t.customer.select((F.col("c_custkey") * 3 + 7).alias("iid")), "iid")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id WHEN event_id % 5 = 0 THEN event_id * 2 ELSE -1 END::BIGINT AS row_index FROM events")
def alignment_precedence(t):
    a = F.when(F.col("event_id") % 3 == 0, F.col("event_id")).otherwise(F.lit(-1))
    b = F.when(F.col("event_id") % 5 == 0, F.col("event_id") * 2)
    return t.events.select("event_id", associations.first_known(a, b).cast("bigint").alias("row_index"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment <> '' THEN 'segment: ' || c_mktsegment || ';' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN 'name: ' || c_name ELSE '' END AS items FROM customer")
def tooltip_items(t):
    items = associations.tooltip_items({"segment": F.col("c_mktsegment"), "name": F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("")})
    joined = F.array_join(items, ";")
    return t.customer.select("c_custkey", F.when(F.size(items) == 1, F.concat(joined, F.lit(";"))).otherwise(joined).alias("items"))


@query("SELECT e.vec_id, coalesce(o.o_orderpriority, '') AS tooltip FROM embeddings e LEFT JOIN (SELECT o_custkey::VARCHAR AS id, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1) o ON e.vec_id::VARCHAR = o.id")
def label_tooltips(t):
    return associations.label_tooltips(t.embeddings, "vec_id", t.orders, "o_custkey", "o_orderkey", "o_orderpriority").select("vec_id", "tooltip")


@query(f"SELECT c.feature_id, m.o_totalprice AS value FROM {CIRCLES} c LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, row_index) AS o_totalprice FROM {RANKED} GROUP BY 1) m ON c.feature_id = m.o_custkey")
def column_for_features(t):
    return associations.column_for(circles(t), "feature_id", t.orders, "o_custkey", "o_orderkey", "o_totalprice").select("feature_id", "value")


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def dup_ids(t):
    return associations.duplicate_ids(t.orders, "o_custkey")


# indexes



def _spread_sql(v):
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = f"(({v} | ({v} << {shift})) & {mask})"
    return v


QUANTISED = """(SELECT *, floor(least(greatest((event_id - x0) / nullif(x1 - x0, 0.0), 0.0), 1.0) * 65535)::BIGINT AS qx, floor(least(greatest((value - y0) / nullif(y1 - y0, 0.0), 0.0), 1.0) * 65535)::BIGINT AS qy
FROM events, (SELECT min(event_id)::DOUBLE AS x0, max(event_id)::DOUBLE AS x1, min(value) AS y0, max(value) AS y1 FROM events))"""
MORTON = f"(SELECT event_id, value, event_type, {_spread_sql('qx')} | ({_spread_sql('qy')} << 1) AS morton FROM {QUANTISED})"


def morton_events(t):
    return index.with_codes(t.events, EV, index.extent(t.events, EV))


@query(f"SELECT event_id, morton::BIGINT AS morton FROM {MORTON}")
def morton_codes(t):
    return morton_events(t).select("event_id", "morton")


@query(f"""WITH m AS (SELECT * FROM {MORTON}), e AS (SELECT unnest([arg_min(event_id, (event_id, event_id)), arg_max(event_id, (event_id, -event_id)), arg_min(event_id, (value, event_id)), arg_max(event_id, (value, -event_id))]) AS id, unnest([0, 1, 2, 3]) AS p FROM m),
f AS (SELECT id, min(p) AS p FROM e GROUP BY id), s AS (SELECT m.event_id, f.p, CASE WHEN f.p IS NULL THEN m.morton ELSE 0 END AS code FROM m LEFT JOIN f ON m.event_id = f.id)
SELECT event_id, code::BIGINT AS morton, (row_number() OVER (ORDER BY p NULLS LAST, code, event_id) - 1)::BIGINT AS place FROM s""")
def morton_sort_first_rows(t):
    """The place of every row in the sorted order, markers in front."""
    rows = index.sort_points(t.events, EV).select("event_id", "morton")
    marks = F.broadcast(index.extremes(t.events, EV).withColumnRenamed("row_id", "event_id").withColumnRenamed("place", "mark"))  # four rows at most
    keyed = rows.join(marks, "event_id", "left").withColumn("_key", F.struct(F.coalesce("mark", F.lit(9)).alias("p"), "morton", "event_id"))
    return associations.numbered(keyed, "_key", "place").select("event_id", "morton", F.col("place").cast("bigint").alias("place"))


@query("SELECT event_id, value FROM events WHERE event_id BETWEEN 200 AND 420 AND value BETWEEN 3 AND 50")
def morton_cover_prune_equals_filter(t):
    every, box = index.extent(t.events, EV), Bounds(200, 3, 420, 50)
    rows = morton_events(t).withColumn("group_id", F.floor(F.col("event_id") / 50).cast("bigint"))
    groups = index.row_groups(rows, F.col("group_id"), "morton")
    spans = index.covering_spans(t.spark, every, box)
    kept = rows.join(index.groups_for_spans(groups, spans).select("group_id"), "group_id", "left_semi")
    from lattica.operators import points

    return points.in_bounds(kept, EV, box).select("event_id", "value")


@query("""WITH v AS (SELECT l_orderkey % 50 AS k, l_partkey AS lo, l_partkey + l_linenumber AS hi FROM lineitem), o AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM v),
i AS (SELECT *, sum(CASE WHEN r IS NULL OR lo > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT k, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY k, g""")
def merge_intervals(t):
    rows = t.lineitem.select((F.col("l_orderkey") % 50).alias("k"), F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_linenumber")).alias("hi"))
    return morton.merge_intervals(rows, by=("k",))


@query("SELECT group_id, rows, lo, hi FROM (SELECT (event_id // 100)::BIGINT AS group_id, count(*)::BIGINT AS rows, min(user_id) AS lo, max(user_id) AS hi FROM events GROUP BY 1) WHERE lo <= 40 AND hi >= 3")
def row_group_skip(t):
    groups = index.row_groups(t.events, F.floor(F.col("event_id") / 100), "user_id")
    return index.groups_for_codes(groups, [3, 17, 40])


@query("SELECT group_id, rows, (group_id * 100)::BIGINT AS rows_before FROM (SELECT (event_id // 100)::BIGINT AS group_id, count(*)::BIGINT AS rows FROM events GROUP BY 1) WHERE group_id * 100 < 450")
def groups_until_cap(t):
    groups = index.row_groups(t.events, F.floor(F.col("event_id") / 100), "event_id")
    return index.until_cap(groups, "group_id", 450).select("group_id", "rows", F.col("rows_before").cast("bigint").alias("rows_before"))


@query("SELECT min(event_id)::DOUBLE AS min_x, min(value) AS min_y, max(event_id)::DOUBLE AS max_x, max(value) AS max_y, 4::BIGINT AS n FROM events")
def sentinel_bbox(t):
    sorted_ = index.sort_points(t.events, EV)
    head = sorted_.limit(4).withColumn("row_index", F.lit(0))
    return index.marker_bounds(head, EV, "row_index").select(F.col("min_x").cast("double"), "min_y", F.col("max_x").cast("double"), "max_y", "n")


@query("SELECT count(*)::BIGINT AS rows, count(DISTINCT event_id // 100)::BIGINT AS row_groups, 100::BIGINT AS largest FROM events")
def tiling_meta(t):
    g = index.row_groups(t.events, F.floor(F.col("event_id") / 100), "event_id")
    return g.agg(F.sum("rows").alias("rows"), F.count("*").alias("row_groups"), F.max("rows").alias("largest"))


@query("SELECT * FROM (VALUES ('marker_prefix', true), ('marker_box', true), ('tail_sorted', true)) v(id, passed)")
def morton_verify(t):
    rows = index.sort_points(t.events, EV)
    marks = F.broadcast(index.extremes(t.events, EV).select(F.col("row_id").alias("event_id"), "place"))  # four rows at most
    numbered = associations.numbered(rows.join(marks, "event_id", "left").withColumn("_key", F.struct(F.coalesce("place", F.lit(9)).alias("p"), "morton", "event_id")), "_key", "row_index")
    return index.verify(numbered, EV, "row_index")


@query("SELECT event_id, corner_x, corner_y FROM (SELECT event_id, qx::BIGINT AS corner_x, qy::BIGINT AS corner_y FROM " + QUANTISED + ")")
def query_corner(t):
    x, y = morton.corner_of(F.col("event_id").cast("double"), F.col("value"), index.extent(t.events, EV))
    return t.events.select("event_id", x.alias("corner_x"), y.alias("corner_y"))


@query("SELECT 5.0::DOUBLE AS min_x, 2.0::DOUBLE AS min_y, 8.0::DOUBLE AS max_x, 6.0::DOUBLE AS max_y")
def tile_intersect(t):
    b = Bounds.of(10, 6, 5, 0).intersect(Bounds(0, 2, 8, 9))
    return t.spark.createDataFrame([(float(b.min_x), float(b.min_y), float(b.max_x), float(b.max_y))], "min_x double, min_y double, max_x double, max_y double")


def _layout(t, name):
    rows = morton_events(t).withColumn("_key", F.struct(*index.sort_keys(t.events, EV, name)))
    return associations.numbered(rows, "_key", "place").select("event_id", F.col("place").cast("bigint").alias("place"), F.lit(name).alias("layout"))


@query(" UNION ALL ".join(f"SELECT event_id, (row_number() OVER (ORDER BY {k}event_id) - 1)::BIGINT AS place, '{n}' AS layout FROM {MORTON}" for n, k in (("canonical", ""), ("morton", "morton, "), ("morton_then_feature", "morton, event_type, "), ("feature_then_morton", "event_type, morton, "))))
def permutation_orders(t):
    out = None
    for n in index.LAYOUTS:
        out = _layout(t, n) if out is None else out.unionByName(_layout(t, n))
    return out


@query("SELECT 'all' AS layout, count(*)::BIGINT AS n FROM events WHERE event_id BETWEEN 100 AND 700 AND value BETWEEN 5 AND 60 UNION ALL SELECT 'codes', count(*)::BIGINT FROM events WHERE event_id BETWEEN 100 AND 700 AND value BETWEEN 5 AND 60 AND event_type IN ('click', 'view')")
def points_index_benchmark(t):
    from lattica.operators import points

    box = points.in_bounds(morton_events(t), EV, Bounds(100, 5, 700, 60))
    some = points.filter_names(box, "event_type", ["click", "view"])
    return box.agg(F.count("*").alias("n")).withColumn("layout", F.lit("all")).unionByName(some.agg(F.count("*").alias("n")).withColumn("layout", F.lit("codes")))


@query("SELECT round(quantile_cont(value, 0.25), 6) AS low, round(quantile_cont(value, 0.75), 6) AS high FROM events")
def quartile_scenario(t):
    q = t.events.agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    return q.select(F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


@query("SELECT count(DISTINCT l_discount)::BIGINT AS levels, count(DISTINCT l_discount) < 100 AS few FROM lineitem")
def z_cardinality(t):
    n = t.lineitem.agg(F.count_distinct("l_discount").alias("levels"))
    return n.withColumn("few", F.lit(index.few_levels(t.lineitem, "l_discount")))


# shapes


@query(_box("event_id::DOUBLE * 2 + 10", "value * 3 - 5", "events"))
def bounds_affine(t):
    return rounded(shapes.point_bounds(t.events, "event_id", "value", MATRIX))


@query(_box("x", "y", f"(SELECT x - radius AS x, y - radius AS y FROM {CIRCLES} UNION ALL SELECT x + radius, y + radius FROM {CIRCLES})"))
def bounds_circles(t):
    return rounded(shapes.circle_bounds(circles(t), "x", "y", "radius"))


@query(_box("-y", "x", "(SELECT p_retailprice - p_size AS x, (p_partkey - p_size)::DOUBLE AS y FROM part UNION ALL SELECT p_retailprice + p_size, (p_partkey + p_size)::DOUBLE FROM part)"))
def bounds_polygons(t):
    return rounded(shapes.polygon_bounds(polygons(t), "ring", rotation([[0.0, -1.0], [1.0, 0.0]])))


@query("SELECT round(min(a), 6) AS min_x, round(min(b), 6) AS min_y, round(max(a), 6) AS max_x, round(max(b), 6) AS max_y FROM (SELECT event_id::DOUBLE AS a, value AS b FROM events UNION ALL SELECT p_retailprice - p_size, p_partkey - p_size FROM part UNION ALL SELECT p_retailprice + p_size, p_partkey + p_size FROM part)")
def bounds_union(t):
    return rounded(shapes.union_bounds(shapes.point_bounds(t.events, "event_id", "value"), shapes.polygon_bounds(polygons(t), "ring")))


@query("SELECT 10.0::DOUBLE AS min_x, -5.0::DOUBLE AS min_y, 1034.0::DOUBLE AS max_x, 1531.0::DOUBLE AS max_y")
def bounds_image(t):
    return rounded(shapes.image_bounds(t.spark, 1024, 1024, MATRIX, (0.5, 0.5)))


@query("""SELECT round((x0 + x1) / 2, 6) AS center_x, round((y0 + y1) / 2, 6) AS center_y, round(log2(least(800 / greatest(x1 - x0, 1e-9), 600 / greatest(y1 - y0, 1e-9))) - 0.2, 6) AS zoom FROM (SELECT min(event_id)::DOUBLE AS x0, max(event_id)::DOUBLE AS x1, min(value) AS y0, max(value) AS y1 FROM events)""")
def view_fit(t):
    v = shapes.view_fit(shapes.point_bounds(t.events, "event_id", "value"), 800.0, 600.0)
    return v.select(*[F.round(c, 6).alias(c) for c in v.columns])


@query("SELECT p_partkey, round(4::DOUBLE * p_size * p_size, 4) AS area, round(2::DOUBLE * p_size, 4) AS size FROM part")
def polygon_area(t):
    return polygons(t).select("p_partkey", F.round(shapes.area(F.col("ring")), 4).alias("area"), F.round(shapes.characteristic_size(F.col("ring")), 4).alias("size"))


@query("SELECT p_partkey, i::INT AS i, ((i + 1) % 4)::INT AS j FROM part, range(4) r(i)")
def ring_edges(t):
    return shapes.edges(polygons(t), "p_partkey", "ring")


@query("SELECT p_partkey, coalesce(sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM part")
def start_indices(t):
    return shapes.start_indices(t.part, "p_partkey", F.col("p_size")).select("p_partkey", F.col("start").cast("bigint").alias("start"))


@query(f"SELECT feature_id, radius FROM {CIRCLES} WHERE feature_id % 10 <> 0")
def visible_circles(t):
    hidden = circles(t).where("feature_id % 10 = 0").select("feature_id")
    return shapes.visible(circles(t), "feature_id", hidden, "radius").select("feature_id", "radius")


@query("SELECT p_partkey, 4::BIGINT AS vertices, round(p_retailprice - p_size, 6) AS x, round(p_partkey::DOUBLE - p_size, 6) AS y FROM part")
def wkb_roundtrip(t):
    from lattica.sources import wkb

    back = polygons(t).withColumn("geometry", wkb.polygon_wkb("ring")).withColumn("ring", wkb.exterior_ring("geometry"))
    return back.select("p_partkey", F.size("ring").cast("bigint").alias("vertices"), F.round(F.col("ring")[0]["x"], 6).alias("x"), F.round(F.col("ring")[0]["y"], 6).alias("y"))


@query("SELECT min(value) AS lo, max(value) AS hi FROM events")
def finite_extent(t):
    from lattica.functions import colours

    return colours.extent(t.events, F.col("value"))


@query("SELECT min(event_id)::DOUBLE AS min_x, min(value) AS min_y, max(event_id)::DOUBLE AS max_x, max(value) AS max_y FROM events")
def columnar_bounds(t):
    return shapes.point_bounds(t.events, "event_id", "value")


@query("SELECT event_id, value, event_type FROM events WHERE event_id BETWEEN 200 AND 420 AND value BETWEEN 3 AND 50 AND event_type IN ('click', 'view')")
def view_by_row_groups(t):
    """A view of a table written in Morton order: the codes' spans choose the row groups that are read."""
    from lattica.operators import points
    from lattica.plans.streams import folder
    from lattica.sources import write

    place = folder(t)
    write.write_points(t.events, EV, place, row_group_bytes=1 << 16)
    sorted_ = PointColumns("event_id", "value", "event_id", name="event_type", morton="morton")
    rows = points.in_view(t.spark.read.parquet(place), sorted_, index.extent(t.events, EV), Bounds(200, 3, 420, 50))
    return points.filter_names(rows, "event_type", ["click", "view"]).select("event_id", "value", "event_type")


@query(" UNION ALL ".join(f"SELECT '{n}' AS layout, count(*)::BIGINT AS n, (count(*) FILTER (event_type IN ('click', 'view')))::BIGINT AS coded FROM events WHERE event_id BETWEEN 100 AND 700 AND value BETWEEN 5 AND 60" for n in index.LAYOUTS))
def points_index_layouts(t):
    """The benchmark's count in a box over the four physical layouts, each read back from its files."""
    from lattica.operators import points
    from lattica.plans.streams import folder
    from lattica.sources import write

    place, every, out = folder(t), index.extent(t.events, EV), None
    write.write_layouts(t.events, EV, place)
    for name in index.LAYOUTS:
        c = PointColumns("event_id", "value", "event_id", name="event_type", morton="morton" if name.startswith("morton") else None)
        rows = points.in_view(t.spark.read.parquet(f"{place}/{name}"), c, every, Bounds(100, 5, 700, 60))
        one = rows.agg(F.count("*").alias("n"), F.count_if(F.col("event_type").isin("click", "view")).alias("coded")).withColumn("layout", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c.feature_id, coalesce(m.row_index, -1)::BIGINT AS row_index FROM " + CIRCLES + " c LEFT JOIN (SELECT o_custkey::VARCHAR AS id, max(row_index) AS row_index FROM " + RANKED + " GROUP BY 1) m ON c.feature_id::VARCHAR = m.id")
def shape_tooltip_rows(t):
    return associations.shape_tooltips(circles(t), "feature_id", annotation(t), "o_custkey", "row_index", False).select("feature_id", F.col("row_index").cast("bigint").alias("row_index"))
