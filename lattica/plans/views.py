"""Queries of colours, view states, texts and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import colours, text
from lattica.operators import associations, catalog, raster, render
from lattica.plans.registry import query

SORTED = "(SELECT event_type AS name, (row_number() OVER (ORDER BY event_type) - 1)::INT AS code, count(*)::BIGINT AS n FROM events GROUP BY event_type)"
PIXELS = "(SELECT vec_id AS y, label, i - 1 AS x, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) r(i))"


def channels(df, *names):
    return [F.get("colour", k).cast("bigint").alias(n) for k, n in enumerate(names or ("r", "g", "b", "a"))]


def pixels(t):
    return raster.pixels(t.embeddings.select("vec_id", "label", "embedding"), "vec_id", "embedding").withColumn("value", F.col("value").cast("double"))


# colours


@query("""WITH c AS (SELECT brand, row_number() OVER (ORDER BY brand) - 1 AS i FROM (SELECT DISTINCT p_brand AS brand FROM part))
SELECT p_partkey, ([10, 20, 30])[(i % 3 + 1)::INT]::BIGINT AS r, ([40, 50, 60])[(i % 3 + 1)::INT]::BIGINT AS g, ([70, 80, 90])[(i % 3 + 1)::INT]::BIGINT AS b, 255::BIGINT AS a FROM part JOIN c ON p_brand = brand""")
def colour_categorical(t):
    out = colours.assign(t.part.select("p_partkey", "p_brand"), "p_brand", kind="categorical", colours=[[10, 40, 70], [20, 50, 80], [30, 60, 90]])
    return out.select("p_partkey", *channels(out))


@query("""WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), p AS (SELECT c_custkey, (c_acctbal - lo) / (hi - lo) AS t FROM customer, e)
SELECT c_custkey, floor(255.0::DOUBLE * t + 0.5)::BIGINT AS r, floor(64 + (220.0::DOUBLE - 64) * t + 0.5)::BIGINT AS g, floor(255 + (0.0::DOUBLE - 255) * t + 0.5)::BIGINT AS b, 255::BIGINT AS a FROM p""")
def colour_continuous(t):
    out = colours.assign(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", kind="numeric")
    return out.select("c_custkey", *channels(out))


@query("""WITH e AS (SELECT min(sign(c_acctbal) * ln(1 + abs(c_acctbal))) AS lo, max(sign(c_acctbal) * ln(1 + abs(c_acctbal))) AS hi FROM customer)
SELECT c_custkey, (sign(c_acctbal) * ln(1 + abs(c_acctbal)) - lo) / (hi - lo) >= 0.5 AS upper_half FROM customer, e WHERE abs((sign(c_acctbal) * ln(1 + abs(c_acctbal)) - lo) / (hi - lo) - 0.5) > 1e-6""")
def colour_symlog(t):
    ends = colours.extent(t.customer, F.col("c_acctbal"))
    rows = t.customer.crossJoin(F.broadcast(ends)).withColumn("p", colours.position(F.col("c_acctbal"), F.col("lo"), F.col("hi"), True))
    return rows.where("abs(p - 0.5) > 1e-6").select("c_custkey", (F.col("p") >= 0.5).alias("upper_half"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 OR c_custkey % 6 = 1 OR c_custkey % 6 = 2 THEN 128 ELSE 1 END::BIGINT AS r FROM customer""")
def colour_missing(t):
    value = F.when(F.col("c_custkey") % 6 == 0, " ").when(F.col("c_custkey") % 6 == 1, "N/A").when(F.col("c_custkey") % 6 == 2, "Unassigned ").otherwise("x")
    out = colours.assign(t.customer.select("c_custkey", value.alias("v")), "v", kind="string", colours=[[1, 2, 3]])
    return out.select("c_custkey", F.get("colour", 0).cast("bigint").alias("r"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'continuous' ELSE 'categorical' END AS mode FROM customer""")
def colour_mode(t):
    modes = {1: colours.mode("string"), 2: colours.mode("numeric"), 3: colours.mode(None, None, False), 4: colours.mode(None, None, True)}
    table = F.create_map(*[x for k, v in modes.items() for x in (F.lit(k), F.lit(v))])
    return t.customer.select("c_custkey", table[(F.pmod(F.col("c_custkey") - 1, F.lit(4)) + 1).cast("int")].alias("mode"))


@query("""SELECT value, (row_number() OVER (ORDER BY try_cast(value AS DOUBLE) IS NULL, try_cast(value AS DOUBLE), value) - 1)::BIGINT AS index FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE p_brand END AS value FROM part)""")
def category_order(t):
    v = t.part.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand")).alias("value"))
    return colours.categories(v, "value").select("value", F.col("index").cast("bigint").alias("index"))


@query(f"SELECT name, code::BIGINT AS code FROM {SORTED}")
def catalog_order(t):
    return catalog.ordered(catalog.sorted_codes(t.events, "event_type")).select("name", F.col("code").cast("bigint").alias("code"))


@query("""WITH h AS (SELECT c - 1 AS code, 2 * pi() * (((c - 1) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE) AS hue FROM range(0, 41) r(c)), ab AS (SELECT code, 0.32 * cos(hue) AS a, 0.32 * sin(hue) AS b FROM h),
l AS (SELECT code, pow(0.72 + 0.3963377774 * a + 0.2158037573 * b, 3) AS l, pow(0.72 - 0.1055613458 * a - 0.0638541728 * b, 3) AS m, pow(0.72 - 0.0894841775 * a - 1.2914855480 * b, 3) AS s FROM ab),
v AS (SELECT code, 4.0767416621 * l - 3.3077115913 * m + 0.2309699292 * s AS r FROM l)
SELECT code::BIGINT AS code, CASE WHEN code < 0 THEN 128 ELSE floor(least(greatest(CASE WHEN r <= 0.0031308 THEN r * 12.92 ELSE 1.055 * pow(greatest(r, 0), 1 / 2.4) - 0.055 END, 0), 1) * 255 + 0.5) END::BIGINT AS r FROM v""")
def palette_lut(t):
    ids = t.spark.range(-1, 40).select(F.col("id").alias("code"))
    return ids.select("code", F.get(colours.oklab(F.col("code")), 0).cast("bigint").alias("r"))


@query("""SELECT i::BIGINT AS id, CASE WHEN i = 3 THEN 0 WHEN i = 5 THEN floor(200 * 0.25 + 0.5) WHEN i = 8 THEN 200 ELSE 255 END::BIGINT AS a FROM range(0, 9) r(i)""")
def label_lut(t):
    rows = [("3", [1, 2, 3, 200], True, True), ("5", [1, 2, 3, 200], False, True), ("8", [9, 9, 9, 200], False, False), ("x", [0, 0, 0, 0], True, False), ("2.5", [0, 0, 0, 0], True, False)]
    state = t.spark.createDataFrame(rows, "label string, colour array<int>, hidden boolean, faded boolean").withColumn("id", colours.label_id(F.col("label"))).drop("label")
    return colours.label_table(t.spark, state).select("id", F.get("colour", 3).cast("bigint").alias("a"))


@query("SELECT * FROM (VALUES (0::BIGINT, true), (1::BIGINT, false), (7::BIGINT, true)) v(id, visible)")
def label_visibility(t):
    rows = t.spark.createDataFrame([(0, [255, 0]), (1, [255, 0]), (7, [255, 0])], "id bigint, alphas array<int>")
    return rows.select("id", colours.label_visible(F.col("alphas"), F.col("id").cast("int")).alias("visible"))


@query("SELECT event_id, CASE WHEN user_id::VARCHAR SIMILAR TO '[0-9]+' THEN user_id END AS id FROM events")
def regex_ids(t):
    return t.events.select("event_id", colours.label_id(F.col("user_id").cast("string")).alias("id"))


@query("SELECT c_custkey, floor(c_custkey % 256 + (255 - c_custkey % 256) * 0.45::DOUBLE + 0.5)::BIGINT AS r, least(c_custkey % 256 + 55, 255)::BIGINT AS a FROM customer")
def stroke_colour(t):
    c = (F.col("c_custkey") % 256).cast("int")
    out = t.customer.select("c_custkey", colours.stroke(F.array(c, c, c, c)).alias("colour"))
    return out.select("c_custkey", F.get("colour", 0).cast("bigint").alias("r"), F.get("colour", 3).cast("bigint").alias("a"))


@query("SELECT c_custkey, floor((c_custkey % 256) * 0.3::DOUBLE + 0.5)::BIGINT AS a FROM customer")
def fade_alpha(t):
    return t.customer.select("c_custkey", colours.fade((F.col("c_custkey") % 256), 0.3).cast("bigint").alias("a"))


@query("SELECT * FROM (VALUES ('#ff8000', 255::BIGINT, 128::BIGINT, 0::BIGINT), ('0a0B0c', 10::BIGINT, 11::BIGINT, 12::BIGINT), ('#12', NULL, NULL, NULL)) v(text, r, g, b)")
def hex_colours(t):
    rows = t.spark.createDataFrame([("#ff8000",), ("0a0B0c",), ("#12",)], "text string").withColumn("colour", colours.hex_colour(F.col("text")))
    return rows.select("text", *channels(rows, "r", "g", "b"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 255 END::BIGINT AS v FROM events")
def colour_at(t):
    at = (F.col("event_id") % 10).cast("int")
    return t.events.select("event_id", colours.colour_at(F.array(F.lit(255), F.lit(7)), at, 1).cast("bigint").alias("v"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 5 = 0 THEN floor((CASE WHEN p_partkey % 2 = 0 THEN 200 ELSE 180 END) * 0.25 + 0.5) WHEN p_partkey % 2 = 0 THEN 200 ELSE 180 END::BIGINT AS a FROM part""")
def feature_state_overlay(t):
    k = t.part.select("p_partkey")
    own = k.where("p_partkey % 2 = 0").withColumn("colour", F.array(*map(F.lit, (1, 2, 3, 200))))
    out = render.overlay(k, "p_partkey", own, k.where("p_partkey % 7 = 0"), k.where("p_partkey % 5 = 0"), F.array(*map(F.lit, (9, 9, 9, 180))), 0.25)
    return out.select("p_partkey", F.get("colour", 3).cast("bigint").alias("a"))


@query("SELECT CASE WHEN v > 0 AND isfinite(v) THEN floor(v + 0.5) END::BIGINT AS id, k FROM (VALUES (1, 4.4::DOUBLE), (2, -1.0), (3, 'inf'::DOUBLE), (4, 0.0)) t(k, v)")
def highlight_ids(t):
    rows = t.spark.createDataFrame([(1, 4.4), (2, -1.0), (3, float("inf")), (4, 0.0)], "k int, v double")
    return rows.select("k", colours.highlight_id(F.col("v")).alias("id"))


# states and orders

STATES = [
    (1, False, False, False, False, False, False, 0, 9), (2, True, True, False, False, False, True, 3, 9), (3, True, True, True, False, False, True, 9, 9), (4, True, False, True, True, False, True, 0, 9),
    (5, True, False, True, False, False, True, 0, 9), (6, True, False, False, True, True, True, 0, 9), (7, True, False, False, False, False, False, 0, 9), (8, True, False, False, False, False, True, 0, 9),
]


@query("SELECT * FROM (VALUES (1, 'shown', 1.0::DOUBLE), (2, 'partial', 1.0), (3, 'resident', 1.0), (4, 'loaded', 1.0), (5, 'cached', 1.0), (6, 'loading', 0.7), (7, 'noIndex', 0.35), (8, 'notLoaded', 0.45)) v(id, state, opacity)")
def feature_row_state(t):
    names = ("resident_known", "resident", "rendered", "selected", "scanning", "on_demand", "resident_count", "dataset_count")
    rows = t.spark.createDataFrame(STATES, "id int, " + ", ".join(f"{n} {'int' if n.endswith('count') else 'boolean'}" for n in names))
    rows = rows.withColumn("state", render.feature_row_state({n: F.col(n) for n in names}))
    return rows.select("id", "state", render.opacity(F.col("state")).alias("opacity"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def tile_state_reducer(t):
    return render.last_event(t.events, "user_id", "event_type", "event_id")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'aborted' WHEN event_id % 7 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'loading' WHEN event_id % 2 = 0 THEN 'loaded' ELSE 'empty' END AS status FROM events")
def tile_status(t):
    e = F.col("event_id")
    return t.events.select("event_id", render.tile_status(e % 3 != 0, F.when(e % 2 == 0, 5).otherwise(0), e % 7 == 0, e % 5 == 0).alias("status"))


@query("SELECT n_name, (row_number() OVER (ORDER BY coalesce(nullif(n_nationkey % 5, 0), 2147483647), n_nationkey) - 1)::BIGINT AS rank FROM nation")
def stack_order(t):
    layers = t.nation.select("n_name", F.col("n_nationkey").alias("ord"))
    order = t.nation.where("n_nationkey % 5 <> 0").select("n_name", (F.col("n_nationkey") % 5).alias("place"))
    return render.stack_order(layers, order, "n_name", "place").select("n_name", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT n_regionkey AS id, count(*)::BIGINT AS n FROM nation GROUP BY n_regionkey HAVING count(*) > 1")
def stack_ids(t):
    return associations.duplicate_ids(t.nation.select(F.col("n_regionkey").alias("id")), "id")


@query("SELECT n_regionkey, count(*)::BIGINT AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def tooltip_sections(t):
    s = render.sections(t.nation.withColumn("text", F.col("n_name")), "n_regionkey", "n_name", "text")
    return s.select("n_regionkey", "n", F.array_join(F.transform("sections", lambda x: x["n_name"]), ",").alias("names"))


@query("SELECT l_orderkey, l_suppkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def pick_dedup(t):
    rows = t.lineitem.withColumn("o", F.struct("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"))
    return render.one_pick_per_layer(rows, "l_suppkey", "o").select("l_orderkey", "l_suppkey", "l_partkey")


# texts

PATHS = ["tables/cells/obs/x", "table/cells/X", "points/a", "images/b/0", "root"]


@query("SELECT * FROM (VALUES ('tables/cells/obs/x', 4::BIGINT, 'tables/cells/obs', 'x', 'cells'), ('table/cells/X', 3::BIGINT, 'table/cells', 'X', 'cells'), ('points/a', 2::BIGINT, 'points', 'a', ''), ('images/b/0', 3::BIGINT, 'images/b', '0', ''), ('root', 1::BIGINT, '', 'root', '')) v(path, depth, dir, base, table_key)")
def path_parse(t):
    p = F.col("path")
    rows = t.spark.createDataFrame([(x,) for x in PATHS], "path string")
    return rows.select("path", text.depth(p).cast("bigint").alias("depth"), text.dirname(p).alias("dir"), text.basename(p).alias("base"), text.element_key(p, "table").alias("table_key"))


@query("SELECT url, len(string_split(url, '/'))::BIGINT AS depth FROM pages")
def path_depth_order(t):
    from lattica.sources import zarr

    return zarr.depth_sorted(t.pages.select("url"), "url").select("url", F.col("depth").cast("bigint").alias("depth"))


@query("SELECT * FROM (VALUES ('tables/cells/obs/x'), ('table/cells/X'), ('points/a'), ('images/b/0')) v(path)")
def orphan_paths(t):
    from lattica.sources import zarr

    return zarr.orphans(t.spark.createDataFrame([(x,) for x in PATHS], "path string"))


@query("SELECT n_name, 'shapes:' || n_name || ':' || n_nationkey AS id, 'shapes' AS kind, n_name || ':' || n_nationkey AS key, 'Shapes: ' || n_name AS label FROM nation")
def layer_ids(t):
    i = text.layer_id(F.lit("shapes"), F.concat_ws(":", "n_name", F.col("n_nationkey").cast("string")))
    kind, key = text.layer_parts(i)
    return t.nation.select("n_name", i.alias("id"), kind.alias("kind"), key.alias("key"), text.label(F.lit("shapes"), F.col("n_name")).alias("label"))


@query("SELECT * FROM (VALUES (1, 'Showing 4,000,000 of 12,165,021 points'), (2, NULL)) v(id, message)")
def cap_messages(t):
    rows = t.spark.createDataFrame([(1, 4_000_000, 12_165_021), (2, 10, 10)], "id int, shown bigint, total bigint")
    return rows.select("id", text.cap_message(F.col("shown"), F.col("total")).alias("message"))


@query("SELECT * FROM (VALUES (0, '0%'), (1, '<1%'), (500, '50%'), (999, '>99%'), (1000, '100%')) v(part, share)")
def percents(t):
    rows = t.spark.createDataFrame([(0,), (1,), (500,), (999,), (1000,)], "part int")
    return rows.select("part", text.percent(F.col("part"), F.lit(1000)).alias("share"))


@query("SELECT c_custkey, rtrim(substr(c_acctbal::VARCHAR, 1, 4), '.') AS short FROM customer")
def shortened_numbers(t):
    return t.customer.select("c_custkey", text.shorten(F.col("c_acctbal").cast("string"), 4).alias("short"))


@query("SELECT * FROM (VALUES (1, 'x'), (2, NULL)) v(id, value)")
def url_parameters(t):
    rows = t.spark.createDataFrame([(1, "https://example.org/?demo=x&y=2"), (2, "https://example.org/")], "id int, url string")
    return rows.select("id", text.query_value(F.col("url"), "demo").alias("value"))


@query("SELECT c_custkey, sha256(c_name) AS hash FROM customer")
def content_hash(t):
    return t.customer.select("c_custkey", text.content_hash(F.col("c_name")).alias("hash"))


@query(f"SELECT name || '=' || code AS entry FROM {SORTED}")
def code_maps(t):
    m = catalog.code_map(catalog.sorted_codes(t.events, "event_type"))
    return m.select(F.explode("codes").alias("name", "code")).select(F.concat_ws("=", "name", F.col("code").cast("string")).alias("entry"))


@query("SELECT string_agg(event_type, '|' ORDER BY event_type) || ':200' AS signature FROM (SELECT DISTINCT event_type FROM events)")
def signatures(t):
    c = t.events.agg(F.array_sort(F.collect_set("event_type")).alias("c"))
    return c.select(colours.signature(F.array_join("c", "|"), F.lit("200")).alias("signature"))


# rasters


@query(f"SELECT y, x::INT AS x, value FROM {PIXELS} WHERE label = 3")
def raster_plane(t):
    return raster.select(pixels(t), ["label", "y", "x"], {"label": 3}).select("y", "x", "value")


@query(f"SELECT y, x::INT AS x, value FROM {PIXELS} WHERE x BETWEEN 32 AND 63 AND y BETWEEN 64 AND 95")
def raster_tile(t):
    return raster.tile(pixels(t), 1, 2, 32, 64, 500).select("y", "x", "value")


@query(f"""SELECT label, lo, hi, round(CASE WHEN a < b THEN a ELSE lo END, 6) AS limit_lo, round(CASE WHEN a < b THEN b ELSE hi END, 6) AS limit_hi FROM (SELECT label, min(value) AS lo, max(value) AS hi, quantile_cont(CASE WHEN value > 0 THEN value END, 0.005) AS a, quantile_cont(CASE WHEN value > 0 THEN value END, 0.995) AS b FROM {PIXELS} GROUP BY label)""")
def channel_stats_2d(t):
    return raster.stats(pixels(t), ["label"]).select("label", "lo", "hi", F.round("limit_lo", 6).alias("limit_lo"), F.round("limit_hi", 6).alias("limit_hi"))


@query(f"""SELECT label, min(lo) AS lo, max(hi) AS hi, round(min(a), 6) AS limit_lo, round(max(b), 6) AS limit_hi FROM (SELECT label, y % 5 AS z, min(value) AS lo, max(value) AS hi, quantile_cont(CASE WHEN value > 0 THEN value END, 0.005) AS a, quantile_cont(CASE WHEN value > 0 THEN value END, 0.995) AS b FROM {PIXELS} WHERE y % 5 IN (0, 2, 4) GROUP BY label, y % 5) GROUP BY label""")
def channel_stats_3d(t):
    rows = raster.stats_3d(pixels(t).withColumn("z", F.col("y") % 5), ["label"], "z", 5)
    return rows.select("label", "lo", "hi", F.round("limit_lo", 6).alias("limit_lo"), F.round("limit_hi", 6).alias("limit_hi"))


@query(f"SELECT (y // 2)::BIGINT AS y, (x // 2)::BIGINT AS x, round(avg(value), 9) AS value FROM {PIXELS} GROUP BY 1, 2")
def pyramid_level(t):
    return raster.downsample(pixels(t), []).select("y", "x", F.round("value", 9).alias("value"))


@query(f"SELECT (y // 2)::BIGINT AS y, (x // 2)::BIGINT AS x, value FROM {PIXELS} WHERE y % 2 = 0 AND x % 2 = 0")
def striding_downsample(t):
    return raster.stride(pixels(t)).select("y", "x", "value")


@query("SELECT vec_id, embedding[1]::DOUBLE AS dim_0, embedding[3]::DOUBLE AS dim_2 FROM embeddings")
def obsm_dims(t):
    from lattica.sources import zarr

    d = zarr.dimensions(t.embeddings.select("vec_id", "embedding"), "embedding", [0, 2])
    return d.select("vec_id", F.col("dim_0").cast("double"), F.col("dim_2").cast("double"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE least(greatest(floor(c_acctbal / 100), 0), 7) END::BIGINT AS i FROM customer")
def axis_clamp(t):
    size = F.when(F.col("c_custkey") % 3 != 0, F.lit(8))
    return t.customer.select("c_custkey", raster.clamp_selection(F.col("c_acctbal") / 100, size).cast("bigint").alias("i"))


@query("SELECT vec_id, CASE WHEN label > 0 AND label <> 3 THEN label END::BIGINT AS label FROM embeddings")
def label_pick(t):
    alphas = F.array(*[F.lit(0 if i == 3 else 255) for i in range(4)])
    return t.embeddings.select("vec_id", colours.picked_label(F.col("label"), alphas).alias("label"))


@query("SELECT p_partkey, y0::INT AS y0, x0::INT AS x0, least(16, 40 - y0)::INT AS h, least(16, p_size - x0)::INT AS w FROM part, range(0, 40, 16) a(y0), range(0, 64, 16) b(x0) WHERE x0 <= greatest(p_size - 1, 0)")
def chunk_grid(t):
    return raster.chunk_grid(t.part.select("p_partkey", "p_size"), F.lit(40), F.col("p_size"), 16).select("p_partkey", "y0", "x0", "h", "w")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '1,2,0,0' WHEN 1 THEN '1,2,3,4' ELSE '0,0,0,0' END AS padded FROM customer")
def pad_arrays(t):
    v = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(1), F.lit(2))).when(F.col("c_custkey") % 3 == 1, F.array(*map(F.lit, range(1, 7)))).otherwise(F.array().cast("array<int>"))
    return t.customer.select("c_custkey", F.array_join(raster.pad(v, F.lit(4), F.lit(0)).cast("array<string>"), ",").alias("padded"))


@query("SELECT '60,20,5,1' AS strides, 't=2,c=3' AS sizes")
def strides_and_sizes(t):
    r = t.spark.createDataFrame([([7, 3, 4, 5], ["t", "c"], [2, 3])], "shape array<int>, axes array<string>, n array<int>")
    sizes = raster.axis_sizes(F.col("axes"), F.col("n"))
    return r.select(F.array_join(raster.strides(F.col("shape")).cast("array<string>"), ",").alias("strides"), F.concat(F.lit("t="), sizes["t"].cast("string"), F.lit(",c="), sizes["c"].cast("string")).alias("sizes"))


@query("SELECT * FROM (VALUES ('uint8', 255.0::DOUBLE), ('uint16', 65535.0), ('int16', 32767.0), ('float32', 1.0), ('bits12', 4095.0)) v(dtype, top)")
def dtype_max(t):
    rows = t.spark.createDataFrame([("uint8", None), ("uint16", None), ("int16", None), ("float32", None), ("bits12", 12)], "dtype string, bits int")
    return rows.select("dtype", raster.dtype_max(F.col("dtype"), F.col("bits")).alias("top"))


@query("SELECT * FROM (VALUES ('um', 2e-6::DOUBLE), ('mm', 0.002), ('x', NULL)) v(unit, metres)")
def si_units(t):
    rows = t.spark.createDataFrame([("um",), ("mm",), ("x",)], "unit string")
    return rows.select("unit", F.round(raster.metres(F.lit(2.0), F.col("unit")), 12).alias("metres"))


@query("SELECT label, 'img:' || (label % 2) || ':' || label || ':0' AS key FROM (SELECT DISTINCT label FROM embeddings)")
def stats_identity(t):
    rows = t.embeddings.select("label").distinct()
    return rows.select("label", raster.stats_key(F.lit("img"), F.col("label") % 2, F.col("label"), F.lit(0)).alias("key"))


@query("SELECT * FROM (VALUES (1, 2::BIGINT), (2, 0::BIGINT), (3, NULL)) v(id, channel)")
def default_channel(t):
    rows = t.spark.createDataFrame([(1, 4, [0, 1, 3]), (2, 3, []), (3, 2, [1, 0])], "id int, n int, used array<int>")
    return rows.select("id", raster.first_unused(F.col("n"), F.col("used")).cast("bigint").alias("channel"))


@query("SELECT p_partkey, least(greatest(power(2.0::DOUBLE, (p_size % 9) - 4), 0.25), 4.0)::DOUBLE AS size FROM part")
def size_scale(t):
    return t.part.select("p_partkey", render.zoom_size(F.col("p_size") % 9, 4, 0.25, 4.0).alias("size"))


@query("SELECT event_id, floor((event_id - 10) / 2.0)::BIGINT AS px, floor((value + 5) / 3.0)::BIGINT AS py FROM events WHERE abs((value + 5) / 3.0 - round((value + 5) / 3.0)) > 1e-9")
def pixel_pick(t):
    from lattica.functions.transforms import apply, inverse, scale, sequence, translation

    m = inverse(sequence([scale([2.0, 3.0]), translation([10.0, -5.0])]))
    x, y = apply(m, F.col("event_id").cast("double"), F.col("value"))
    rows = t.events.where("abs((value + 5) / 3.0 - round((value + 5) / 3.0)) > 1e-9")
    return rows.select("event_id", F.floor(x + 1e-12).cast("bigint").alias("px"), F.floor(y).cast("bigint").alias("py"))


@query("SELECT p_partkey, (p_size * 0.5)::DOUBLE AS width, (p_size * 0.5 / 0.25)::DOUBLE AS ratio FROM part")
def physical_scale(t):
    width = F.col("p_size") * F.lit(0.5)
    return t.part.select("p_partkey", width.alias("width"), raster.physical_ratio(width, F.lit(0.25)).alias("ratio"))


@query("""SELECT l_partkey AS col, l_orderkey AS row, l_linenumber AS value, indptr FROM lineitem JOIN (SELECT l_partkey, (sum(count(*)) OVER (ORDER BY l_partkey) - count(*))::BIGINT AS indptr FROM lineitem WHERE l_linenumber <> 0 GROUP BY l_partkey) USING (l_partkey) WHERE l_linenumber <> 0""")
def csc_order(t):
    entries, pointer = raster.csc(t.lineitem.select(F.col("l_partkey").alias("col"), F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("value")), "row", "col", "value")
    return entries.join(pointer, "col").select("col", "row", "value", F.col("indptr").cast("bigint").alias("indptr"))


@query(f"SELECT label, 0::BIGINT AS t, label::BIGINT AS c, 0::BIGINT AS z, y, x::INT AS x FROM {PIXELS}")
def axis_reorder(t):
    rows = raster.to_tczyx(pixels(t).withColumn("c", F.col("label")), ["c", "y", "x"])
    return rows.select(F.col("c").cast("int").alias("label"), "t", "c", "z", "y", F.col("x").cast("int").alias("x"))


@query("SELECT * FROM (VALUES ('t', 0::BIGINT), ('c', 2::BIGINT)) v(axis, pos)")
def default_selection(t):
    s = raster.default_selections({"t": 1, "c": 3, "y": 9, "x": 9})
    return t.spark.createDataFrame([("t", s[-1]["t"]), ("c", s[-1]["c"])], "axis string, pos bigint")


@query("SELECT 'global' AS system, 12.0::DOUBLE AS x, 22.0::DOUBLE AS y UNION ALL SELECT 'other', 1.0, 2.0")
def level_transforms(t):
    from lattica.functions.transforms import apply, by_output

    specs = [{"type": "scale", "scale": [2.0, 2.0]}, {"type": "translation", "translation": [10.0, 18.0]}, {"type": "identity", "output": {"name": "other"}}]
    out = None
    for name, m in by_output(specs).items():
        x, y = apply(m, F.lit(1.0), F.lit(2.0))
        row = t.spark.range(1).select(F.lit(name).alias("system"), x.alias("x"), y.alias("y"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT 'c' AS target, 7.0::DOUBLE AS x, -2.0::DOUBLE AS y")
def coordinate_path(t):
    from lattica.functions.transforms import apply, path, translation

    m = path([("a", "b", translation([5.0, 0.0])), ("c", "b", translation([-1.0, 4.0]))], "a", "c")
    x, y = apply(m, F.lit(1.0), F.lit(2.0))
    return t.spark.range(1).select(F.lit("c").alias("target"), x.alias("x"), y.alias("y"))


@query("SELECT 'ome' AS source, 's0' AS path UNION ALL SELECT 'plain', '0'")
def ome_normalise(t):
    rows = t.spark.createDataFrame([("ome", '{"ome":{"multiscales":[{"datasets":[{"path":"s0"}]}]}}'), ("plain", '{"multiscales":[{"datasets":[{"path":"0"}]}]}')], "source string, attrs string")
    from lattica.sources import zarr

    return rows.select("source", zarr.ome_path(F.col("attrs")).alias("path"))


@query("SELECT * FROM (VALUES (1, 'a'), (1, 'c')) v(version, layer)")
def props_migration(t):
    rows = t.spark.createDataFrame([('{"layers":[{"id":"a","kind":"points"},{"id":"b","kind":"unknown"},{"id":"c","kind":"shapes"}]}',)], "raw string")
    return rows.select(F.explode(render.migrated_layers(F.col("raw"))).alias("l")).select(F.lit(1).alias("version"), F.col("l.id").alias("layer"))


@query("SELECT * FROM (VALUES ('c_acctbal', 'numeric'), ('c_custkey', 'numeric'), ('c_mktsegment', 'string'), ('c_name', 'string'), ('c_nationkey', 'numeric')) v(name, kind)")
def obs_kinds(t):
    from lattica.sources import zarr

    names = {"double": "float64", "bigint": "int64", "int": "int32", "string": "string", "boolean": "bool"}
    rows = [(n, zarr.column_kind({"attrs": {}, "dtype": names[d]})) for n, d in t.customer.dtypes]
    return t.spark.createDataFrame(rows, "name string, kind string")


@query("SELECT * FROM (VALUES ('<i4', 'int32'), ('|O', 'string'), ('<U12', 'string'), ('float16', 'float16'), ('complex64', NULL)) v(raw, dtype)")
def dtype_map(t):
    from lattica.sources import zarr

    return t.spark.createDataFrame([(r, zarr.normal_dtype(r)) for r in ("<i4", "|O", "<U12", "float16", "complex64")], "raw string, dtype string")


@query("SELECT 'c_custkey,c_nationkey,c_acctbal,c_name,c_mktsegment' AS columns")
def string_columns_last(t):
    from lattica.sources import write

    return t.spark.createDataFrame([(",".join(write.strings_last(t.customer).columns),)], "columns string")


@query("SELECT n_regionkey AS system, n_name AS element FROM nation WHERE n_regionkey = 2")
def elements_in_system(t):
    rows = t.nation.groupBy("n_name").agg(F.collect_set("n_regionkey").alias("systems"))
    return associations.in_system(rows, "systems", 2).select(F.lit(2).alias("system"), F.col("n_name").alias("element"))


@query("SELECT event_type, min(event_id)::BIGINT AS first FROM events GROUP BY event_type")
def ordered_distinct_systems(t):
    return associations.systems_of(t.events, "event_type", "event_id")


@query("SELECT (count(*) + 0)::BIGINT AS n, count(DISTINCT label)::BIGINT AS channels FROM embeddings")
def channel_count(t):
    return raster.channels_of(t.embeddings, "label")


@query("SELECT n_regionkey AS id, min(n_nationkey)::BIGINT AS ord FROM nation GROUP BY n_regionkey")
def stack_entry_ids(t):
    stack = t.nation.select(F.col("n_regionkey").alias("id"), F.col("n_nationkey").cast("bigint").alias("ord"))
    return render.entry_ids(stack)


@query("SELECT n_nationkey AS id, n_nationkey::BIGINT AS ord, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::DOUBLE ELSE 0.5 END AS opacity FROM nation WHERE n_regionkey = 1")
def layer_inputs(t):
    value = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("string")).otherwise("thick")
    stack = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("bigint").alias("ord"), F.col("n_regionkey").alias("kind"), F.create_map(F.lit("opacity"), value).alias("props"))
    return render.layer_inputs(stack, 1, {"opacity": 0.5})


@query("SELECT i::BIGINT AS code, CASE WHEN i = 7 THEN 1 END::BIGINT AS own FROM range(0, 4096) r(i)")
def palette_overrides(t):
    own = t.spark.createDataFrame([(7, [1, 2, 3])], "code bigint, colour array<int>")
    table = colours.palette_table(t.spark, 40, own)
    return table.select("code", F.when(F.get("colour", 2) == 3, F.when(F.get("colour", 1) == 2, F.get("colour", 0))).cast("bigint").alias("own"))


@query("SELECT 'x' AS axis, 0.0::DOUBLE AS lo, 50.0::DOUBLE AS hi UNION ALL SELECT 'y', 0.0, 20.0 UNION ALL SELECT 'z', 0.0, 1.0")
def bounding_cube(t):
    cube = raster.bounding_cube({"x": 100, "y": 40}, {"x": 0.5, "y": 0.5})
    return t.spark.createDataFrame([(a, *r) for a, r in zip("xyz", cube, strict=True)], "axis string, lo double, hi double")


@query("SELECT count(DISTINCT (c_nationkey, c_mktsegment))::BIGINT AS n FROM customer")
def input_descriptions(t):
    rows = t.customer.select(text.description(nation=F.col("c_nationkey"), segment=F.col("c_mktsegment")).alias("key"))
    return rows.agg(F.count_distinct("key").alias("n"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 4 ELSE 128 END::BIGINT AS r FROM customer")
def palette_by_value(t):
    given = {"BUILDING": [1, 2, 3, 255], "MACHINERY": [4, 5, 6, 255]}
    return t.customer.select("c_custkey", F.get(colours.palette_by_value(F.col("c_mktsegment"), given), 0).cast("bigint").alias("r"))
