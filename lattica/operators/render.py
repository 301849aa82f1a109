"""States and orders of what is shown, as CASE logic over small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Opacity of a row in each state that isn't fully shown.
OPACITY = {"notLoaded": 0.45, "noIndex": 0.35, "loading": 0.7}


def feature_row_state(c: dict[str, Column]) -> Column:
    """One of eight states, by precedence.

    ``c``: resident_known, resident, rendered, selected, scanning, on_demand, resident_count, dataset_count.
    """
    partial = c["resident"] & ~c["rendered"] & (c["resident_count"] < c["dataset_count"])
    return (
        F.when(~c["resident_known"], "shown")
        .when(partial, "partial")
        .when(c["resident"], "resident")
        .when(c["rendered"], F.when(c["selected"], "loaded").otherwise("cached"))
        .when(c["selected"] & c["scanning"], "loading")
        .when(~c["on_demand"], "noIndex")
        .otherwise("notLoaded")
    )


def opacity(state: Column) -> Column:
    out = F.lit(1.0)
    for k, v in OPACITY.items():
        out = F.when(state == k, F.lit(v)).otherwise(out)
    return out


def tile_status(done: Column, rows: Column, failed: Column, aborted: Column) -> Column:
    return F.when(aborted, "aborted").when(failed, "error").when(~done, "loading").when(rows > 0, "loaded").otherwise("empty")


def last_event(events: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """The latest status of each key."""
    return events.groupBy(key).agg(F.max_by(status, at).alias(status), F.max(at).alias(at))


def stack_order(layers: DataFrame, order: DataFrame, key: str, place: str) -> DataFrame:
    """Layers in the order of the stack; those it doesn't name come last in their own order."""
    far = 2**31 - 1
    pos = order.select(F.col(key).alias("_k"), F.col(place).alias("_place"))
    joined = layers.join(pos, F.col(key) == F.col("_k"), "left")
    return joined.withColumn("rank", F.row_number().over(W.orderBy(F.coalesce("_place", F.lit(far)), "ord")) - 1).drop("_k", "_place")


def one_pick_per_layer(picks: DataFrame, layer: str, order: str) -> DataFrame:
    return picks.withColumn("_n", F.row_number().over(W.partitionBy(layer).orderBy(order))).where("_n = 1").drop("_n")


def sections(items: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """Tooltip sections of each key, in order of title."""
    return items.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(title, text))).alias("sections"))


def overlay(features: DataFrame, key: str, colours: DataFrame, hidden: DataFrame, faded: DataFrame, default: Column, factor: float) -> DataFrame:
    """Colour of each feature: hidden is transparent, faded has less alpha, else its own or the default.

    The three state tables are joined by key; small ones are broadcast by their size.
    """
    out = features.join(colours.withColumnRenamed("colour", "_own"), key, "left")
    out = out.join(hidden.select(key, F.lit(True).alias("_hidden")), key, "left").join(faded.select(key, F.lit(True).alias("_faded")), key, "left")
    base = F.coalesce("_own", default)
    alpha = F.when(F.col("_hidden"), 0).when(F.col("_faded"), F.floor(F.get(base, 3) * factor + 0.5).cast("int")).otherwise(F.get(base, 3))
    return out.withColumn("colour", F.concat(F.slice(base, 1, 3), F.array(alpha.cast("int")))).drop("_own", "_hidden", "_faded")


#: Kinds of layers that stored properties may have.
LAYER_KINDS = ("points", "shapes", "images", "labels")


def migrated_layers(raw: Column) -> Column:
    """Layers of stored properties in the present form: array of id, kind; those of unknown kinds are dropped."""
    layers = F.from_json(raw, "layers array<struct<id:string,kind:string>>")["layers"]
    return F.filter(layers, lambda x: x["kind"].isin(*LAYER_KINDS))


def entry_ids(stack: DataFrame, key: str = "id", host: str | None = None) -> DataFrame:
    """The ids of a stack's entries, or of those of one host, each once in the stack's order (``ord``)."""
    rows = stack if host is None else stack.where(F.col("host") == host)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("ord").alias("ord")).orderBy("ord")


def layer_inputs(stack: DataFrame, kind: str, numbers: dict[str, float]) -> DataFrame:
    """Entries of a kind with their numeric properties (a map of text), defaults where they aren't finite numbers."""
    value = lambda k, d: F.coalesce(F.nullif(F.col("props")[k].try_cast("double"), F.lit(float("nan"))), F.lit(float(d)))
    return stack.where(F.col("kind") == kind).select("id", "ord", *[value(k, d).alias(k) for k, d in numbers.items()])


def zoom_size(zoom: Column, reference: float, low: float, high: float) -> Column:
    """A size that doubles with each level of zoom, held between two bounds."""
    return F.least(F.greatest(F.pow(F.lit(2.0), zoom - reference), F.lit(low)), F.lit(high))


class BoundsCache:
    """World bounds by element, version and matrix: computed once, dropped with the element."""

    def __init__(self):
        self.held: dict[tuple, tuple] = {}

    def get(self, element: str, version, matrix, compute):
        key = (element, version, None if matrix is None else tuple(map(float, matrix.ravel())))
        if key not in self.held:
            row = compute().first()
            self.held[key] = None if row is None or row[0] is None else tuple(row)
        return self.held[key]

    def drop(self, element: str) -> None:
        self.held = {k: v for k, v in self.held.items() if k[0] != element}
