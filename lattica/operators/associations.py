"""Annotation tables joined to the elements they describe. Ids compare as strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.session import checkpointed, small


def accepted_regions(kind: str, key: str, regions: Sequence[str] = (), strict: bool = False) -> list[str]:
    """The element's key and kind/key, and every region that the table declares, both ways."""
    names = [key] if strict else [key, *regions]
    return list(dict.fromkeys(v for n in names for v in (n, f"{kind}/{n}")))


def tables_for(tables: DataFrame, kind: str, key: str) -> DataFrame:
    """Tables (with an array ``region``) that describe the element."""
    return tables.where(F.arrays_overlap("region", F.array(F.lit(key), F.lit(f"{kind}/{key}"))))


def rows_of(table: DataFrame, region: str | None, accepted: Sequence[str]) -> DataFrame:
    """The table's rows for the regions; null and '' belong to all; if none is left, all rows."""
    if region is None:
        return table
    keep = F.col(region).isNull() | (F.col(region) == "") | F.col(region).isin(list(accepted))
    none = table.agg((F.coalesce(F.max(keep.cast("int")), F.lit(0)) == 0).alias("_none"))
    return table.crossJoin(F.broadcast(none)).where(keep | F.col("_none")).drop("_none")  # one row


def row_by_id(rows: DataFrame, instance: str, row_index: str) -> DataFrame:
    """id, row_index: the last row of each id."""
    return rows.groupBy(F.col(instance).cast("string").alias("id")).agg(F.max(row_index).alias("row_index"))


def associate(features: DataFrame, feature_id: str, rows: DataFrame, instance: str, row_index: str) -> DataFrame:
    """Each feature with the index of its annotation row, or -1."""
    found = row_by_id(rows, instance, row_index)
    return features.join(found, F.col(feature_id).cast("string") == F.col("id"), "left").withColumn("row_index", F.coalesce("row_index", F.lit(-1))).drop("id")


def by_position(features: DataFrame, rows: DataFrame, order: str, row_order: str) -> DataFrame:
    """Features and rows paired by position (each side numbered from 0 in its order)."""
    number = lambda df, by, name: numbered(df, by, name)
    return number(features, order, "position").join(number(rows, row_order, "position"), "position")


def numbered(df: DataFrame, order: str, name: str, ranges: int | None = None) -> DataFrame:
    """Rows numbered from 0 in order, in two steps: range counts, then rows of a range.

    The ranges are those of range partitioning, so no task orders the whole table. Their limits
    are sampled, so the dealt rows are written before they are counted: a second evaluation
    could draw others.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, order).sortWithinPartitions(order).withColumn("_range", F.spark_partition_id())
    dealt = checkpointed(dealt.withColumn("_n", F.monotonically_increasing_id() - F.shiftleft(F.col("_range").cast("bigint"), 33)))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_rows"))
    start = F.sum("_rows").over(W.orderBy("_range")) - F.col("_rows")
    starts = counts.select("_range", start.alias("_start"))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_n")).drop("_range", "_n", "_start")  # one row for each range


def aligns_by_position(features: DataFrame, feature_id: str, rows: DataFrame, instance: str) -> Column:
    """One-row verdict: counts are equal and not 0, the ids are exactly 0..n-1, and the rows' aren't."""
    f = features.agg(F.count("*").alias("n"), F.count_distinct(F.col(feature_id)).alias("d"), F.min(feature_id).alias("lo"), F.max(feature_id).alias("hi"))
    r = rows.agg(F.count("*").alias("rn"), F.count_distinct(F.col(instance)).alias("rd"), F.min(instance).alias("rlo"), F.max(instance).alias("rhi"))
    zero = lambda n, d, lo, hi: (F.col(n) > 0) & (F.col(d) == F.col(n)) & (F.col(lo) == 0) & (F.col(hi) == F.col(n) - 1)
    return f.crossJoin(r).select((zero("n", "d", "lo", "hi") & (F.col("n") == F.col("rn")) & ~zero("rn", "rd", "rlo", "rhi")).alias("by_position"))  # one row each


def first_known(*candidates: Column) -> Column:
    """The first row index that isn't null or -1, else -1."""
    return F.coalesce(*[F.nullif(c, F.lit(-1)) for c in candidates], F.lit(-1))


def tooltip_items(columns: dict[str, Column]) -> Column:
    """label: value pairs in order, without empty values."""
    items = [F.when(v.isNotNull() & (F.trim(v) != ""), F.concat(F.lit(f"{k}: "), v)) for k, v in columns.items()]
    return F.array_compact(F.array(*items))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def decode(df: DataFrame, code: str, categories: DataFrame, value: str = "category") -> DataFrame:
    """Codes to categories; a negative or unknown code is null."""
    cats = categories.select(F.col("code").alias("_code"), value)
    return df.join(small(cats), F.col(code) == F.col("_code"), "left").drop("_code")


def masked(value: Column, mask: Column) -> Column:
    """A nullable array's value: null where the mask is set."""
    return F.when(~F.coalesce(mask, F.lit(False)), value)


def last_values(rows: DataFrame, instance: str, row_order: str, value: str) -> DataFrame:
    """id (as text), value: of each id that of its last row."""
    return rows.groupBy(F.col(instance).cast("string").alias("id")).agg(F.max_by(value, row_order).alias("value"))


def column_for(features: DataFrame, feature_id: str, rows: DataFrame, instance: str, row_order: str, column: str) -> DataFrame:
    """Features with ``value``: the column of their annotation row, by id as text; null without one."""
    found = last_values(rows, instance, row_order, column)
    return features.join(found, F.col(feature_id).cast("string") == F.col("id"), "left").drop("id")


def label_tooltips(labels: DataFrame, label: str, rows: DataFrame, instance: str, row_order: str, column: str) -> DataFrame:
    """Labels with ``tooltip``: the text of their annotation row, '' without one."""
    found = column_for(labels, label, rows, instance, row_order, column)
    return found.withColumn("tooltip", F.coalesce(F.col("value").cast("string"), F.lit(""))).drop("value")


def shape_tooltips(features: DataFrame, feature_id: str, rows: DataFrame, instance: str, row_index: str, aligned: bool) -> DataFrame:
    """Features with ``row_index``: kept where they are aligned with the rows already, else by id."""
    if aligned:
        return features
    return associate(features.drop("row_index"), feature_id, rows, instance, row_index)


def in_system(elements: DataFrame, systems: str, system) -> DataFrame:
    """The elements (with an array of systems) that are available in one."""
    return elements.where(F.array_contains(systems, system))


def systems_of(elements: DataFrame, system: str, order: str) -> DataFrame:
    """Distinct systems, each with the place of its first element, in that order."""
    return elements.groupBy(system).agg(F.min(order).alias("first")).orderBy("first")
