"""Catalogues of feature names and codes, counts, and selections.

A catalogue has as many rows as there are distinct features, so ranking windows without a
partition run on that side only, after a partial aggregate. Joins of rows to a catalogue count it
first, and broadcast it if it is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.numbers import finite
from lattica.session import small

MISSING = -1


def code_column(columns: Sequence[str], feature_key: str) -> str | None:
    """The column of codes: that of the key, then two general names."""
    return next((c for c in (f"{feature_key}_codes", "feature_name_codes", "feature_index") if c in columns), None)


def by_code(df: DataFrame, code: str, name: str, row_id: str) -> DataFrame:
    """code, name (that of the first row; null is ''), count; rows without a finite code are left out."""
    return df.where(finite(F.col(code))).groupBy(F.col(code).cast("int").alias("code")).agg(
        F.coalesce(F.min_by(F.coalesce(F.col(name), F.lit("")), row_id), F.lit("")).alias("name"), F.count("*").alias("count")
    )


def first_seen(df: DataFrame, name: str, row_id: str) -> DataFrame:
    """code (order of first appearance), name (null is ''), count."""
    g = df.groupBy(F.coalesce(F.col(name), F.lit("")).alias("name")).agg(F.min(row_id).alias("first"), F.count("*").alias("count"))
    return g.select((F.row_number().over(W.orderBy("first")) - 1).alias("code"), "name", "count")


def sorted_codes(df: DataFrame, name: str) -> DataFrame:
    """code (rank of the sorted name), name, count; null names have no code."""
    g = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("count"))
    return g.select((F.dense_rank().over(W.orderBy("name")) - 1).alias("code"), "name", "count")


def row_codes(df: DataFrame, catalog: DataFrame, name: str) -> DataFrame:
    """The rows with ``code``; null and unknown names have -1."""
    names = small(catalog.select(F.col("code").alias("_code"), F.col("name").alias("_name")))
    return df.join(names, F.col(name) == F.col("_name"), "left").withColumn("code", F.coalesce("_code", F.lit(MISSING))).drop("_code", "_name")


def remap(df: DataFrame, code: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """Codes of one catalogue as those of another, by name; -1 where it has no such name."""
    pairs = old.select(F.col("code").alias("_old"), "name").join(new.select(F.col("code").alias("_new"), "name"), "name").select("_old", "_new")
    return df.join(small(pairs), F.col(code) == F.col("_old"), "left").withColumn("new_code", F.coalesce("_new", F.lit(MISSING))).drop("_old", "_new")


def histogram(df: DataFrame, code: str) -> DataFrame:
    """code, count of finite codes; -1 is counted."""
    return df.where(finite(F.col(code))).groupBy(F.col(code).cast("int").alias("code")).agg(F.count("*").alias("count"))


def tally(df: DataFrame, catalog: DataFrame, name: str) -> DataFrame:
    """code, count by name; names without a code are dropped."""
    return row_codes(df, catalog, name).where(F.col("code") != MISSING).groupBy("code").agg(F.count("*").alias("count"))


def merge_counts(catalog: DataFrame, counts: DataFrame) -> DataFrame:
    """The catalogue with new counts where there are any, else its own."""
    new = counts.select("code", F.col("count").alias("_new"))
    return catalog.join(new, "code", "left").withColumn("count", F.coalesce("_new", "count")).drop("_new")


def names_to_codes(catalog: DataFrame | None, names: DataFrame | None, codes: Sequence[int] | None, spark=None) -> DataFrame | None:
    """The selection's codes: those of known names if names are given, else the codes as they are."""
    if names is None:
        return None if codes is None else spark.createDataFrame([(int(c),) for c in codes], "code int")
    if catalog is None:
        return names.sparkSession.createDataFrame([], "code int")
    return catalog.join(names.select("name").distinct(), "name", "left_semi").select("code")


def codes_to_names(catalog: DataFrame, codes: DataFrame) -> DataFrame:
    return catalog.join(codes.select("code").distinct(), "code", "left_semi").select("name")


def overrides_by_name(catalog: DataFrame, overrides: DataFrame) -> DataFrame:
    """name-keyed overrides as code-keyed ones; unknown names are dropped."""
    return overrides.join(catalog.select("code", "name"), "name").drop("name")


def covers(wanted: str, held: str):
    """Whether each array of wanted codes lies in the array held."""
    return F.size(F.array_except(wanted, held)) == 0


def signature(codes: str):
    return F.array_join(F.transform(F.array_sort(codes), lambda c: c.cast("string")), ",")


def ordered(catalog: DataFrame) -> DataFrame:
    """The catalogue by code."""
    return catalog.orderBy("code")


def code_space(catalog: DataFrame | None, spark=None) -> DataFrame:
    """One row: the greatest code and one more; 0 of an empty catalogue or none."""
    if catalog is None:
        return spark.createDataFrame([(0,)], "size bigint")
    return catalog.agg(F.coalesce(F.max("code") + 1, F.lit(0)).cast("bigint").alias("size"))


def names_of(*chunks: DataFrame, name: str) -> DataFrame:
    """Distinct names of one or more chunks, null being ''."""
    out = None
    for c in chunks:
        some = c.select(F.coalesce(F.col(name), F.lit("")).alias("name")).distinct()
        out = some if out is None else out.union(some)
    return out.distinct() if len(chunks) > 1 else out


def sorted_names(catalog: DataFrame) -> DataFrame:
    """One row: codes in order, and names in order."""
    return catalog.agg(F.array_sort(F.collect_list("code")).alias("codes"), F.array_sort(F.collect_list("name")).alias("names"))


def code_map(catalog: DataFrame) -> DataFrame:
    """One row: names to codes."""
    return catalog.agg(F.map_from_entries(F.collect_list(F.struct("name", "code"))).alias("codes"))


def upgraded(rows: DataFrame, code: str, preview: DataFrame, full: DataFrame) -> DataFrame:
    """Rows coded by a preview catalogue with the codes of the full one: names the preview didn't have are -1."""
    return remap(rows, code, preview, full).drop(code).withColumnRenamed("new_code", code)
