"""Checks of written data sets: a relation of (id, passed, detail) for each."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.model import PointColumns
from lattica.operators import index
from lattica.sources import parquet
from lattica.sources.write import MULTISCALE_FORMAT, MULTISCALE_KEY

SCHEMA = "id string, passed boolean, detail string"
#: Fixed end of the names of columns that only a writer in progress has.
STAGING = "_uint"
MOST_MARKS = 4


def _found(spark: SparkSession, rows: Sequence[tuple[str, bool, str]]) -> DataFrame:
    return spark.createDataFrame([(i, bool(ok), d) for i, ok, d in rows], SCHEMA)


def _readable(spark: SparkSession, path: str):
    """(rows of checks so far, footers by part or None)."""
    try:
        files = parquet.parts(path, spark)
    except Exception as e:  # whatever the store says, there is no such data set
        return [("file_exists", False, str(e).split("\n")[0])], None
    rows = [("file_exists", bool(files), path)]
    if not files:
        return rows, None
    try:
        return rows, [parquet.footer(spark, files[0])]
    except Exception as e:
        return [*rows, ("parquet_readable", False, str(e).split("\n")[0])], None


def morton_file(spark: SparkSession, path: str, c: PointColumns, morton: str = "morton") -> DataFrame:
    """A sorted point data set: columns, no staging columns, markers in a row group of their own, their box, and the order."""
    rows, found = _readable(spark, path)
    if found is None:
        return _found(spark, rows)
    names = found[0].schema.to_arrow_schema().names
    for k, name in (("column_present", morton), ("x_column_present", c.x), ("y_column_present", c.y)):
        rows.append((k, name in names, name))
    staging = [n for n in names if n.endswith(STAGING)]
    rows.append(("no_staging_columns", not staging, ", ".join(staging)))
    if not all(ok for _, ok, _ in rows[:4]):
        return _found(spark, rows)
    df = parquet.read(spark, path, [morton, c.x, c.y]).withColumnRenamed(morton, "morton")
    first = parquet.groups(parquet.row_groups(spark, parquet.parts(path, spark))).orderBy("group_id").select("part", "rows").first()
    df = df.withColumn("row_number", F.col("row_index"))
    if df.select("part").distinct().count() > 1:  # parts follow each other
        counts = {r["part"]: r["n"] for r in df.groupBy("part").agg(F.count("*").alias("n")).collect()}
        before, at = {}, 0
        for p in sorted(counts):
            before[p], at = at, at + counts[p]
        df = df.withColumn("row_number", F.col("row_index") + F.create_map(*[x for p, n in before.items() for x in (F.lit(p), F.lit(n).cast("bigint"))])[F.col("part")])
    verdict = {r["id"]: r["passed"] for r in index.verify(df, c, "row_number").collect()}
    marks = df.where((F.col("row_number") < MOST_MARKS) & (F.col("morton") == 0)).count()
    rows += [(k, v, "") for k, v in verdict.items()]
    rows.append(("group_of_markers", first["rows"] <= MOST_MARKS and first["rows"] == marks, f"{first['rows']} rows, {marks} markers"))
    return _found(spark, rows)


def multiscale_file(spark: SparkSession, path: str) -> DataFrame:
    """The multiscale format's metadata in a footer: its format and a box."""
    rows, found = _readable(spark, path)
    if found is None:
        return _found(spark, rows)
    stored = parquet.key_values(path, spark).get(MULTISCALE_KEY)
    if stored is None:
        return _found(spark, [*rows, ("multiscale_metadata", False, "there is none")])
    document = json.loads(stored)
    box = document.get("bounding_box")
    whole = isinstance(box, dict) and all(isinstance(box.get(k), list) and box[k] for k in ("min", "max"))
    return _found(spark, [*rows, ("multiscale_metadata", document.get("format") == MULTISCALE_FORMAT, str(document.get("format"))), ("multiscale_box", whole, "")])


def layouts(spark: SparkSession, folder: str, manifest: dict, c: PointColumns) -> DataFrame:
    """A manifest of physical layouts: each is there, and those sorted by Morton code are in order."""
    names = manifest.get("layouts") or []
    rows = [("manifest_layouts", bool(names), f"{len(names)} layouts")]
    for name in names:
        _, found = _readable(spark, f"{folder}/{name}")
        rows.append((f"path_{name}", found is not None, f"{folder}/{name}"))
        if found is not None and index.LAYOUTS.get(name, ())[:1] == ("morton",):
            df = parquet.read(spark, f"{folder}/{name}", ["morton"])
            ends = df.groupBy("part").agg(F.min_by("morton", "row_index").alias("first"), F.max_by("morton", "row_index").alias("last"), F.min("morton").alias("lo"), F.max("morton").alias("hi"))
            parts = sorted(ends.collect(), key=lambda r: r["part"])  # one row for each file
            apart = all(a["hi"] <= b["lo"] for a, b in zip(parts, parts[1:], strict=False)) and all(r["first"] == r["lo"] and r["last"] == r["hi"] for r in parts)
            rows.append((f"{name}_sorted", apart, f"{len(parts)} files"))
    return _found(spark, rows)


def all_passed(checks: DataFrame) -> bool:
    """Whether there are checks and none failed."""
    return bool(checks.agg(F.coalesce(F.every("passed"), F.lit(False)).alias("all")).first()["all"])
