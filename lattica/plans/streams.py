"""Queries that run as streams to the end of their input, and footer relations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lattica.plans.registry import query
from lattica.session import shared_folder
from lattica.sources import parquet
from lattica.streaming import progressive


def folder(t) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


def events(t):
    return progressive.stream(t.spark, t.folder, t.events.schema, glob="events.parquet")


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def stream_counts(t):
    return progressive.counts(t.spark, events(t), "event_type", folder(t))


@query("SELECT event_id, value, event_type FROM events WHERE event_type IN ('click', 'view') AND isfinite(value)")
def stream_matching(t):
    rows = progressive.matching(t.spark, events(t), F.col("event_type").isin("click", "view") & ~F.isnan("value"), folder(t))
    return rows.select("event_id", "value", "event_type")


@query("SELECT (row_number() OVER (ORDER BY event_type) - 1)::BIGINT AS code, event_type AS name FROM (SELECT DISTINCT event_type FROM events)")
def stream_catalog(t):
    return progressive.catalog(t.spark, events(t), "event_type", folder(t))


@query("SELECT count(*)::BIGINT AS rows FROM lineitem")
def footer_rows(t):
    """Rows by the footers of all files of a data set."""
    found = parquet.row_groups(t.spark, parquet.parts(f"{t.folder}/lineitem.parquet", t.spark))
    return parquet.groups(found).agg(F.sum("rows").alias("rows"))


@query("SELECT min(l_orderkey)::BIGINT AS lo, max(l_orderkey)::BIGINT AS hi FROM lineitem")
def footer_extent(t):
    found = parquet.row_groups(t.spark, parquet.parts(f"{t.folder}/lineitem.parquet", t.spark))
    return parquet.extents(found, "l_orderkey").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS row_index FROM events")
def parquet_row_index(t):
    df = parquet.read(t.spark, f"{t.folder}/events.parquet", ["event_id"])
    return df.select("event_id", "row_index")


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 300")
def capped_read(t):
    """The first rows in file order, of the parts that hold them."""
    return parquet.read_capped(t.spark, f"{t.folder}/events.parquet", 300, ["event_id", "value"]).select("event_id", "value")


@query("SELECT count(*)::BIGINT AS n, min(event_id)::BIGINT AS first FROM events")
def row_group_read(t):
    """All row groups, one by one."""
    path = f"{t.folder}/events.parquet"
    n = parquet.groups(parquet.row_groups(t.spark, parquet.parts(path, t.spark))).count()
    rows = None
    for g in range(n):
        some = parquet.read_row_group(t.spark, path, g, ["event_id"])
        rows = some if rows is None else rows.unionByName(some)
    return rows.agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("SELECT count(*)::BIGINT AS n FROM events")
def multipart_concat(t):
    return parquet.concat(t.spark, f"{t.folder}/events.parquet").agg(F.count("*").alias("n"))
