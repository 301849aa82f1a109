"""Sinks: sorted points, physical layouts, sparse columns, consolidated metadata."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lattica.model import PointColumns
from lattica.operators import associations, index, raster

ROW_GROUP = 50_000


def strings_last(df: DataFrame) -> DataFrame:
    text = [n for n, t in df.dtypes if t == "string"]
    return df.select(*[c for c in df.columns if c not in text], *text)


def write_points(df: DataFrame, c: PointColumns, path: str, *, layout: str = "morton", markers: bool = True, row_group_bytes: int | None = None) -> None:
    """Sorted points as Parquet by Spark's writer: one global order over the files, zstd, statistics."""
    out = strings_last(index.sort_points(df, c, layout, markers)).write.mode("overwrite").option("compression", "zstd")
    if row_group_bytes:
        out = out.option("parquet.block.size", str(row_group_bytes)).option("parquet.block.size.row.check.min", "10")
    out.parquet(path)


def _arrow_files(df: DataFrame, folder: str, name, rows: int, first: int = 0, metadata: dict[str, str] | None = None) -> int:
    """Write each partition as a file ``name(partition)`` with row groups of ``rows`` rows; returns the rows.

    The tasks write, batch by batch, under a name of their own, and rename when the file is whole, so a
    task that is run again replaces itself. ``first`` is the size of a file's first group if that differs,
    ``metadata`` goes into the footers. Folders are local on a local master, else of a store that Arrow opens.
    """
    schema = to_arrow_schema(df.schema).with_metadata({k.encode(): v.encode() for k, v in (metadata or {}).items()} or None)

    def run(batches):
        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        target, total, held, n = f"{root}/{name(part)}", 0, [], 0
        temporary, out, want = f"{root}/.{name(part)}.{uuid.uuid4().hex}", None, first or rows

        def flush():
            nonlocal out, held, n, want
            out = out or pq.ParquetWriter(fs.open_output_stream(temporary), schema, compression="zstd", write_statistics=True)
            out.write_table(pa.concat_tables(held), row_group_size=max(1, n))
            held, n, want = [], 0, rows

        for batch in batches:
            t = pa.Table.from_batches([batch]).cast(schema)
            while t.num_rows:
                held.append(t.slice(0, want - n))
                t, n = t.slice(held[-1].num_rows), n + held[-1].num_rows
                total += held[-1].num_rows
                if n == want:
                    flush()
        if held:
            flush()
        if out:
            sink = out.file_handle or out.where
            out.close()
            sink.close()
            fs.move(temporary, target)
        yield pa.record_batch([pa.array([total], pa.int64())], names=["rows"])

    return sum(r["rows"] for r in df.mapInArrow(run, "rows bigint").collect())  # one row for each file


def write_exact_groups(df: DataFrame, c: PointColumns, path: str, rows: int = ROW_GROUP) -> None:
    """One file whose first row group holds the marker rows alone and others ``rows`` rows.

    For tables of one file: one task writes it, batch by batch.
    """
    folder, _, name = path.rpartition("/")
    ordered = strings_last(index.sort_points(df, c))
    _arrow_files(ordered.coalesce(1), folder or ".", lambda _: name, rows, index.extremes(df, c).count())


def write_grouped(df: DataFrame, c: PointColumns, folder: str, rows: int = ROW_GROUP, metadata: dict[str, str] | None = None) -> int:
    """Sorted points as part files with groups of ``rows`` rows; part 0 holds the marker rows alone.

    Parts are ranges of the order, one for each shuffle partition, so no task sees more than its range.
    """
    marks = index.extremes(df, c)
    body = strings_last(index.sort_points(df, c, markers=False)).join(F.broadcast(marks.select(F.col("row_id").alias(c.row_id))), c.row_id, "left_anti")  # four rows at most
    keys = [k for k in index.sort_keys(df, c)]
    body = body.repartitionByRange(*keys).sortWithinPartitions(*keys)
    head = index.sort_points(df.join(F.broadcast(marks.select(F.col("row_id").alias(c.row_id))), c.row_id, "left_semi"), c)
    first = _arrow_files(head.select(body.columns).coalesce(1), folder, lambda _: "part.0.parquet", rows, metadata=metadata)
    return first + _arrow_files(body, folder, lambda part: f"part.{part + 1}.parquet", rows, metadata=metadata)


#: Fixed values of the multiscale format: the footer's key, the format's name, and the columns that it is sorted by.
MULTISCALE_KEY = "spatialdata_multiscale"
MULTISCALE_FORMAT = "spatialdata_multiscale_points"
MULTISCALE_ORDER = ("gene", "__spatial_index__", "__morton__")


def multiscale_document(df: DataFrame, axes: Sequence[str] = ("x", "y", "z"), space: str = "raw", levels: Sequence[dict] = (), limit: int | None = None) -> dict:
    """The format's metadata: the axes that there are, their box, and the number of points."""
    there = [a for a in axes if a in df.columns]
    if not there:
        raise ValueError("none of the axes is a column")
    r = df.agg(F.count("*"), *[f(a) for f in (F.min, F.max) for a in there]).first()
    box = [float("nan") if v is None else float(v) for v in r[1:]]
    return {
        "version": "1.0", "format": MULTISCALE_FORMAT, "axes": there, "bounding_box": {"min": box[: len(there)], "max": box[len(there) :]},
        "coordinate_space": space, "limit": limit, "levels": list(levels), "n_points_total": r[0],
    }


def write_multiscale(df: DataFrame, folder: str, *, rows: int = ROW_GROUP, document: dict | None = None) -> int:
    """Points in the multiscale order (by gene if there is one, level, Morton code), the metadata in each footer."""
    document = multiscale_document(df) if document is None else document
    keys = [k for k in MULTISCALE_ORDER if k in df.columns]
    if set(MULTISCALE_ORDER[1:]) <= set(df.columns):
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return _arrow_files(df, folder, lambda part: f"part.{part}.parquet", rows, metadata={MULTISCALE_KEY: json.dumps(document)})


def morton_from_store(store, key: str | None = None, *, folder: str | None = None, rows: int = ROW_GROUP) -> dict:
    """A store's point element sorted by Morton code, as part files beside the store or in ``folder``.

    Without a key the store must have one point element alone.
    """
    keys = list(store.elements.get("points", {}))
    if not keys:
        raise ValueError("the store has no point elements")
    if key is None and len(keys) > 1:
        raise ValueError(f"one of the point elements must be named: {', '.join(keys)}")
    key = key or keys[0]
    if key not in keys:
        raise KeyError(f"no point element {key!r}; there are {', '.join(keys)}")
    df, c = store.points(key)
    folder = folder or f"{store.root}/points_experimental/{key}/points.parquet"
    # the place of a row in all files is its id
    df = associations.numbered(df.withColumn("_place", F.struct("_file", "row_id")), "_place", "row_number").drop("_place", "_file", "row_id").withColumnRenamed("row_number", "row_id")
    return {"points": key, "folder": folder, "rows": write_grouped(df, c, folder, rows), "columns": c}


def write_csc(df: DataFrame, row: str, col: str, value: str, folder: str) -> None:
    """A sparse matrix by column: entries in ``entries``, sorted, and the columns' pointers in ``indptr``."""
    entries, pointer = raster.csc(df, row, col, value)
    entries.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/entries")
    pointer.write.mode("overwrite").parquet(f"{folder}/indptr")


def write_pyramid(df: DataFrame, by: Sequence[str], shape: Sequence[int], folder: str, *, levels: int | None = None, least: int = 256, how: str = "mean") -> list[int]:
    """Levels of a table of pixels, each written and the next made from the file; returns the factors."""
    factors = raster.scale_factors(shape, levels, least=least)
    spark = df.sparkSession
    for i in range(len(factors) + 1):
        df.write.mode("overwrite").parquet(f"{folder}/{i}")
        if i < len(factors):
            df = raster.downsample(spark.read.parquet(f"{folder}/{i}"), by, factors[i], how)
    return factors


def multiscale_metadata(df: DataFrame, c: PointColumns) -> str:
    """Axes, box and number of points as JSON."""
    r = df.agg(F.min(c.x), F.min(c.y), F.max(c.x), F.max(c.y), F.count("*")).first()
    return json.dumps({"axes": [a for a in (c.x, c.y, c.z) if a], "bounding_box": {"min": [r[0], r[1]], "max": [r[2], r[3]]}, "n_points": r[4]})


def write_layouts(df: DataFrame, c: PointColumns, folder: str) -> dict:
    """The four layouts and a manifest with the box between the quartiles."""
    for name in index.LAYOUTS:
        write_points(df, c, f"{folder}/{name}", layout=name, markers=False)
    q = df.agg(F.percentile(c.x, F.array(F.lit(0.25), F.lit(0.75))).alias("x"), F.percentile(c.y, F.array(F.lit(0.25), F.lit(0.75))).alias("y"), F.count("*").alias("n")).first()
    return {"layouts": list(index.LAYOUTS), "rows": q["n"], "scenario": {"min_x": q["x"][0], "max_x": q["x"][1], "min_y": q["y"][0], "max_y": q["y"][1]}}


def consolidate(nodes: dict[str, dict]) -> dict:
    """Consolidated metadata of a hierarchy; groups that only children imply are added, orphans refused."""
    entries = {p: {**n["meta"], "attributes": n["attrs"]} for p, n in nodes.items() if p}
    for p in list(entries):
        while "/" in p:
            p = p.rpartition("/")[0]
            entries.setdefault(p, {"zarr_format": 3, "node_type": "group", "attributes": {}})
    if lost := [p for p in entries if "/" in p and p.rpartition("/")[0] not in entries]:
        raise ValueError(f"entries without a parent: {lost}")
    return {"kind": "inline", "must_understand": False, "metadata": dict(sorted(entries.items()))}


def register(metadata: dict, kind: str, key: str, attrs: dict) -> dict:
    return {**metadata, "metadata": {**metadata["metadata"], f"{kind}/{key}": {"zarr_format": 3, "node_type": "group", "attributes": attrs}}}
