"""Parquet data sets: one file, or a folder of part files in numeric order, on any file system that Spark reads.

Footers are read without data: on the executors where files are local to all of them, else by the
driver through the file system client, only the tail of each file, many at a time.
"""

from __future__ import annotations

import io
import json
import re
import struct
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.model import TilingMeta, resolve_cap
from lattica.operators import index

PART = r"part[.-](\d+)"
FOOTER = "part int, row_group int, rows bigint, column string, min string, max string"
READERS = 16


def read(spark: SparkSession, path: str, columns: Sequence[str] | None = None, index_column_too: bool = False) -> DataFrame:
    """The table with its rows' place: part number and row index in the file; columns are pruned.

    With ``index_column_too`` the data frame's index column that the footer names is added to a projection.
    """
    df = spark.read.parquet(path)
    columns = list(columns or df.columns)
    if index_column_too and (name := index_column(path, spark)) and name not in columns:
        columns.append(name)
    part = F.coalesce(F.try_element_at(F.regexp_extract_all(F.col("_metadata.file_name"), F.lit(PART), F.lit(1)), F.lit(1)).cast("int"), F.lit(0))
    return df.select(*columns, part.alias("part"), F.col("_metadata.row_index").alias("row_index"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Input of the writers: Parquet, or CSV with a header and inferred types, by the name's end."""
    if path.lower().rstrip("/").endswith((".csv", ".csv.gz", ".tsv")):
        return spark.read.csv(path, header=True, inferSchema=True, sep="\t" if path.lower().endswith(".tsv") else ",")
    return spark.read.parquet(path)


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _number(path: str) -> int:
    return int(m[1]) if (m := re.search(PART, path.rsplit("/", 1)[-1])) else 0


def parts(path: str, spark: SparkSession | None = None) -> list[str]:
    """Files of a data set in part order."""
    spark = spark or SparkSession.active()
    fs, at = _place(spark, path)
    if fs.getFileStatus(at).isFile():
        return [path]
    names = [f.getPath().toString() for f in fs.listStatus(at) if f.isFile() and f.getPath().getName().endswith(".parquet")]
    return sorted(names, key=lambda n: (_number(n), n))


def checked_parts(path: str, spark: SparkSession | None = None) -> list[str]:
    """``parts``, of which none may be missing: numbers go from the first on without a gap."""
    files = parts(path, spark)
    numbers = [_number(f) for f in files]
    if len(files) > 1 and numbers != list(range(numbers[0], numbers[0] + len(files))):
        raise FileNotFoundError(f"parts are missing: there are {numbers}")
    return files


def concat(spark: SparkSession, path: str) -> DataFrame:
    """All parts in part order; a missing part is an error."""
    files = checked_parts(path, spark)
    return read(spark, path) if len(files) < 2 else read(spark, path).where(F.col("part").between(_number(files[0]), _number(files[-1])))


def footer(spark: SparkSession, path: str) -> pq.FileMetaData:
    """A file's footer, by reading its tail alone."""
    fs, at = _place(spark, path)
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:

        def tail(n: int) -> bytes:
            stream.seek(size - n)
            return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

        (length,) = struct.unpack("<I", tail(8)[:4])
        return pq.read_metadata(io.BytesIO(b"PAR1" + tail(length + 8)))
    finally:
        stream.close()


def _local(path: str) -> str | None:
    """The path for executors that share a disk with the driver (a local master), else None."""
    if not re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return path
    return re.sub(r"^file:/*", "/", path) if path.startswith("file:") else None


def _footer_rows(part: int, meta: pq.FileMetaData) -> list[tuple]:
    rows = []
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        for c in range(group.num_columns):
            col = group.column(c)
            s = col.statistics if col.is_stats_set else None
            has = s is not None and s.has_min_max
            rows.append((part, g, group.num_rows, col.path_in_schema, str(s.min) if has else None, str(s.max) if has else None))
    return rows


def row_groups(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Footer statistics as a relation; ``part`` is the file's place in ``files``."""
    local = [_local(f) for f in files]
    if not spark.sparkContext.master.startswith("local[") or None in local:
        with ThreadPoolExecutor(READERS) as pool:
            found = list(pool.map(lambda f: footer(spark, f), files))
        return spark.createDataFrame([r for i, m in enumerate(found) for r in _footer_rows(i, m)], FOOTER)

    def footers(batches):
        for batch in batches:
            for part, path in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if rows := _footer_rows(part, pq.read_metadata(path)):
                    p, g, n, c, lo, hi = zip(*rows, strict=True)
                    yield pa.record_batch([pa.array(p, pa.int32()), pa.array(g, pa.int32()), pa.array(n, pa.int64()), pa.array(c), pa.array(lo, pa.string()), pa.array(hi, pa.string())], names=["part", "row_group", "rows", "column", "min", "max"])

    listing = spark.createDataFrame(list(enumerate(local)), "part int, path string").repartition(max(1, len(files)))
    return listing.mapInArrow(footers, FOOTER)


def groups(footers: DataFrame) -> DataFrame:
    """group_id (over all parts, in order), part, row_group, rows: one row for each row group."""
    from pyspark.sql import Window as W

    one = footers.select("part", "row_group", "rows").distinct()
    return one.select((F.row_number().over(W.orderBy("part", "row_group")) - 1).cast("bigint").alias("group_id"), "part", "row_group", "rows")


def extents(footers: DataFrame, column: str, kind: str = "bigint") -> DataFrame:
    """group_id, rows, lo, hi of a column by the footers' statistics, as ``index.groups_for_codes`` and ``groups_for_spans`` take them."""
    mine = footers.where(F.col("column") == column).select("part", "row_group", F.col("min").try_cast(kind).alias("lo"), F.col("max").try_cast(kind).alias("hi"))
    return groups(footers).join(mine, ["part", "row_group"], "left").select("group_id", "rows", "lo", "hi")


def row_count(spark: SparkSession, path: str) -> int:
    """Rows by the footers, without reading data."""
    return groups(row_groups(spark, parts(path, spark))).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def read_row_group(spark: SparkSession, path: str, group: int, columns: Sequence[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The rows of one row group, counted over all parts; an index beyond the last is an error.

    The rows are a range of row indices of one file, so only that file is opened, and of it Spark
    reads the pages that hold the range.
    """
    files = parts(path, spark)
    r = groups(row_groups(spark, files)).where(F.col("group_id") == group).first()
    if r is None:
        raise IndexError(f"there is no row group {group}")
    before = groups(row_groups(spark, [files[r["part"]]])).where(F.col("row_group") < r["row_group"]).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    low, high = before + offset, before + (r["rows"] if limit is None else min(r["rows"], offset + limit))
    return read(spark, files[r["part"]], columns).where((F.col("row_index") >= low) & (F.col("row_index") < high))


def parts_until(spark: SparkSession, path: str, cap: float | None) -> tuple[list[str], int]:
    """(the parts to open, in order, until the cap of rows is reached; rows in front of the last of them)."""
    files = checked_parts(path, spark)
    rows = groups(row_groups(spark, files)).groupBy("part").agg(F.sum("rows").alias("rows"))
    wanted = sorted(index.until_cap(rows, "part", resolve_cap(cap)).collect(), key=lambda r: r["part"])  # one row for each part
    return [files[r["part"]] for r in wanted], wanted[-1]["rows_before"] if wanted else 0


def read_capped(spark: SparkSession, path: str, cap: float | None, columns: Sequence[str] | None = None) -> DataFrame:
    """The first rows of a data set in file order up to the cap; parts behind it aren't opened."""
    files, before = parts_until(spark, path, cap)
    if not files:
        return read(spark, path, columns).limit(0)
    whole, last = files[:-1], read(spark, files[-1], columns).where(F.col("row_index") < resolve_cap(cap) - before)
    return read_many(spark, whole, columns).unionByName(last) if whole else last


def read_many(spark: SparkSession, files: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*files)
    part = F.coalesce(F.try_element_at(F.regexp_extract_all(F.col("_metadata.file_name"), F.lit(PART), F.lit(1)), F.lit(1)).cast("int"), F.lit(0))
    return df.select(*(columns or df.columns), part.alias("part"), F.col("_metadata.row_index").alias("row_index"))


def bytes_until(spark: SparkSession, path: str, cap: float | None) -> Iterator[tuple[str, bytes]]:
    """(name, content) of the parts up to the cap of rows, one at a time; a missing part is an error."""
    for f in parts_until(spark, path, cap)[0]:
        r = spark.read.format("binaryFile").load(f).select("content").first()
        yield f, bytes(r["content"])


def tiling(footer: DataFrame, bounds=None) -> TilingMeta:
    """Totals of a footer relation."""
    groups = footer.select("part", "row_group", "rows").distinct()
    r = groups.agg(F.sum("rows").alias("rows"), F.count("*").alias("n"), F.max("rows").alias("most")).first()
    by_part = {x["part"]: x["rows"] for x in groups.groupBy("part").agg(F.sum("rows").alias("rows")).collect()}
    return TilingMeta(bounds, r["rows"] or 0, r["n"], r["most"] or 0, by_part)


def key_values(path: str, spark: SparkSession | None = None) -> dict[str, str]:
    """The text entries of the first part's footer."""
    spark = spark or SparkSession.active()
    files = parts(path, spark)
    meta = footer(spark, files[0]).metadata if files else None
    return {k.decode(): v.decode(errors="replace") for k, v in (meta or {}).items()}


def index_column(path: str, spark: SparkSession | None = None) -> str | None:
    """The pandas index column named in the footer; a range index has none."""
    meta = key_values(path, spark)
    if "pandas" not in meta:
        return None
    columns = json.loads(meta["pandas"]).get("index_columns", [])
    if len(columns) != 1:
        raise ValueError(f"one index column is expected, there are {len(columns)}")
    return columns[0] if isinstance(columns[0], str) else None


def geometry_meta(path: str, spark: SparkSession | None = None) -> dict | None:
    """Primary geometry column and types of a GeoParquet file."""
    meta = key_values(path, spark)
    if "geo" not in meta:
        return None
    geo = json.loads(meta["geo"])
    name = geo["primary_column"]
    return {"column": name, "types": geo["columns"][name].get("geometry_types", []), "encoding": geo["columns"][name].get("encoding")}


def rows_read(df: DataFrame) -> int:
    """Rows that the scans of a plan put out, by Spark's metrics; runs the plan."""
    execution = df._jdf.queryExecution()
    rdd = execution.toRdd()
    rdd.count()
    total, todo = 0, [execution.executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name in ("FileSourceScanExec", "BatchScanExec"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total
