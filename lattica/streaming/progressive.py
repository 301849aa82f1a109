"""Progressive scans of finite data as Structured Streaming queries.

A file source is read to its end in triggers of a few files; each trigger's results are added
to tables in the shared folder, keyed by batch id, so that a batch that is run again replaces
itself. Codes of the progressive catalogue never change once given.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1, glob: str | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(path)


def run(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, stall_seconds: float = 15.0) -> None:
    """Process all that is there now; a query that makes no progress for a while is stopped."""
    q = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    seen, since = None, time.monotonic()
    while not q.awaitTermination(1):
        mark = (q.lastProgress or {}).get("batchId"), q.status["isTriggerActive"]
        if mark != seen or q.status["isDataAvailable"]:
            seen, since = mark, time.monotonic()
        elif time.monotonic() - since > stall_seconds:
            q.stop()
            raise TimeoutError("the scan made no progress")
    if q.exception():
        raise q.exception()


def counts(spark: SparkSession, df: DataFrame, key: str, folder: str) -> DataFrame:
    """Counts by key over a progressive scan: sums of the batches' counts."""

    def each(batch: DataFrame, n: int) -> None:
        batch.groupBy(key).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/counts/batch={n}")

    run(df, each, f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/counts").groupBy(key).agg(F.sum("n").alias("n"))


def matching(spark: SparkSession, df: DataFrame, keep: Column, folder: str, on_progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """Rows that match, appended batch by batch."""
    total = 0

    def each(batch: DataFrame, n: int) -> None:
        nonlocal total
        batch.where(keep).write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")
        if on_progress:
            total += batch.sparkSession.read.parquet(f"{folder}/rows/batch={n}").count()
            on_progress(n, total)

    run(df, each, f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/rows").drop("batch")


def catalog(spark: SparkSession, df: DataFrame, name: str, folder: str, on_catalog: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """code, name: codes in order of the batch in which a name first came, then name.

    A batch's new names are those that the table of names lacks; their codes go on from the greatest
    before, so a code once given stays.
    """
    from pyspark.sql import Window as W

    schema, state = "code bigint, name string", f"{folder}/names"

    def each(batch: DataFrame, n: int) -> None:
        s = batch.sparkSession
        # one folder holds all names; a batch that is run again leaves out what it wrote itself
        held = s.read.schema(f"{schema}, batch bigint").parquet(state).where(F.col("batch") < n) if n else s.createDataFrame([], f"{schema}, batch bigint")
        new = batch.select(F.coalesce(F.col(name), F.lit("")).alias("name")).distinct().join(held.select("name"), "name", "left_anti")
        base = held.agg(F.coalesce(F.max("code") + 1, F.lit(0))).first()[0]
        new = new.select((F.row_number().over(W.orderBy("name")) - 1 + base).cast("bigint").alias("code"), "name")
        new.write.mode("overwrite").parquet(f"{state}/batch={n}")
        if on_catalog and s.read.schema(schema).parquet(f"{state}/batch={n}").take(1):
            on_catalog(s.read.schema(schema).parquet(state))

    run(df, each, f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/names").select("code", "name")


def two_phase_catalog(preview: Callable[[], DataFrame], full: Callable[[], DataFrame], shown: Callable[[DataFrame, str], None]) -> DataFrame:
    """A catalogue in two steps: the preview is shown at once, then the full one; a failed preview is left out.

    Rows that were coded by the preview are upgraded by ``catalog.upgraded``.
    """
    try:
        shown(preview(), "preview")
    except Exception:  # the preview is a convenience; the full catalogue decides
        pass
    found = full()
    shown(found, "full")
    return found
