"""Session settings of the engine."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Engine-wide settings; a cluster's own settings of these keys win.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("lattica")
    if master:
        builder = builder.master(master)
    for k, v in {**CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a temporary folder, on a local master only."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.gettempdir() + "/lattica-shared"
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder: what depends on how they were dealt stays so."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Rows up to which a counted table is broadcast.
FEW = 1_000_000


def small(df: DataFrame, rows: int = FEW) -> DataFrame:
    """A catalogue or the like: written once, counted, and marked for broadcast if it has at most ``rows`` rows.

    Its static size follows what it was made from, so without the count a join to it would shuffle
    the other side however few rows it has.
    """
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= rows else df
