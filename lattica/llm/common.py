"""What the training-data operators share: scratch tables and reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor can read.

    Taken from ``spark.checkpoint.dir``. Where that is unset (tests on a local master) a
    temporary folder is made once and set as the checkpoint folder; on a cluster an unset
    folder is an error, as a machine-local one would lose data.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    own = getattr(shared_folder, "own", None)
    if own is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = shared_folder.own = tempfile.mkdtemp(prefix="lattica-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _path(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a folder in any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    This cuts the lineage by a table that survives a lost executor, and keeps wide or
    costly inputs from being computed twice. The table goes when the application ends, or by
    ``discard`` before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = (out, path)
    return out


_tables: dict[int, tuple[DataFrame, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Remove written tables that no plan reads any more."""
    for t in tables:
        _, path = _tables.pop(id(t), (None, None))
        if path:
            fs, p = _path(t.sparkSession, path)
            fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_hash(column) -> object:
    """60 uniform bits of a key: the first 15 hex digits of its MD5, so SQL can say the same."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def word_count(text) -> object:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def by_hash(df: DataFrame, h: str, n: int, total: int) -> DataFrame:
    """The n rows of least hash, of ``total``: only rows under a threshold that keeps twice as many are ordered.

    Without the threshold each task would send the driver n rows of its own.
    """
    share = min(1.0, 2.0 * n / max(1, total))
    return df.where(F.col(h) <= int(share * ((1 << 60) - 1))).orderBy(*dict.fromkeys([h, *df.columns])).limit(n)


def tie_of(text) -> object:
    """A bigint by which rows of one id are ordered: by their text's hash, equal texts by where they lie.

    So a group of equal rows can be cut anywhere by ranges of it."""
    place = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 24) - 1))
    return F.shiftleft(F.shiftright(F.xxhash64(text), 24), 24).bitwiseOR(place)


def keyed(column, *more: str) -> tuple:
    """(key of rows that are equal in id, text and ``more``; what ``hashed`` makes the hash of).

    ``column`` gives a column by name."""
    name = F.concat(F.coalesce(column("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(column("text"), F.lit("")).cast("binary")))
    return F.xxhash64(column("doc_id"), name, *map(column, more)), name


def equal_keys(rows: DataFrame, where: object = None) -> DataFrame | None:
    """The keys that more than one of ``rows`` (a written table) has, if there are any; of those where ``where`` (an aggregate) holds."""
    found = rows.groupBy("key").agg(F.count("*").alias("n"), (F.lit(True) if where is None else where).alias("holds"))
    equal = written(found.where("n > 1 and holds").select("key"), "equal-keys")
    return small(equal) if equal.count() else None


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with a column rank: their number from 0 among rows of one ``key``.

    Rows are numbered where they lie, then the parts of a key; no key is brought into one task.
    """
    rows = written(rows.withColumn("part", F.spark_partition_id()), "equal-rows")
    parts = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    starts = parts.select("key", "part", (F.sum("n").over(W.partitionBy("key").orderBy("part")) - F.col("n")).alias("start"))
    inside = F.row_number().over(W.partitionBy("key", "part").orderBy("key")) - 1
    return rows.withColumn("place", inside).join(starts, ["key", "part"]).withColumn("rank", F.col("start") + F.col("place")).drop("start", "place", "part")


def hashed(rows: DataFrame, equal: DataFrame | None) -> DataFrame:
    """``rows`` (key, name and more) with h: 60 bits for each row, also for equal ones (``equal_keys``)."""
    if equal is None:
        return rows.withColumn("h", doc_hash(F.concat("name", F.lit(":0"))))
    several = _ranked(rows.join(equal, "key", "left_semi"))
    rows = rows.join(equal, "key", "left_anti").withColumn("rank", F.lit(0).cast("bigint")).unionByName(several)
    return rows.withColumn("h", doc_hash(F.concat("name", F.lit(":"), F.col("rank").cast("string")))).drop("rank")


FEW = 1_000_000


def small(df: DataFrame, rows: int = FEW) -> DataFrame:
    """``df``, which must be cheap to count, marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(text) -> object:
    """64 bits of a text; a null one is told from an empty one."""
    return F.xxhash64(text)


def without(docs: DataFrame, gone: DataFrame, keep: bool = False) -> DataFrame:
    """The rows of ``docs`` whose id and text aren't in ``gone`` (a written table: doc_id, tie), or are (``keep``).

    ``tie`` is ``text_key`` of the text, so rows that share an id or have none stand by themselves.
    Few keys are broadcast, so that the texts aren't shuffled; more than that are joined by key.
    """
    id_name, tie_name = free_name(docs, "gone_id"), free_name(docs, "gone_tie")
    gone = gone.select(F.col("doc_id").alias(id_name), F.col("tie").alias(tie_name)).distinct()
    same = docs["doc_id"].eqNullSafe(F.col(id_name)) & (text_key(docs["text"]) == F.col(tie_name))
    return docs.join(small(gone), same, "left_semi" if keep else "left_anti")
