"""Mixing sources to target weights by hash-threshold histograms.

Every document gets 60 hash bits of its id and text, and of its number among rows that are equal
in id, text and source, so rows without an id or with one id are taken apart. A source that needs ``r`` times its size takes
each document ``floor(r)`` times, and once more those whose hash is at or under a threshold.
The threshold comes from histograms of words by source and hash bucket: the bucket in which
the running sum crosses the budget is refined alone, 12 bits at a time, until it holds few
documents. Nothing is sorted, and budgets are nested: a larger budget takes a superset.

Shuffled per round: one row for each source, bucket and task (partial sums), so a source with
a third of the rows is spread over its buckets. Only the last bucket of a source, at most
``leaf_rows`` documents or documents of one id, is ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.common import discard, equal_keys, hashed, keyed, small, word_count, written

BITS = 12
HASH_BITS = 60


def targets(sizes: DataFrame, weights=(3, 1, 2), share_num: int = 3, share_den: int = 2, cap: int = 2) -> DataFrame:
    """(source, source_size) -> + weight, target.

    Sources in code-point order, null last, get ``weights`` in turn and share
    ``share_num/share_den`` of all words; a target stops at ``cap`` times its source and the
    excess is shared again by weight. One row per source: in the order of cap by weight the
    stopped sources come first, so the level is that of the first source that isn't.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    t = sizes.withColumn("rank", rank).withColumn("weight", weight.cast("bigint"))
    by_ratio = W.orderBy(F.col("source_size").cast("double") / F.col("weight"), "rank")
    every = W.partitionBy()
    t = (
        t.withColumn("budget", F.sum("source_size").over(every).cast("double") * share_num / share_den)
        .withColumn("stopped", F.coalesce(F.sum(F.col("source_size") * cap).over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("left", F.col("budget") - F.col("stopped"))
        .withColumn("stops", F.col("source_size") * cap * F.col("open_weight") <= F.col("left") * F.col("weight"))
        .withColumn("place", F.row_number().over(by_ratio))
        .withColumn("first", F.min(F.when(~F.col("stops"), F.col("place"))).over(every))
        .withColumn("level", F.max(F.when(F.col("place") == F.col("first"), F.col("left") / F.col("open_weight"))).over(every))
    )
    stop = F.coalesce(F.col("place") < F.col("first"), F.lit(True))
    target = F.when(stop, (F.col("source_size") * cap).cast("double")).otherwise(F.col("level") * F.col("weight"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def cuts(sized: DataFrame, *, weights=(3, 1, 2), leaf_rows: int = 4096) -> DataFrame:
    """source, source_size, target, times, cut: whole copies, and the hash up to which one more is taken.

    ``sized``: a written table of source, size, h.
    """
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    times = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("bigint")
    plan = written(plan.withColumn("times", times).withColumn("need", F.col("target") - F.col("times") * F.col("source_size")), "mix-targets")

    # `within`: the rows of the bucket in which each source's running sum crosses its need
    within, before = sized, plan.select("source", "need", F.lit(0).cast("bigint").alias("base"))
    shift = HASH_BITS
    while shift > 0:
        shift -= BITS
        bucket = F.shiftright("h", shift)
        running = W.partitionBy("source").orderBy("bucket")
        hist = within.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        hist = _by_source(hist.withColumn("upto", F.sum("words").over(running)), before)
        upto = F.col("base") + F.col("upto")
        cross = hist.where((upto > F.col("need")) & (upto - F.col("words") <= F.col("need")))
        cross = written(cross.select("source", "need", "bucket", "n", (upto - F.col("words")).alias("base")), "mix-bucket")
        before = cross.select("source", "need", "base")
        edge = cross.select("source", "bucket")
        within = _by_source(sized, small(edge)).where(bucket == F.col("bucket")).select("source", "size", "h")
        if (cross.agg(F.max("n")).first()[0] or 0) <= leaf_rows:
            break

    by_hash = within.groupBy("source", "h").agg(F.sum("size").alias("words"))
    step = _by_source(by_hash.withColumn("upto", F.sum("words").over(W.partitionBy("source").orderBy("h"))), before)
    upto = F.col("base") + F.col("upto")
    nearer = upto - F.col("need") < F.col("need") - (upto - F.col("words"))
    level = step.where((upto <= F.col("need")) | nearer).groupBy("source").agg(F.max("h").alias("top"))
    # no document of the bucket fits: all hashes below the bucket do
    low = edge.select("source", (F.shiftleft("bucket", shift) - 1).alias("low"))
    cut = _by_source(_by_source(plan, low, "left"), level, "left")
    cut = cut.select("source", "source_size", "target", "times", F.when(F.col("need") > 0, F.coalesce("top", "low")).alias("cut"))
    return written(cut, "mix-cuts")


def _sized(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(written table of doc_id, source, size, h; keys of more than one row, if there are any)."""
    key, name = keyed(F.col, "source")
    rows = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), name.alias("name")), "mix-rows")
    several = equal_keys(rows)
    sized = written(hashed(rows, several).select("doc_id", "source", "size", "h"), "mix-sizes")
    discard(rows)
    return sized, several


_ONCE_MORE = "coalesce(cast(h <= cut as int), 0)"


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``.

    A null or empty text has size 0 and takes 0; a null source is a source of its own, last in
    order; repeated rows, rows of one id and rows without an id are taken one by one; an empty
    table gives no rows; other columns are not read. ``taken`` is a multiple of ``size``, at most
    twice it. The document at the threshold is taken if that comes nearer to the target, so a
    source misses its target by half its boundary document at most.
    """
    sized, _ = _sized(docs)
    return _by_source(sized, small(cuts(sized, **options))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("times") + F.expr(_ONCE_MORE))).alias("taken")
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (same columns).

    A document without words takes no words however often it stands; it stands once. The texts
    meet only the table of sources, so they aren't shuffled; those of rows that are equal in id,
    text and source are, once.
    """
    sized, several = _sized(docs)
    cut = small(cuts(sized, **options)).select("source", "times", "cut")
    row = F.struct("*").alias("row")
    key, name = keyed(lambda c: F.col("row")[c], "source")
    rows = docs.select(row).select("row", key.alias("key"), name.alias("name"), F.col("row")["source"].alias("source"), word_count(F.col("row")["text"]).alias("size"))
    rows = _by_source(hashed(rows, several), cut)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise((F.col("times") + F.expr(_ONCE_MORE)).cast("int"))
    return rows.where(times > 0).select("row", F.explode(F.array_repeat(F.lit(1), times))).select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':'
                             || (row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, '')), source) - 1)), 1, 15))::BIGINT AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk
  FROM sized GROUP BY source),
weighed AS (SELECT *, ([3, 1, 2])[(rnk % 3 + 1)::INT]::BIGINT AS weight FROM src),
lev AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 3 / 2
             - coalesce(sum(source_size * 2) OVER (ORDER BY source_size::DOUBLE / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ow,
         row_number() OVER (ORDER BY source_size::DOUBLE / weight, rnk) AS place
  FROM weighed),
fst AS (SELECT min(place) AS p FROM lev WHERE NOT (source_size * 2 * ow <= lft * weight)),
tgt AS (
  SELECT source, source_size,
         CASE WHEN p IS NULL OR place < p THEN (source_size * 2)::DOUBLE
              ELSE (SELECT l.lft / l.ow FROM lev l, fst f WHERE l.place = f.p) * weight END AS target
  FROM lev, fst),
pl AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS times FROM tgt),
runs AS (
  SELECT s.*, pl.source_size, pl.target, pl.times, pl.target - pl.times * pl.source_size AS need,
         sum(size) OVER (PARTITION BY s.source ORDER BY h) AS upto,
         sum(size) OVER (PARTITION BY s.source, h) AS own
  FROM sized s JOIN pl ON s.source IS NOT DISTINCT FROM pl.source)
SELECT doc_id, size, source_size, target,
       (size * (times + CASE WHEN need > 0 AND (upto <= need OR (upto - own <= need AND upto - need < need - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM runs
"""
