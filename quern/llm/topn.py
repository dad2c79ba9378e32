"""The N best items of every group: score histograms, a safe threshold, then an exact rank.

One pass counts scores per group in buckets that never go down as scores go up. From the top bucket
downwards the counts are added until they reach N: no row below that bucket can be among the N best, so
such rows are dropped before anything is shuffled. The thresholds kept are those that drop the most rows, as
many as a bounded broadcast holds; all rows of the other groups survive. What is left is cut to N per group inside
each input partition and then ranked exactly with the tie key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.columns import col, unused
from quern.staging import stage

_TOP = 1 << 20
#: thresholds in the broadcast table: two words each, 4 MB with their row headers, however many groups there are
THRESHOLDS = 1 << 17
#: up to this N Spark cuts each group inside its input partition by itself
GROUP_LIMIT = 1000


def score_bucket(score: Column, per_e: int = 64) -> Column:
    """A whole number that is never lower for a higher score: ``per_e`` buckets for each factor e of the
    magnitude, mirrored for negative scores. NaN counts as the highest score, as in Spark's own order."""
    value = score.cast("double")
    size = F.least(F.floor(F.least(F.log1p(F.abs(value)), F.lit(1e4)) * per_e), F.lit(_TOP - 1))
    return F.when(F.isnan(value), F.lit(_TOP)).when(value < 0, -size).otherwise(size).cast("int")


def _thresholds(rows: DataFrame, group: Column, score: Column, n: int, most: int) -> DataFrame:
    """``(key, least)``: for at most ``most`` hashes of groups the bucket below which no row can be among the ``n`` best.

    The groups are those whose threshold drops the most rows; a threshold left out leaves no more rows than it would
    have dropped, and that is fewer than (all rows / ``most``). Groups of one hash share the lowest of their buckets."""
    # a clash of two hashes must not lose a row, so each group has its own histogram
    counted = rows.groupBy(group.alias("g"), score_bucket(score).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    downward = Window.partitionBy("g").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counted.withColumn("upto", F.sum("n").over(downward))
    # groups with fewer than n rows keep everything
    per_group = upto.groupBy("g").agg(F.coalesce(F.max(F.when(F.col("upto") >= n, F.col("b"))), F.lit(-_TOP - 1)).alias("least"), F.sum("n").alias("all"), F.min(F.when(F.col("upto") >= n, F.col("upto"))).alias("kept"))
    dropped = F.coalesce(F.col("all") - F.col("kept"), F.lit(0))
    safe = per_group.groupBy(F.xxhash64("g").alias("key")).agg(F.min("least").alias("least"), F.sum(dropped).alias("dropped"))
    safe = stage(safe.where("dropped > 0"), "thresholds").frame
    # the least gain that the table has room for, to a power of two: at most 64 rows reach the driver
    sizes = safe.groupBy(F.floor(F.log2("dropped")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()
    room, power = most, 0
    for r in sorted(sizes, reverse=True):
        room -= r["n"]
        if room < 0:
            power = r["power"] + 1
            break
    return safe.where(F.floor(F.log2("dropped")) >= power).select("key", "least")


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int = 5, thresholds: int = THRESHOLDS) -> DataFrame:
    """The ``n`` rows of highest non-null ``score`` of each non-null ``group``, with ``rank`` 1..n; all rows of
    smaller groups. Equal scores: smaller ``tie`` first (null last). Repeated rows count separately. Groups
    or scores that are null are left out; an empty table gives no rows; other columns pass through (one that is
    already named ``rank`` makes the new one ``rank_``).

    The histogram has one row per group and bucket, not per item. At most ``thresholds`` thresholds are broadcast, so
    no row is shuffled before the filter, however many groups there are; how many only decides how many rows it drops.
    A group of millions of equal scores shares one bucket: at most ``n`` rows of it leave an input partition.
    """
    names = [col(c) for c in df.columns]
    g, s = col(group), col(score)
    key, least, rank, salt = (unused(df, x) for x in ("__key", "__least", "rank", "__salt"))
    rows = df.where(g.isNotNull() & s.isNotNull())
    safe = _thresholds(rows, g, s, n, thresholds).toDF(key, least)
    passed = F.coalesce(score_bucket(s) >= F.col(least), F.lit(True))
    survivors = rows.join(F.broadcast(safe), F.xxhash64(g) == F.col(key), "left").where(passed).select(*names)
    order = (s.desc(), col(tie).asc_nulls_last())
    if n > GROUP_LIMIT:  # Spark has no partial limit of so many rows: the rank runs in hashed parts of each group first
        apart = survivors.withColumn(salt, F.pmod(F.xxhash64(*names), F.lit(64)))
        ranked = apart.withColumn(rank, F.row_number().over(Window.partitionBy(g, salt).orderBy(*order)))
        survivors = ranked.where(F.col(rank) <= n).select(*names)
    return survivors.withColumn(rank, F.row_number().over(Window.partitionBy(g).orderBy(*order))).where(F.col(rank) <= n)
