"""Join plans that Spark's own join methods do not name: size-checked, salted, reduce-side, cogroup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.staging import BROADCAST_BYTES, broadcast_if_small, stage


def small_side(big: DataFrame, small: DataFrame, on: Column | list[str] | str, how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """A map-side join if the optimizer's own size bound of ``small`` is within ``limit``, else whatever it picks."""
    size = int(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return big.join(F.broadcast(small) if size <= limit else small, on, how)


def salted_join(big: DataFrame, small: DataFrame, big_key: str, small_key: str, salts: int = 8) -> DataFrame:
    """Inner join whose hot keys spread over ``salts`` tasks: a bounded whole-number salt on the big side, every
    salt on the small side. Null keys match nothing; repeated rows match as often as in a plain join."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int")
    left = big.withColumn("__salt", salt)
    right = small.withColumn("__each", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, (left[big_key] == right[small_key]) & (F.col("__salt") == F.col("__each"))).drop("__salt", "__each")


def cogroup(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, lefts, rights)``: the sorted values of each key on either side, empty lists where a side has none."""
    tagged = left.select(F.col(key), F.col(value).alias("l"), F.lit(None).cast(right.schema[value].dataType).alias("r")).unionByName(
        right.select(F.col(key), F.lit(None).cast(left.schema[value].dataType).alias("l"), F.col(value).alias("r"))
    )
    return tagged.groupBy(key).agg(F.sort_array(F.collect_list("l")).alias("lefts"), F.sort_array(F.collect_list("r")).alias("rights"))


def reduce_side_join(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str, most: int = 10_000) -> DataFrame:
    """Inner join the MapReduce way: tag each side, put both together, group by key, pair the two lists.

    Keeps every pair of a repeated key; null keys match nothing. A key with more than ``most`` rows on a side is a grid: each
    side is cut into as many parts as it needs, each part of the left meets each of the right in a group of its own, so
    that no list has many more than ``most`` rows of a side, whichever side the key is hot on.
    """
    l_kind, r_kind = left.schema[left_value].dataType, right.schema[right_value].dataType
    rows = left.select(F.col(key).alias("k"), F.lit(0).alias("side"), F.col(left_value).alias("l"), F.lit(None).cast(r_kind).alias("r")).unionByName(
        right.select(F.col(key).alias("k"), F.lit(1).alias("side"), F.lit(None).cast(l_kind).alias("l"), F.col(right_value).alias("r"))
    ).where("k IS NOT NULL")
    n = lambda side: F.ceil(F.count_if(F.col("side") == side) / most).cast("int")
    # at most one key in ``most`` rows is hot
    hot = stage(rows.groupBy("k").agg(n(0).alias("nl"), n(1).alias("nr")).where("nl > 1 OR nr > 1").withColumnRenamed("k", "hot"), "grid").frame
    cut = rows.join(broadcast_if_small(hot), F.col("k") == F.col("hot"), "left").withColumns({x: F.coalesce(x, F.lit(1)) for x in ("nl", "nr")})
    own = F.pmod(F.xxhash64("l", "r", F.monotonically_increasing_id()), F.when(F.col("side") == 0, F.col("nl")).otherwise(F.col("nr"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("nr")).otherwise(F.col("nl")) - 1)
    cells = cut.withColumn("own", own).withColumn("other", F.explode(others))
    at = {"i": F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")), "j": F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))}
    lists = cells.groupBy("k", *[c.alias(x) for x, c in at.items()]).agg(F.collect_list(F.struct("side", "l", "r")).alias("ts"))
    sides = lists.select("k", F.filter("ts", lambda t: t["side"] == 0).alias("ls"), F.filter("ts", lambda t: t["side"] == 1).alias("rs")).where(F.size("rs") > 0)
    return sides.select("k", F.explode("ls").alias("a"), "rs").select("k", "a", F.explode("rs").alias("b")).select(F.col("k").alias(key), F.col("a.l").alias(left_value), F.col("b.r").alias(right_value))
