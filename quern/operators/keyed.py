"""Keyed aggregation in the MapReduce and pair-collection tradition, as DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.columns import col, unused
from quern.staging import stage

Merge = Callable[[Column], Column]


def reduce_by_key(df: DataFrame, keys: Sequence[str], value: str, merge: Merge = F.sum) -> DataFrame:
    """``merge`` (an associative, commutative aggregate) over the values of each key; combined before the shuffle."""
    return df.groupBy(*keys).agg(merge(F.col(value)).alias(value))


def group_by_key(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All values of each key as a sorted list. Not for skewed keys: a list is one value in one task."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("values"))


def group_and_map(df: DataFrame, keys: Sequence[str], results: dict[str, Column]) -> DataFrame:
    """Group by key, then map each group's values to results. Given as aggregates, no group is ever held as a list."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in results.items()])


def combine_by_key(df: DataFrame, keys: Sequence[str], create: dict[str, Column], merge: dict[str, Merge], finish: dict[str, Column] | None = None) -> DataFrame:
    """The combine triple: ``create`` turns a row into named accumulators, ``merge`` combines each of them
    (inside the partition, then across), ``finish`` makes the results. Accumulators need not be of the value's type."""
    state = df.select(*keys, *[c.alias(f"__{n}") for n, c in create.items()]).groupBy(*keys).agg(*[merge[n](F.col(f"__{n}")).alias(n) for n in create])
    return state.select(*keys, *[c.alias(n) for n, c in finish.items()]) if finish else state


def fold_partitions(df: DataFrame, fold: Callable[[Iterable[pd.DataFrame]], pd.DataFrame], schema: str) -> DataFrame:
    """One small frame per partition, made batch by batch: the many-to-one partition map. Merge it with an aggregate."""
    return df.mapInPandas(lambda batches: iter([fold(batches)]), schema)


def two_stage(df: DataFrame, keys: Sequence[str], salt_on: Sequence[str], partial: dict[str, Column], final: dict[str, Column], salts: int = 16) -> DataFrame:
    """Aggregate per (key, salt) first, then per key: for aggregates that cannot combine before the shuffle."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
    first = salted.groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()])


def best_per_key(df: DataFrame, key: str, item: str, score: str) -> DataFrame:
    """``(key, item, score)`` of the highest positive score; equal scores: the smallest item."""
    best = df.where(F.col(score) > 0).groupBy(key).agg(F.min_by(F.struct(item, score), F.struct((-F.col(score)).alias("s"), F.col(item).alias("i"))).alias("b"))
    return best.select(key, F.col(f"b.{item}").alias(item), F.col(f"b.{score}").alias(score))


def sessions(df: DataFrame, user: str, at: str, tie: str, gap_minutes: int = 30, stretch: str = "DAY") -> DataFrame:
    """Add ``session``: 1, 2 ... per user; a session begins at the first event and after a gap of more than ``gap_minutes``.

    A user's events are numbered in stretches of time (a unit of ``date_trunc``) on their own; how many sessions begin in each
    stretch, and whether its first event opens one, comes from the stretches' first and last times, of which there is one
    row per user and stretch. So no task gets all events of a hot user. Null times come first, as one stretch.
    """
    when, part, new, n, first, last, before, open_, of, own = (unused(df, x) for x in ("__when", "__part", "__new", "__n", "__first", "__last", "__before", "__open", "__of", "__own"))
    gap_of = lambda a, b: a.isNull() | b.isNull() | (a - b > gap_minutes * 60_000_000)
    cut = df.withColumn(when, F.unix_micros(col(at).cast("timestamp"))).withColumn(part, F.unix_micros(F.date_trunc(stretch, col(at).cast("timestamp"))))
    order = Window.partitionBy(user, part).orderBy(col(at), col(tie))
    inner = F.row_number().over(order) > 1
    begun = cut.withColumn(new, (inner & gap_of(F.col(when), F.lag(when).over(order))).cast("int")).withColumn(new, F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = begun.groupBy(user, part).agg(F.max(new).alias(n), F.min(when).alias(first), F.max(when).alias(last))
    along = Window.partitionBy(user).orderBy(part)
    opens = ends.withColumn(open_, gap_of(F.col(first), F.lag(last).over(along)).cast("int"))
    upto = F.sum(F.col(n) + F.col(open_)).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col(n)
    starts = opens.select(col(user).alias(own), F.col(part).alias(of), upto.alias(before))
    same = col(user).eqNullSafe(F.col(own)) & F.col(part).eqNullSafe(F.col(of))
    return begun.join(starts, same).select(*[col(c) for c in df.columns], (F.col(new) + F.col(before)).alias(unused(df, "session")))


def exact_medians(df: DataFrame, key: str, value: str, name: str = "median") -> DataFrame:
    """``(key, median)``: of an even number of values the mean of the two middle ones. Null values are left out.

    Values are counted first, which combines equal ones, and range-sorted by key and value; prefix counts of the ranges tell
    which of them holds a key's middle, so that a hot key is spread over as many tasks as it has ranges."""
    of, v, n, part, begin, total, upto = (unused(df, x) for x in ("__of", "__v", "__n", "__part", "__begin", "__total", "__upto"))
    counted = df.where(col(value).isNotNull()).groupBy(col(key).alias(of), col(value).alias(v)).agg(F.count(F.lit(1)).alias(n))
    ranged = stage(counted.repartitionByRange(of, v).withColumn(part, F.spark_partition_id()), "ranged").frame
    here = ranged.groupBy(of, part).agg(F.sum(n).alias(begin))
    before = F.coalesce(F.sum(begin).over(Window.partitionBy(of).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = here.select(F.col(of).alias(key), F.col(part).alias("part"), before.alias("before"), F.sum(begin).over(Window.partitionBy(of)).alias(total), (before + F.col(begin)).alias(upto))
    # only ranges with a middle value are read again
    lower, higher = F.floor((F.col(total) + 1) / 2), F.floor(F.col(total) / 2) + 1
    middle = ends.where((F.col("before") < higher) & (F.col(upto) >= lower)).drop(upto)
    inside = ranged.join(middle, F.col(of).eqNullSafe(col(key)) & (F.col(part) == F.col("part")))
    running = inside.withColumn(upto, F.col("before") + F.sum(n).over(Window.partitionBy(of, part).orderBy(v).rowsBetween(Window.unboundedPreceding, 0)))
    holds = lambda rank: F.max(F.when((F.col(upto) - F.col(n) < rank) & (F.col(upto) >= rank), F.col(v)))
    return running.groupBy(col(key)).agg(((holds(lower) + holds(higher)) / 2).alias(name))


def call_minutes(df: DataFrame, caller: str, start: str, end: str, flag: Column, least: int = 60) -> DataFrame:
    """``(caller, minutes)``: whole minutes of the flagged calls, cut off call by call, of callers with ``least`` or more in
    total. The filter on the total comes after all of it is summed. A call whose times are null counts 0."""
    micros = F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
    minutes = F.coalesce(F.floor(micros / 60_000_000), F.lit(0))
    return df.where(flag).groupBy(caller).agg(F.sum(minutes).alias("minutes")).where(F.col("minutes") >= least)


def common_friends(friends: DataFrame, person: str = "person", friend: str = "friend") -> DataFrame:
    """``(a, b, common)``: for each two people who are friends (``a < b``), the sorted list of their common friends.

    Of two friends the one with the fewer friends names them, and each is looked up with the other: a person of very many
    friends is never listed, and no list is longer than the shorter of two. A person without a list of their own has no pair.
    """
    known = friends.select(F.col(person).alias("p"), F.col(friend).alias("f")).where("p IS NOT NULL AND f IS NOT NULL").distinct()
    counts = known.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    pairs = known.select(F.least("p", "f").alias("a"), F.greatest("p", "f").alias("b")).where("a <> b").distinct()
    pairs = pairs.join(counts.select(F.col("p").alias("a"), F.col("n").alias("na")), "a").join(counts.select(F.col("p").alias("b"), F.col("n").alias("nb")), "b")
    few = F.struct("na", "a") <= F.struct("nb", "b")
    asked = pairs.select("a", "b", F.when(few, F.col("a")).otherwise(F.col("b")).alias("few"), F.when(few, F.col("b")).otherwise(F.col("a")).alias("many"))
    named = asked.join(known, F.col("few") == F.col("p")).select("a", "b", "many", F.col("f").alias("third"))
    shared = named.join(known, (F.col("many") == F.col("p")) & (F.col("third") == F.col("f"))).groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(F.sort_array(F.collect_list("third")).alias("common"))
    none = F.array().cast(shared.schema["common"].dataType)
    return pairs.select("a", "b").join(shared, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left").select("a", "b", F.coalesce("common", none).alias("common"))
