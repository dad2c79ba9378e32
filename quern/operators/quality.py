"""Column-level data quality profile, per load, exact.

The named columns are unpivoted to (column, load, value) and counted, which combines equal values inside
each input partition. The counted values are range-sorted by column and value; each range partition gets
the prefix count of everything before it, so that it alone can tell which ranks, and so which quantiles,
fall into it, and can evaluate the cumulative curve of every load against that of the other loads. The
partitions' answers are merged: distinct counts add up, Kolmogorov-Smirnov distances take the maximum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.staging import stage

#: fixed value: the form of a sound city name, matched against the whole value
CITY_FORM = r"\A\p{Lu}\p{L}*([ '-]\p{L}+)*\z"
#: of a sound name of a person, country or continent
NAME_FORM = CITY_FORM


@dataclass(frozen=True)
class Check:
    """A column to profile: ``kind`` is ``whole`` (any integer type), ``frac`` (double), ``text`` or ``time`` (timestamp
    with or without zone, profiled as whole microseconds since 1970). ``valid`` tells sound from unsound non-null values; ``blank_is_null`` counts blank text as null."""

    column: str
    kind: str
    valid: Callable[[Column], Column] | None = None
    blank_is_null: bool = False


_KINDS = {"whole": "bigint", "frac": "double", "text": "string"}
_VALUE = ["whole", "frac", "txt"]
_WHERE = ["table_name", "column_name"]


def _micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970; of a timestamp without zone as it is written, whatever the session's zone."""
    if df.schema[column].dataType == T.TimestampType():
        return F.unix_micros(F.col(f"`{column}`"))
    since = F.col(f"`{column}`").cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
    return (since.cast("decimal(20,6)") * 1_000_000).cast("bigint")


def counted_values(df: DataFrame, table: str, load: str, checks: Sequence[Check]) -> DataFrame:
    """``(table_name, column_name, load_no, whole, frac, txt, n, bad)``: how often each value occurs in each load."""
    cells = []
    for c in checks:
        kind = "whole" if c.kind == "time" else c.kind
        value = _micros(df, c.column) if c.kind == "time" else F.col(f"`{c.column}`").cast(_KINDS[kind])
        if c.blank_is_null:
            value = F.when(F.length(F.trim(value)) > 0, value)
        if kind == "frac":
            value = F.when(~F.isnan(value), value)  # NaN is no value: it counts as null
        bad = F.coalesce(~c.valid(value), F.lit(False)) if c.valid else F.lit(False)
        own = {k: (value if k == kind else F.lit(None)).cast(t) for k, t in _KINDS.items()}
        cells.append(F.struct(F.lit(c.column).alias("column_name"), own["whole"].alias("whole"), own["frac"].alias("frac"), own["text"].alias("txt"), bad.alias("bad")))
    long = df.select(F.col(f"`{load}`").cast("long").alias("load_no"), F.explode(F.array(*cells)).alias("c"))
    return long.groupBy(F.lit(table).alias("table_name"), "c.column_name", "load_no", "c.whole", "c.frac", "c.txt").agg(
        F.count(F.lit(1)).alias("n"), F.max("c.bad").alias("bad")
    )


_CURVE = "table_name string, column_name string, load_no bigint, what string, whole bigint, frac double, x double"


def _curves(rows: pd.DataFrame, loads: pd.DataFrame) -> pd.DataFrame:
    """One range partition of one column. ``loads`` has, for every load of the column, the count ``before``
    this partition, ``here`` in it and in ``total``."""
    if rows.empty or loads.empty:
        return pd.DataFrame(columns=["table_name", "column_name", "load_no", "what", "whole", "frac", "x"])
    table, column = rows["table_name"].iloc[0], rows["column_name"].iloc[0]
    text = rows["txt"].notna().any()
    values = rows["txt"] if text else rows["frac"] if rows["frac"].notna().any() else rows["whole"]
    codes, distinct = pd.factorize(values, sort=True)
    n = rows["n"].to_numpy(np.int64)
    load = rows["load_no"].fillna(np.iinfo(np.int64).min).to_numpy(np.int64)
    all_at = np.bincount(codes, weights=n, minlength=len(distinct)).astype(np.int64)
    all_upto = loads["before"].sum() + np.cumsum(all_at)
    everyone = int(loads["total"].sum())
    order = np.lexsort((codes, load))
    starts = np.flatnonzero(np.r_[True, np.diff(load[order]) != 0])
    own_rows = {load[order[a]]: order[a:b] for a, b in zip(starts, np.r_[starts[1:], len(order)])}
    numeric = not text
    is_frac = numeric and rows["frac"].notna().any()
    out = []

    def say(no, what, value=None, x=None):
        out.append((table, column, no, what, None if value is None or is_frac else int(value), float(value) if value is not None and is_frac else None, x))

    for no, before, total in loads[["load_no", "before", "total"]].itertuples(index=False):
        no = None if pd.isna(no) else int(no)
        mine = own_rows.get(np.iinfo(np.int64).min if no is None else no, np.empty(0, np.int64))
        at = codes[mine]
        upto = before + np.cumsum(n[mine])
        rest_total = everyone - total
        if len(mine) and rest_total and total:
            here, there = upto / total, (all_upto[at] - upto) / rest_total
            here0, there0 = (upto - n[mine]) / total, (all_upto[at] - all_at[at] - (upto - n[mine])) / rest_total
            say(no, "ks", x=float(max(np.abs(here - there).max(), np.abs(here0 - there0).max())))
        if not numeric:
            continue
        for what, rank in (("own_lo", (total + 1) // 2), ("own_hi", total // 2 + 1)):
            i = int(np.searchsorted(upto, rank))
            if total and i < len(upto) and rank > before:
                say(no, what, distinct[at[i]])
        if rest_total:
            spread = np.zeros(len(distinct), np.int64)
            spread[at] = n[mine]
            rest = all_upto - before - np.cumsum(spread)
            before_rest = all_upto[0] - all_at[0] - before
            for what, rank in (("rest_lo", (rest_total + 1) // 2), ("rest_hi", rest_total // 2 + 1)):
                i = int(np.searchsorted(rest, rank))
                if i < len(rest) and rank > before_rest:
                    say(no, what, distinct[i])
    return pd.DataFrame(out, columns=["table_name", "column_name", "load_no", "what", "whole", "frac", "x"])


def profile(values: DataFrame, rows_per_range: int = 500_000) -> DataFrame:
    """One row per table, column and load, from the union of :func:`counted_values`.

    ``n_rows``, ``n_null``, ``n_invalid``, ``n_distinct``, ``top_count`` (the most frequent value's),
    ``min_value``/``max_value`` (as text), ``median2``/``rest_median2`` (twice the exact median of the load and
    of the column's other loads together, as doubles, so that halves stay exact; null for text), ``ks`` (exact distance
    of the two cumulative curves). Nulls and NaN are counted but have no place in curves; a null load is a
    load of its own; without other loads ``rest_median2`` and ``ks`` are null; an empty table gives no rows.
    """
    counted = stage(values, "counted")
    held = counted.count()
    present = counted.frame.where(F.coalesce(F.col("whole").cast("string"), F.col("frac").cast("string"), F.col("txt")).isNotNull())
    ranges = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // rows_per_range))
    by_value = [*_WHERE, *_VALUE]
    ranged = present.repartitionByRange(ranges, *by_value).sortWithinPartitions(*by_value)
    ranged = stage(ranged.withColumn("pid", F.spark_partition_id()), "ranged")

    here = ranged.frame.groupBy("pid", *_WHERE, "load_no").agg(F.sum("n").alias("here"))
    totals = here.groupBy(*_WHERE, "load_no").agg(F.sum("here").alias("total"))
    pids = ranged.frame.select("pid", *_WHERE).distinct()
    grid = pids.join(totals, _WHERE)
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("pid", *_WHERE, "load_no")]
    grid = grid.alias("g").join(here.alias("h"), same, "left").select("g.*", F.coalesce("h.here", F.lit(0)).alias("here"))
    upto = Window.partitionBy(*_WHERE, "load_no").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = grid.withColumn("before", F.coalesce(F.sum("here").over(upto), F.lit(0)))

    group = ["pid", *_WHERE]
    answers = ranged.frame.groupBy(*group).cogroup(offsets.groupBy(*group)).applyInPandas(lambda a, b: _curves(a, b), _CURVE)
    pick = lambda what, kind: F.max(F.when(F.col("what") == what, F.col(kind)))

    def twice(lo: str, hi: str) -> Column:
        """The sum of the two middle values: exact for whole numbers, then a double."""
        whole = (pick(lo, "whole").cast("decimal(20,0)") + pick(hi, "whole").cast("decimal(20,0)")).cast("double")
        return F.coalesce(whole, pick(lo, "frac") + pick(hi, "frac"))

    curves = answers.groupBy(*_WHERE, "load_no").agg(F.max("x").alias("ks"), twice("own_lo", "own_hi").alias("median2"), twice("rest_lo", "rest_hi").alias("rest_median2"))
    is_null = F.col("whole").isNull() & F.col("frac").isNull() & F.col("txt").isNull()
    sound = F.when(~is_null, F.col("n"))
    stats = counted.frame.groupBy(*_WHERE, "load_no").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(is_null, F.col("n"))), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("n_invalid"),
        F.count(sound).alias("n_distinct"),
        F.coalesce(F.max(sound), F.lit(0)).alias("top_count"),
        F.coalesce(F.min("whole").cast("string"), F.min("frac").cast("string"), F.min("txt")).alias("min_value"),
        F.coalesce(F.max("whole").cast("string"), F.max("frac").cast("string"), F.max("txt")).alias("max_value"),
    )
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*_WHERE, "load_no")]
    return stats.alias("s").join(curves.alias("c"), same, "left").select("s.*", "ks", "median2", "rest_median2")


def findings(profiled: DataFrame, null_share: float = 0.1, bad_share: float = 0.1, top_share: float = 0.3, shift: float = 0.25) -> DataFrame:
    """``(table_name, column_name, load_no, finding)``: ``nulls``, ``invalid``, ``dominant``, ``shift``."""
    filled = F.col("n_rows") - F.col("n_null")
    dec = lambda v: F.lit(str(v)).cast("decimal(10,4)")
    tests = {
        "nulls": F.col("n_null") >= dec(null_share) * F.col("n_rows"),
        "invalid": (filled > 0) & (F.col("n_invalid") >= dec(bad_share) * filled),
        "dominant": (filled > 0) & (F.col("top_count") >= dec(top_share) * filled),
        "shift": F.abs(F.col("median2") - F.col("rest_median2")) > F.lit(shift) * F.abs(F.col("rest_median2")),
    }
    found = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    return profiled.select(*_WHERE, "load_no", F.explode(found).alias("finding"))
