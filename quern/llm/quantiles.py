"""Percentiles per group by exact bisection over summaries that can be combined.

A summary counts how often each value occurs per group (and load, month ...). Summaries of separate loads are
combined by putting them together, nothing else; they are exact, or rounded to a stated number of significant
bits, which bounds both their size and the error. Values become whole numbers of 64 bits in the same order, and
percentiles are found by bisection of those: each group and percentile has an interval that holds its rank; every
pass reads the values once, counts those below the interval's midpoints, keeps the part with the rank and shrinks
it to the values that occur in it. A pass settles eight bits, so eight passes settle any value, infinities too.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.staging import BROADCAST_BYTES, row_bytes, stage

#: bits that one pass settles: 2 ** BITS - 1 midpoints, so BITS halvings at once
BITS = 8
#: hash parts of each group where the intervals are too many to broadcast
SALTS = 16
_FRACTION = 1 << 52  # fixed values: the layout of a double
_BIAS = 1023


def order_number(v: Column) -> Column:
    """A double as a whole number in the same order; equal values (0 and -0 too) have equal numbers. NaN has none."""
    size = F.abs(v)
    # powers of two are exact, and a guess of the exponent that is off by one is mended
    guess = F.greatest(F.lit(1 - _BIAS), F.least(F.lit(_BIAS), F.floor(F.log2(size))))
    scaled = size * F.pow(F.lit(2.0), -guess)
    up, down = scaled >= 2, (scaled < 1) & (guess > 1 - _BIAS)
    exponent = F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)
    mantissa = F.when(up, scaled / 2).when(down, scaled * 2).otherwise(scaled)
    bits = (exponent + _BIAS) * _FRACTION + ((mantissa - 1) * _FRACTION).cast("bigint")
    bits = F.when(size == 0, F.lit(0)).when(size == F.lit(float("inf")), F.lit((2 * _BIAS + 1) * _FRACTION)).otherwise(bits)
    return F.when(F.isnan(v), None).otherwise(F.when(v < 0, -bits).otherwise(bits)).cast("bigint")


def number_value(number: Column) -> Column:
    """The double of :func:`order_number`."""
    size = F.abs(number)
    exponent, rest = F.shiftright(size, 52), size.bitwiseAND(_FRACTION - 1)
    normal = (1 + rest / F.lit(float(_FRACTION))) * F.pow(F.lit(2.0), exponent - _BIAS)
    tiny = (rest / F.lit(float(_FRACTION))) * F.pow(F.lit(2.0), F.lit(1 - _BIAS))
    value = F.when(exponent == 0, tiny).when(exponent > 2 * _BIAS, F.lit(float("inf"))).otherwise(normal)
    return F.when(number < 0, -value).otherwise(value)


def _number(kind: T.DataType) -> tuple:
    """How values of ``kind`` become whole numbers in the same order, and back."""
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        one = F.lit(10**kind.scale).cast("decimal(19,0)")
        return lambda v: (v * one).cast("bigint"), lambda n: (n.cast("decimal(19,0)") / one).cast(kind)
    if isinstance(kind, T.IntegralType):
        return lambda v: v.cast("bigint"), lambda n: n
    return lambda v: order_number(v.cast("double")), number_value


def summarize(df: DataFrame, groups: Sequence[str], value: str, bits: int | None = None) -> DataFrame:
    """``(groups, v, width, n)``: ``n`` rows of the group have a value in ``[v, v + width]``.

    With ``bits=None`` the summary is exact (``width`` 0); a decimal of more than 18 digits is taken as a double. Else ``v``
    is rounded down to ``bits`` significant bits, so that ``width <= 2 * |value| / 2**bits``, and a group has a bounded number
    of rows however many values; infinities stay as they are. Null and NaN values are left out, null groups are a group;
    an empty table has an empty summary.
    """
    v, kind = F.col(f"`{value}`"), df.schema[value].dataType
    if bits is not None or not (isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.precision <= 18):
        kind = T.DoubleType()
    v = v.cast("bigint" if isinstance(kind, T.IntegralType) else kind)
    rows = df.where(v.isNotNull() & (~F.isnan(v) if isinstance(kind, T.DoubleType) else F.lit(True)))
    width = F.lit(0.0)
    if bits is not None:
        step = F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(F.abs(v))) - (bits - 1)), F.lit(5e-324))
        plain = (v == 0) | (F.abs(v) == F.lit(float("inf")))
        width = F.when(plain, F.lit(0.0)).otherwise(step)
        # beyond 2**63 a floor is no double, but there the quotient by a step is small
        v = F.when(v == 0, F.lit(0.0)).when(plain, v).otherwise(F.floor(v / step) * step)
    return rows.select(*[F.col(f"`{g}`") for g in groups], v.alias("v"), width.alias("width")).groupBy(*groups, "v", "width").agg(F.count(F.lit(1)).alias("n"))


def combine(*summaries: DataFrame) -> DataFrame:
    """The summary of all loads together."""
    return reduce(DataFrame.unionByName, summaries)


def _shift(lo: Column, hi: Column) -> Column:
    """How many low bits to leave out so that at most 2 ** BITS parts are left between ``lo`` and ``hi``."""
    return F.greatest(F.lit(0), F.length(F.bin(lo.bitwiseXOR(hi))) - BITS)


def percentiles(summary: DataFrame | Sequence[DataFrame], groups: Sequence[str], per_mille: Sequence[int]) -> DataFrame:
    """``(groups, per_mille, n_rows, lower, upper)``: the value of rank ``ceil(n * p / 1000)`` (at least 1) of each group
    lies in ``[lower, upper]``; both are equal for an exact summary.

    ``groups`` may leave out grouping columns of the summary: its rows then combine. Several summaries, of values of
    different types, are bisected in the same passes and come out together, each group apart, ``lower`` and ``upper`` then
    as doubles. Every pass is one scan of the values, joined with the open intervals (broadcast within a measured size, else
    shuffled in hashed parts of each group) and a pre-aggregated count of at most 2 ** BITS rows per interval; when
    a quarter or less of the values lies in open intervals, those are written and read from then on.
    """
    summaries = [summary] if isinstance(summary, DataFrame) else list(summary)
    names = [f"g{i}" for i in range(len(groups))]
    kinds = [s.schema["v"].dataType for s in summaries]
    keyed = [
        s.select(F.lit(i).alias("src"), *[F.col(f"`{g}`").alias(n) for g, n in zip(groups, names)], _number(k)[0](F.col("v")).alias("v"), F.col("width").cast("double").alias("width"), "n")
        for i, (s, k) in enumerate(zip(summaries, kinds))
    ]
    of = ["src", *names]
    held = rows = stage(combine(*keyed), "summary")
    totals = rows.frame.groupBy(*of).agg(F.sum("n").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("rows"))
    rank = F.greatest(F.lit(1), F.expr("(total * p + 999) div 1000"))
    aims = totals.withColumn("p", F.explode(F.array(*[F.lit(int(p)) for p in per_mille]))).withColumn("rank", rank)
    aims, there = stage(aims, "aims"), None
    while True:
        left = aims.frame.where("lo < hi").select(*of, "lo", "hi", "rows").distinct()
        n_open, size, inside = left.agg(F.count(F.lit(1)), F.sum(row_bytes(left)), F.sum("rows")).first()
        if not n_open:
            break
        there = there or inside
        joined = _inside(rows.frame, left.drop("rows"), of, size)
        if rows is held and inside * 4 <= there:
            rows = stage(joined.select(*of, "v", "n"), "inside")
            joined = _inside(rows.frame, left.drop("rows"), of, size)
        shift = _shift(F.col("lo"), F.col("hi"))
        part = F.expr("shiftright(v, s)") - F.expr("shiftright(lo, s)")
        counted = joined.withColumn("s", shift).groupBy(*of, "lo", part.alias("part")).agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.count(F.lit(1)).alias("rows"))
        upto = Window.partitionBy(*of, "lo").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        parts = counted.withColumn("upto", F.sum("n").over(upto)).withColumn("before", F.col("upto") - F.col("n"))
        same = (F.col("a.lo") == F.col("c.lo")) & (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("upto"))
        for n in of:
            same = same & F.col(f"a.{n}").eqNullSafe(F.col(f"c.{n}"))
        narrowed = aims.frame.where("lo < hi").alias("a").join(parts.alias("c"), same).select(
            *[F.col(f"a.{n}").alias(n) for n in of], "total", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("c.rows").alias("rows"), "p", (F.col("rank") - F.col("before")).alias("rank")
        )
        following = stage(aims.frame.where("lo = hi").unionByName(narrowed), "aims")
        aims.drop()
        aims = following
    on = F.col("v") == F.col("lo")
    for n in of:
        on = on & F.col(f"a.{n}").eqNullSafe(F.col(f"w.{n}"))
    widths = held.frame.where("width > 0").groupBy(*of, "v").agg(F.max("width").alias("width"))
    found = aims.frame.alias("a").join(widths.alias("w"), on, "left").select(*[F.col(f"a.{n}").alias(n) for n in of], "p", "total", "lo", F.coalesce("width", F.lit(0.0)).alias("width"))
    out = []
    for i, kind in enumerate(kinds):
        value = _number(kind)[1](F.col("lo"))
        upper = value + F.col("width") if isinstance(kind, T.DoubleType) else value  # only doubles are rounded
        if len(set(map(str, kinds))) > 1:
            value, upper = value.cast("double"), upper.cast("double")
        mine = found if len(kinds) == 1 else found.where(F.col("src") == i)
        out.append(mine.select(*[F.col(n).alias(g) for n, g in zip(names, groups)], F.col("p").alias("per_mille"), F.col("total").alias("n_rows"), value.alias("lower"), upper.alias("upper")))
    return combine(*out)


def _inside(rows: DataFrame, intervals: DataFrame, of: list[str], size: int) -> DataFrame:
    """The rows that lie in one of the intervals, with its ends. The intervals of a group do not meet."""
    on = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    for n in of:
        on = on & F.col(f"i.{n}").eqNullSafe(F.col(f"r.{n}"))
    if size <= BROADCAST_BYTES:
        small = F.broadcast(intervals)
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        small = intervals.withColumn("each", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        on = on & (F.col("salt") == F.col("each"))
    return rows.alias("r").join(small.alias("i"), on).select(*[F.col(f"r.{n}").alias(n) for n in of], "v", "n", "lo", "hi")
