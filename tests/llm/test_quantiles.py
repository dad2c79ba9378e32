import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quern.llm import quantiles
from quern.llm.quantiles import combine, percentiles, summarize

SCHEMA = "g string, load int, x bigint, y double, n int"
PS = (1, 500, 900, 990, 1000)


def make(seed=1, n=800):
    rng = random.Random(seed)
    return [(rng.choice([None, "hot", "hot", "hot", "b", "c"]), rng.randrange(3), rng.choice([None, 7, 7, 7, -5, 2**62, -(2**62), rng.randrange(-1000, 1000), 10**12 + rng.randrange(9)]), rng.choice([None, float("nan"), 1.5, -0.0, rng.gauss(0, 1e6), 1e300, float("inf")]), 1) for _ in range(n)]


def brute(rows, column, by=lambda r: r[0]):
    groups = {}
    for r in rows:
        v = r[column]
        if v is not None and v == v:
            groups.setdefault(by(r), []).append(v)
    return {(g, p): sorted(vs)[max(1, (len(vs) * p + 999) // 1000) - 1] for g, vs in groups.items() for p in PS}


@pytest.mark.parametrize("column,at", [("x", 2), ("y", 3)])
def test_exact(spark, column, at):
    rows = make()
    got = percentiles(summarize(spark.createDataFrame(rows, SCHEMA), ["g", "load"], column), ["g"], PS).collect()
    assert {(r.g, r.per_mille): r.lower for r in got} == brute(rows, at)
    assert all(r.lower == r.upper for r in got)


def test_loads_combine(spark):
    rows = make(2)
    parts = [summarize(spark.createDataFrame([r for r in rows if r[1] == k], SCHEMA), ["g", "load"], "x") for k in range(3)]
    both = combine(*parts)
    assert {(r.g, r.per_mille): r.lower for r in percentiles(both, ["g"], PS).collect()} == brute(rows, 2)
    per = percentiles(both, ["g", "load"], PS).collect()
    assert {((r.g, r.load), r.per_mille): r.lower for r in per} == brute(rows, 2, lambda r: (r[0], r[1]))


@pytest.mark.parametrize("bits", [3, 8])
def test_rounded_summaries_keep_their_bound(spark, bits):
    rows = [(g, k, x, y, n) for g, k, x, y, n in make(3) if y is None or abs(y) < 1e200 or y != y]
    df = spark.createDataFrame(rows, SCHEMA)
    summary = summarize(df, ["g"], "y", bits=bits)
    assert summary.count() < summarize(df, ["g"], "y").count()
    want = brute(rows, 3)
    for r in percentiles(summary, ["g"], PS).collect():
        exact = want[r.g, r.per_mille]
        assert r.lower <= exact <= r.upper and r.upper - r.lower <= 2 * abs(exact) / 2**bits * 2 + 1e-9


def test_few_bits_and_shuffled_joins_give_the_same(spark, monkeypatch):
    rows = make(4)
    monkeypatch.setattr(quantiles, "BITS", 3)
    monkeypatch.setattr(quantiles, "BROADCAST_BYTES", -1)
    got = percentiles(summarize(spark.createDataFrame(rows[:200], SCHEMA), ["g"], "y"), ["g"], (500, 990)).collect()
    want = brute(rows[:200], 3)
    assert {(r.g, r.per_mille): r.lower for r in got} == {k: v for k, v in want.items() if k[1] in (500, 990)}


INF = float("inf")
ODD = [0.0, -0.0, 5e-324, -5e-324, 1e-310, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 1.0000000000000002, 2.0, 1.9999999999999998, 0.1, 1e300, -1e300, 1.7976931348623157e308, -1.7976931348623157e308, INF, -INF]


def test_numbers_keep_the_order_and_come_back(spark):
    rng = random.Random(6)
    values = ODD + [-v for v in ODD] + [struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0] for _ in range(3000)] + [2.0**k for k in range(-1074, 1024)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1024)]
    values = [v for v in values if v == v]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.order_number(F.col("v")).alias("k")).withColumn("back", quantiles.number_value(F.col("k")))
    rows = df.collect()
    assert all(r.v == r.back for r in rows)
    assert [r.v for r in sorted(rows, key=lambda r: r.k)] == sorted(r.v for r in rows)
    bits = lambda v: struct.unpack("q", struct.pack("d", abs(v)))[0] * (1 if v > 0 else -1)
    assert all(r.k == bits(r.v) for r in rows)


def test_infinities_and_tiny_numbers_settle_in_eight_passes(spark, monkeypatch):
    rng = random.Random(7)
    values = [-INF] + [rng.random() for _ in range(3000)] + ODD + [10.0**-k for k in range(320)] + [None, float("nan")]
    df = spark.createDataFrame([("a", v) for v in values], "g string, y double")
    passes = []
    monkeypatch.setattr(quantiles, "_inside", lambda *a, real=quantiles._inside: passes.append(1) or real(*a))
    got = {r.per_mille: (r.lower, r.upper) for r in percentiles(summarize(df, ["g"], "y"), ["g"], PS).collect()}
    known = sorted(v for v in values if v is not None and v == v)
    assert got == {p: (v, v) for p in PS for v in [known[max(1, -(-len(known) * p // 1000)) - 1]]}
    assert len(passes) <= 9
    for r in percentiles(summarize(df, ["g"], "y", bits=8), ["g"], PS).collect():
        assert r.lower <= got[r.per_mille][0] <= r.upper and (r.lower == r.upper if abs(r.lower) == INF else r.upper - r.lower <= abs(got[r.per_mille][0]) / 64 + 1e-300)


def test_decimals_and_summaries_of_different_types_in_one_loop(spark):
    rng = random.Random(8)
    rows = [("a" if i % 3 else "b", Decimal(rng.randrange(-10**9, 10**9)) / 100, rng.gauss(0, 10), rng.randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, d decimal(12,2), f double, i int")
    got = percentiles(summarize(df, ["g"], "d"), ["g"], (500,)).collect()
    exact = lambda at, g: sorted(r[at] for r in rows if r[0] == g)[-(-sum(r[0] == g for r in rows) * 500 // 1000) - 1]
    assert {r.g: r.lower for r in got} == {g: exact(1, g) for g in "ab"}
    both = percentiles([summarize(df.withColumn("t", F.lit(c)), ["t", "g"], c) for c in "dfi"], ["t", "g"], (500,)).collect()
    assert {(r.t, r.g): r.lower for r in both} == {(c, g): float(exact("dfi".index(c) + 1, g)) for c in "dfi" for g in "ab"}


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert percentiles(summarize(empty, ["g"], "x"), ["g"], PS).count() == 0
    assert percentiles(summarize(spark.createDataFrame([("a", 1, None, float("nan"), 1)], SCHEMA), ["g"], "y"), ["g"], PS).count() == 0


def test_neighbouring_large_numbers(spark):
    rows = [("a", 0, 2**62 + i % 3, None, 1) for i in range(9)]
    got = percentiles(summarize(spark.createDataFrame(rows, SCHEMA), ["g"], "x"), ["g"], (500, 1000)).collect()
    assert {r.per_mille: r.lower for r in got} == {500: 2**62 + 1, 1000: 2**62 + 2}
