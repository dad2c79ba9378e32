import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import topn
from quern.llm.topn import score_bucket, top_n

SCHEMA = "id bigint, g string, score double, rank int, __g int"


def brute(rows, n):
    by = {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            by.setdefault(r[1], []).append(r)
    return sorted(r[0] for rs in by.values() for r in sorted(rs, key=lambda r: (-r[2], r[0]))[:n])


@pytest.mark.parametrize("n", [1, 5, 1000])
def test_equals_brute_force(spark, n):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "hot", "hot", "hot", "a", "b"]), rng.choice([None, 5.0, 5.0, -1e9, 0.0, float("inf"), -float("inf"), rng.uniform(-10, 1e6)]), 1, 1) for i in range(700)]
    got = top_n(spark.createDataFrame(rows, SCHEMA), "g", "score", "id", n)
    assert got.columns == ["id", "g", "score", "rank", "__g", "rank_"]
    assert sorted(r.id for r in got.collect()) == brute(rows, n)


def test_repeated_rows_ties_and_empty(spark):
    rows = [(1, "a", 5.0, 0, 0)] * 3 + [(2, "a", 5.0, 0, 0), (None, "a", 5.0, 0, 0)]
    assert [r.id for r in top_n(spark.createDataFrame(rows, SCHEMA), "g", "score", "id", 4).orderBy("rank_").collect()] == [1, 1, 1, 2]
    assert top_n(spark.createDataFrame([], SCHEMA), "g", "score", "id").count() == 0
    assert top_n(spark.createDataFrame([(1, None, 5.0, 0, 0), (2, "a", None, 0, 0)], SCHEMA), "g", "score", "id").count() == 0


def test_not_a_number_ranks_first(spark):
    rows = [(1, "a", 5.0, 0, 0), (2, "a", float("nan"), 0, 0), (3, "a", float("inf"), 0, 0)]
    assert [r.id for r in top_n(spark.createDataFrame(rows, SCHEMA), "g", "score", "id", 2).orderBy("rank_").collect()] == [2, 3]


@pytest.mark.parametrize("room", [0, 1, 5])
def test_fewer_thresholds_than_groups_give_the_same(spark, room):
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 40}", float(i * i % 101), 0, 0) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert topn._thresholds(df, F.col("g"), F.col("score"), 4, room).count() <= room
    assert sorted(r.id for r in top_n(df, "g", "score", "id", 4, thresholds=room).collect()) == brute(rows, 4)


def test_the_thresholds_kept_are_those_of_the_largest_groups(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 700)).alias("g"), F.col("id").cast("double").alias("score"))
    assert [r.key for r in topn._thresholds(df, F.col("g"), F.col("score"), 5, 3).collect()] == [spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]]


def test_more_than_a_partial_limit_of_rows(spark):
    rows = [(i, "hot" if i % 3 else "b", float(i % 7), 0, 0) for i in range(4000)]
    assert sorted(r.id for r in top_n(spark.createDataFrame(rows, SCHEMA), "g", "score", "id", 1100).collect()) == brute(rows, 1100)


def test_buckets_never_fall(spark):
    values = sorted([0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300, 1.0, 1.0000001, -5.0, 2.0**53, 2.0**63] + [random.Random(1).uniform(-1e7, 1e7) for _ in range(2000)])
    buckets = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(score_bucket(F.col("v"))).collect()]
    assert buckets == sorted(buckets)
