from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.operators.skewed_keys import chunked_stats, heavy_keys, number_rows

SCHEMA = "a string, b string, v bigint, city string, __mid int, k0 int, position int"


def rows_of(n=500):
    out = []
    for i in range(n):
        a = None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 7}"
        out.append((a, None if i % 13 == 0 else "x", None if i % 17 == 0 else i * 10**15 * (-1) ** i, None if i % 5 == 0 else f"c{i % 23}", i, i, i))
    return out


def brute(rows):
    n, s, c = Counter(), defaultdict(lambda: None), defaultdict(set)
    for a, b, v, city, *_ in rows:
        n[a, b] += 1
        c[a, b] |= {city} - {None}
        if v is not None:
            s[a, b] = (s[a, b] or 0) + v
    return {k: (n[k], s[k], len(c[k])) for k in n}


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_chunked_stats_equals_brute_force_at_any_chunk_size(spark, chunk):
    rows = rows_of()
    got = chunked_stats(spark.createDataFrame(rows, SCHEMA).repartition(5), ["a", "b"], "v", "city", chunk_rows=chunk).collect()
    assert {(r.a, r.b): (r.n_rows, None if r.sum_v is None else int(r.sum_v), r.n_city) for r in got} == brute(rows)
    assert all(r.contiguous for r in got)
    assert all(r.n_chunks == -(-r.n_rows // chunk) for r in got)


@pytest.mark.parametrize("chunk", [3, 50])
def test_too_many_offsets_for_a_broadcast_give_the_same(spark, chunk):
    rows = rows_of()
    got = chunked_stats(spark.createDataFrame(rows, SCHEMA).repartition(5), ["a", "b"], "v", "city", chunk_rows=chunk, max_broadcast=0).collect()
    assert {(r.a, r.b): (r.n_rows, None if r.sum_v is None else int(r.sum_v), r.n_city) for r in got} == brute(rows)
    assert all(r.contiguous and r.n_chunks == -(-r.n_rows // chunk) for r in got)


def test_sum_does_not_overflow(spark):
    big = 2**62
    got = chunked_stats(spark.createDataFrame([("k", None, big, "c", 0, 0, 0)] * 10, SCHEMA), ["a"], "v", "city").first()
    assert int(got.sum_v) == 10 * big and got.n_rows == 10 and got.n_city == 1


def test_all_values_null_gives_null_sum(spark):
    got = chunked_stats(spark.createDataFrame([(None, None, None, None, 0, 0, 0)] * 3, SCHEMA), ["a", "b"], "v", "city").first()
    assert (got.a, got.n_rows, got.sum_v, got.n_city) == (None, 3, None, 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chunked_stats(df, ["a", "b"], "v", "city").count() == 0
    assert number_rows(df, ["a"]).count() == 0


@pytest.mark.parametrize("pin", [True, False])
def test_number_rows_is_dense_and_unique_per_key(spark, pin, tmp_path):
    spark.createDataFrame(rows_of(), SCHEMA).repartition(6).write.parquet(str(tmp_path / "t"))
    got = number_rows(spark.read.parquet(str(tmp_path / "t")), ["a", "b"], pin=pin)
    assert got.columns[-1] == "position_"  # the table has a column of that name
    seen = defaultdict(list)
    for r in got.collect():
        seen[r.a, r.b].append(r.position_)
    assert all(sorted(p) == list(range(len(p))) for p in seen.values())


def test_heavy_keys_drop_null_and_blank(spark):
    rows = [("hot", "x", 1, "c", 0, 0, 0)] * 50 + [("  ", "x", 1, "c", 0, 0, 0)] * 40 + [(None, "x", 1, "c", 0, 0, 0)] * 9 + [("cold", "x", 1, "c", 0, 0, 0)]
    stats = chunked_stats(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "v", "city")
    assert [tuple(r) for r in heavy_keys(stats, ["a", "b"], 0.5).collect()] == [("hot", "x")]


def test_unknown_key_is_an_error(spark):
    with pytest.raises(ValueError):
        number_rows(spark.range(3), ["nope"])


def test_rows_are_not_shuffled(spark):
    plan = number_rows(spark.range(1000).withColumn("k", F.col("id") % 3), ["k"], pin=False)._jdf.queryExecution().executedPlan().toString()
    big_side = plan.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in big_side


def test_offsets_of_long_keys_are_measured_not_guessed(spark):
    rows = spark.range(400).select(F.concat(F.lit("x" * 30_000), F.col("id").cast("string")).alias("k"), F.lit(1).alias("v"), F.lit("c").alias("city"))
    plan = number_rows(rows, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert "BroadcastHashJoin" in number_rows(rows.select(F.substring("k", 30_000, 9).alias("k")), ["k"])._jdf.queryExecution().executedPlan().toString()
