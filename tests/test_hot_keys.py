"""A user, person or key with most of the rows: the same results, no list or task with all of it."""

import random
from collections import defaultdict

from quern.operators import joins, keyed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sessions_of_a_hot_user_are_numbered_in_stretches(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 5 + ["b", None]), rng.choice([None, *range(40)]) if rng.random() < 0.02 else rng.randrange(4 * 1440) * 60) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, u string, s bigint").selectExpr("id", "u", "timestamp_seconds(s) AS t", "1 AS __part", "2 AS session_")
    got = keyed.sessions(df, "u", "t", "id")
    want, of = {}, defaultdict(list)
    for i, u, s in rows:
        of[u].append((s is not None, s or 0, i))
    for u, events in of.items():
        n, last = 0, None
        for there, s, i in sorted(events):
            n += last is None or not there or s - last > 1800
            last = s if there else None
            want[i] = n
    assert got.columns == ["id", "u", "t", "__part", "session_", "session"]
    assert {r.id: r.session for r in got.collect()} == want
    # rows meet per user and stretch, never per user
    assert not any("hashpartitioning(u#" in line and ", __part_" not in line and "id#" in line for line in plan(got).splitlines())


def test_hot_left_and_right_keys_are_cut_into_grids(spark):
    left = [("hot", i) for i in range(50)] + [("b", 1), (None, 3), ("hot", 1)]
    right = [("b", i) for i in range(33)] + [("hot", i) for i in range(7)] + [(None, 1), ("c", 1)]
    a, b = spark.createDataFrame(left, "k string, l int"), spark.createDataFrame(right, "k string, r int")
    want = sorted((k, x, y) for k, x in left for j, y in right if k == j and k)
    for most in (4, 10_000):
        assert sorted(tuple(r) for r in joins.reduce_side_join(a, b, "k", "l", "r", most).collect()) == want


def test_a_hot_person_is_never_listed(spark):
    rng = random.Random(1)
    friends = {(0, i) for i in range(1, 60)} | {(i, 0) for i in range(1, 60)} | {(rng.randrange(60), rng.randrange(60)) for _ in range(150)}
    df = spark.createDataFrame(sorted(friends) + [(None, 1), (1, None), (0, 1)], "person int, friend int")
    lists = defaultdict(set)
    for p, f in friends:
        lists[p].add(f)
    want = {(min(p, f), max(p, f)): sorted(lists[p] & lists[f]) for p, f in friends if p != f and p in lists and f in lists}
    assert {(r.a, r.b): r.common for r in keyed.common_friends(df).collect()} == want
