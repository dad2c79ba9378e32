import math
import random
from collections import Counter
from statistics import median

import pytest
from pyspark.sql import functions as F

from quern.operators.quality import CITY_FORM, Check, counted_values, findings, profile
from quern.plans import data_problems
from quern.plans.registry import table
from tests.sql_match import SMALL, connection

SCHEMA = "load_no int, age int, temp double, city string, n int, bad string"


def make(seed=3, n=600):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        load = rng.choice([1, 1, 2, 3, None])
        age = rng.choice([None, 17, 20, 20, 20, 33, 95, 40 + (load or 0) * 5])
        rows.append((load, age, rng.choice([None, float("nan"), 1.5, 2.5, -3.0, float(load or 0)]), rng.choice([None, " ", "Rom", "rom", "New York", "O'Hara", "X Æ9"]), 1, "x"))
    return rows


CHECKS = [Check("age", "whole", lambda v: v.between(18, 90)), Check("temp", "frac", lambda v: v > -1), Check("city", "text", lambda v: v.rlike(CITY_FORM), blank_is_null=True)]


def brute(rows, column):
    pick = {"age": 1, "temp": 2, "city": 3}[column]
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) or (isinstance(v, str) and not v.strip(" ")) else v
    loads = {r[0] for r in rows}
    out = {}
    for load in loads:
        mine = [clean(r[pick]) for r in rows if r[0] == load]
        rest = [clean(r[pick]) for r in rows if r[0] != load]
        own, other = [v for v in mine if v is not None], [v for v in rest if v is not None]
        values = sorted(set(own) | set(other))
        ks = max((abs(sum(x <= v for x in own) / len(own) - sum(x <= v for x in other) / len(other)) for v in values), default=None) if own and other else None
        out[load] = (len(mine), len(mine) - len(own), len(set(own)), max(Counter(own).values(), default=0), ks, own, other)
    return out


@pytest.mark.parametrize("per_range", [1, 20, 10**6])
def test_profile_is_exact(spark, per_range):
    rows = make()
    got = profile(counted_values(spark.createDataFrame(rows, SCHEMA), "t", "load_no", CHECKS), rows_per_range=per_range).collect()
    for column in ("age", "temp", "city"):
        want = brute(rows, column)
        mine = {r.load_no: r for r in got if r.column_name == column}
        assert mine.keys() == want.keys()
        for load, (n, nulls, distinct, top, ks, own, other) in want.items():
            r = mine[load]
            assert (r.n_rows, r.n_null, r.n_distinct, r.top_count) == (n, nulls, distinct, top)
            assert r.ks == pytest.approx(ks, abs=1e-12)
            if column != "city":
                assert float(r.median2) == pytest.approx(2 * median(own)) and float(r.rest_median2) == pytest.approx(2 * median(other))


def test_findings(spark):
    rows = [(1, 20, 0.0, "Rom", 1, "x")] * 9 + [(1, None, 0.0, "Rom", 1, "x")] + [(2, 30, 0.0, "rom", 1, "x")] * 10
    found = findings(profile(counted_values(spark.createDataFrame(rows, SCHEMA), "t", "load_no", CHECKS[::2]))).collect()
    assert {(r.column_name, r.load_no, r.finding) for r in found} == {("age", 1, "nulls"), ("age", 1, "dominant"), ("age", 2, "dominant"), ("age", 1, "shift"), ("age", 2, "shift"), ("city", 1, "dominant"), ("city", 2, "dominant"), ("city", 2, "invalid")}


def test_huge_and_infinite_values(spark):
    rows = [(1, 2**31 - 1, 1e300, "A", 1, "x"), (1, 5, 1e300, "A", 1, "x"), (2, 5, float("inf"), "A", 1, "x"), (2, 5, -1e300, "A", 1, "x"), (2, 5, 1e-9, "A", 1, "x")]
    got = {(r.column_name, r.load_no): r for r in profile(counted_values(spark.createDataFrame(rows, SCHEMA), "t", "load_no", CHECKS)).collect()}
    assert got["temp", 1].median2 == 2e300 and got["temp", 2].median2 == 2e-9 and got["age", 1].median2 == 2.0**31 + 4


def test_empty_single_load_and_all_null(spark):
    assert profile(counted_values(spark.createDataFrame([], SCHEMA), "t", "load_no", CHECKS)).count() == 0
    only = profile(counted_values(spark.createDataFrame([(1, None, None, None, 1, "x"), (1, 5, None, None, 1, "x")], SCHEMA), "t", "load_no", CHECKS)).collect()
    by = {r.column_name: r for r in only}
    assert by["age"].rest_median2 is None and by["age"].ks is None and float(by["age"].median2) == 10
    assert by["temp"].n_null == 2 and by["temp"].n_distinct == 0 and by["temp"].median2 is None
    assert {(r.column_name, r.finding) for r in findings(profile(counted_values(spark.createDataFrame([(1, None, None, None, 1, "x")], SCHEMA), "t", "load_no", CHECKS))).collect()} == {("age", "nulls"), ("temp", "nulls"), ("city", "nulls")}


@pytest.mark.parametrize("city,sound", [("Rom", True), ("Saint-Étienne", True), ("O'Hara", True), ("rom", False), ("Rom ", False), ("Rom\n", False), ("A  B", False), ("Rom2", False), ("-Rom", False)])
def test_city_form(spark, city, sound):
    assert spark.createDataFrame([(city,)], "c string").select(F.col("c").rlike(CITY_FORM)).first()[0] is sound


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_times_are_profiled_to_the_microsecond(spark, kind):
    texts = [(1, "2024-03-31 02:30:00.000001"), (1, "2024-03-31 02:30:00.000002"), (1, None), (2, "1969-12-31 23:59:59.999999"), (2, "2024-03-31 03:30:00"), (2, "2024-03-31 03:30:00")]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin" if kind == "timestamp_ntz" else "UTC")  # 02:30 does not exist there
    try:
        df = spark.createDataFrame(texts, "load_no int, at string").withColumn("at", F.col("at").cast(kind))
        got = {r.load_no: r for r in profile(counted_values(df, "t", "load_no", [Check("at", "time")])).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    half_past_two, half_past_three = 1_711_852_200_000_000, 1_711_855_800_000_000
    assert (got[1].n_rows, got[1].n_null, got[1].n_distinct, got[1].top_count) == (3, 1, 2, 1)
    assert (got[1].min_value, got[1].max_value) == (str(half_past_two + 1), str(half_past_two + 2))
    assert (got[2].min_value, got[2].max_value, got[2].n_distinct, got[2].top_count) == ("-1", str(half_past_three), 2, 2)
    assert got[1].median2 == 2 * half_past_two + 3 and got[1].rest_median2 == got[2].median2 == 2 * half_past_three
    assert got[1].ks == pytest.approx(2 / 3)


def test_profile_query_has_every_column(spark):
    got = {(r.table_name, r.column_name, r.load_no): r for r in data_problems.p3_profile(spark, SMALL).collect()}
    con = connection(SMALL)
    for name in ("employees", "continents_countries_temp"):
        kinds = {c: k for c, k in table(spark, SMALL, name).dtypes if c != "load_no"}
        assert {c for t, c, _ in got if t == name} == kinds.keys()
        for c, kind in kinds.items():
            v = f"CASE WHEN length(trim({c})) > 0 THEN {c} END" if kind == "string" else f"epoch_us({c})" if kind.startswith("timestamp") else c
            bad = {"string": rf"NOT regexp_full_match({c}, '\p{{Lu}}\p{{L}}*([ ''-]\p{{L}}+)*') AND length(trim({c})) > 0"}.get(kind, "department_id <= 0" if c == "department_id" else None)
            for load, n, nulls, distinct, lo, hi, wrong in con.execute(f"SELECT load_no, count(*), count(*) - count(v), count(DISTINCT v), min(v), max(v), count(*) FILTER (WHERE {bad or 'false'}) FROM (SELECT *, {v} AS v FROM {name}) GROUP BY 1").fetchall():
                r = got[name, c, load]
                assert (r.n_rows, r.n_null, r.n_distinct) == (n, nulls, distinct)
                if kind != "double" and lo is not None:
                    assert (r.min_value, r.max_value) == (str(lo), str(hi))
                if bad:
                    assert r.n_invalid == wrong
