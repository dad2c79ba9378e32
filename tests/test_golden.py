"""Worked examples with known results."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as words
from quern.operators import graph, joins, keyed

#: fixed values: published inputs, whose printed results the tests below state
THREE_DOCS = ["fox jumped and jumped", "fox jumped high", "fox jumped high", "fox jumped ", "fox is red", "fox is red"]
D1 = [(1, "v1"), (1, "v2"), (2, "v3"), (2, "v4"), (3, "v5"), (4, "v6"), (5, "v7")]
D2 = [(1, "w1"), (1, "w2"), (2, "w3"), (2, "w4"), (2, "w5"), (3, "w6"), (6, "w7"), (7, "w8")]
CLICKS = [("u1", "2025-09-11 10:00:00"), ("u1", "2025-09-11 10:05:00"), ("u1", "2025-09-11 11:30:00"), ("u2", "2025-09-11 09:00:00"), ("u2", "2025-09-11 09:45:00")]
FAMILY = [("1", "2"), ("2", "1"), ("3", "1"), ("1", "3"), ("2", "3"), ("3", "4"), ("4", "3"), ("5", "3"), ("3", "5"), ("4", "5"), ("98", "99"), ("99", "98")]


def counts(df):
    return {r[0]: r[1] for r in df.collect()}


def lines(spark, *ls):
    return spark.createDataFrame([(x,) for x in ls], "line string")


def test_word_count_three_documents(spark):
    words_ = lines(spark, *THREE_DOCS).select(F.explode(words.split_blanks(F.col("line"))).alias("word"))
    assert counts(words.count_words(words_)) == {"fox": 6, "jumped": 5, "and": 1, "high": 2, "is": 2, "red": 2}
    assert counts(words.count_words(words_, least=4)) == {"fox": 6, "jumped": 5}


def test_classic_rules_drop_short_words_before_stripping(spark):
    docs = lines(spark, "is, is a fox;", "ab", "  Fox. fox", "", None)
    assert counts(words.count_words(words.classic_words(docs, "line"))) == {"is": 1, "fox": 2, "Fox": 1}


def test_filtered_counts_and_runs_of_blanks(spark):
    docs = lines(spark, "Fox  fox\tFOX", "is is is", "red red")
    assert counts(words.count_words(words.folded_words(docs, "line", 2), least=3)) == {"fox": 3}


def test_palindromes(spark):
    docs = lines(spark, "madam level civic", "madam level x aa", "level madam civic fox madam")
    assert counts(words.palindromes(words.folded_words(docs, "line"))) == {"level": 3, "civic": 2, "madam": 4}


def test_cooccurrence(spark):
    docs = lines(spark, "spark big data", "big data analytics", "python with spark")
    got = {(r.a, r.b): r.n for r in words.cooccurrence(docs, "line").collect()}
    assert got == {("big", "data"): 2, ("big", "spark"): 1, ("data", "spark"): 1, ("analytics", "big"): 1, ("analytics", "data"): 1, ("spark", "with"): 1, ("python", "spark"): 1, ("python", "with"): 1}


def test_log_levels_count_a_line_for_several(spark):
    docs = lines(spark, "ERROR: an Exception", "a Warning and an error", "fine")
    assert counts(words.level_counts(docs, "line")) == {"error": 2, "exception": 1, "warning": 1}


def test_title_case_keeps_the_tail(spark):
    assert lines(spark, "john mcDonald x").select(words.title_words(F.col("line"))).first()[0] == "John McDonald X"


@pytest.mark.parametrize("how,n", [("inner", 11), ("left", 13), ("right", 13), ("full", 15), ("left_semi", 5), ("left_anti", 2), ("cross", 56)])
def test_join_cardinalities(spark, how, n):
    a, b = spark.createDataFrame(D1, "id int, value1 string"), spark.createDataFrame(D2, "id int, value2 string")
    assert (a.crossJoin(b) if how == "cross" else a.join(b, "id", how)).count() == n


def test_join_plans_agree(spark):
    a, b = spark.createDataFrame(D1 + [(None, "v0")], "k int, l string"), spark.createDataFrame(D2 + [(None, "w0")], "k int, r string")
    want = sorted(tuple(r) for r in a.join(b, "k").select("k", "l", "r").collect())
    assert sorted(tuple(r) for r in joins.reduce_side_join(a, b, "k", "l", "r").collect()) == want
    salted = joins.salted_join(a, b.withColumnRenamed("k", "k2"), "k", "k2", 3).select("k", "l", "r")
    assert sorted(tuple(r) for r in salted.collect()) == want


KV = [("A", 2), ("A", 3), ("A", 4), ("A", 5), ("B", 6), ("B", 7), ("B", 8)]


def test_combine_reduce_and_group_agree(spark):
    df = spark.createDataFrame(KV, "k string, v bigint").repartition(3)
    combined = keyed.combine_by_key(df, ["k"], {"s": F.col("v"), "n": F.lit(1), "lo": F.col("v"), "hi": F.col("v")}, {"s": F.sum, "n": F.sum, "lo": F.min, "hi": F.max}, {"a": F.col("s") / F.col("n"), "lo": F.col("lo"), "hi": F.col("hi")})
    assert {r.k: (r.a, r.lo, r.hi) for r in combined.collect()} == {"A": (3.5, 2, 5), "B": (7.0, 6, 8)}
    assert counts(keyed.reduce_by_key(df, ["k"], "v")) == {k: sum(v) for k, v in counts(keyed.group_by_key(df, ["k"], "v")).items()} == {"A": 14, "B": 21}


def test_best_item_ignores_ratings_up_to_zero_and_breaks_ties(spark):
    df = spark.createDataFrame([("u1", "m2", 5), ("u1", "m1", 5), ("u2", "m7", 4), ("u3", "m6", 0)], "u string, m string, r int")
    assert {(r.u, r.m) for r in keyed.best_per_key(df, "u", "m", "r").collect()} == {("u1", "m1"), ("u2", "m7")}


def test_call_minutes_are_cut_off_call_by_call_and_summed_before_the_filter(spark):
    rows = [("507", "2015-03-01 10:00:00", "2015-03-01 10:04:59", 1), ("507", "2015-03-01 11:00:00", "2015-03-01 12:11:30", 1), ("508", "2015-03-01 10:00:00", "2015-03-01 10:59:59", 1), ("508", None, "2015-03-01 10:59:59", 1), ("509", "2015-03-01 10:00:00", "2015-03-01 13:00:00", 0)]
    df = spark.createDataFrame(rows, "c string, s string, e string, f int").withColumns({x: F.try_to_timestamp(x) for x in "se"}).repartition(2)
    assert counts(keyed.call_minutes(df, "c", "s", "e", F.col("f") == 1)) == {"507": 75}


def test_sessions(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CLICKS)], "id int, u string, t string").withColumn("t", F.to_timestamp("t"))
    assert [r.session for r in keyed.sessions(df, "u", "t", "id").orderBy("id").collect()] == [1, 1, 2, 1, 2]


def test_family_rank_and_components(spark):
    ids = sorted({x for e in FAMILY for x in e})
    g = graph.Graph(spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(FAMILY, "src string, dst string"))
    vertices, edges = graph.page_rank(g, tol=1e-7)
    ranks = {r.id: r.pagerank for r in vertices.collect()}
    assert ranks["3"] == pytest.approx(1.887531, abs=1e-5) and ranks["98"] == pytest.approx(1.0, abs=1e-5) == ranks["99"]
    assert {(r.src, r.dst): r.weight for r in edges.collect()}["3", "4"] == pytest.approx(1 / 3)
    assert len({r.component for r in graph.connected_components(g).collect()}) == 2


def test_common_friends(spark):
    lists = {"A": "BCD", "B": "ACDE", "C": "ABDE", "D": "ABCE", "E": "BCD"}
    df = spark.createDataFrame([(p, f) for p, fs in lists.items() for f in fs], "person string, friend string")
    got = {r.a + r.b: "".join(r.common) for r in keyed.common_friends(df).collect()}
    assert got == {"AB": "CD", "AC": "BD", "AD": "BC", "BC": "ADE", "BD": "ACE", "BE": "CD", "CD": "ABE", "CE": "BD", "DE": "BC"}


def test_two_stage_average_of_sums_is_the_average(spark):
    df = spark.createDataFrame([(i, "k", float(i)) for i in range(100)], "id int, k string, v double")
    got = keyed.two_stage(df, ["k"], ["id"], {"s": F.sum("v"), "n": F.count("v")}, {"s": F.sum("s"), "n": F.sum("n")}).first()
    assert got.s / got.n == 49.5
