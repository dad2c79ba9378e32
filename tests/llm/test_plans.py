"""What the plans of the operators must look like."""

from pyspark.sql import functions as F

from quern.llm import spans, topn
from tests.sql_match import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_ranks_within_partitions_before_the_shuffle(spark):
    staff = spark.read.parquet(f"{SMALL}/employees.parquet")
    text = plan(topn.top_n(staff.select("row_id", "department_id", "salary"), "department_id", "salary", "row_id"))
    assert "WindowGroupLimit" in text and "BroadcastHashJoin" in text
    assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning") < text.rindex("WindowGroupLimit")
    assert "IsNotNull(salary)" in text and "name" not in text.split("ReadSchema")[1].split("\n")[0]


def test_millions_of_groups_shuffle_no_row_before_the_filter(spark):
    rows = spark.range(3_000_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 1_000_000).alias("g"), (F.col("id") * 7919 % 10_007).cast("double").alias("score"))
    found = topn.top_n(rows, "g", "score", "id", 2)
    text = plan(found)
    below = text[text.index("BroadcastHashJoin") :].split("BroadcastExchange")[0]
    assert "Exchange" not in below and "SortMergeJoin" not in text
    assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning") < text.rindex("WindowGroupLimit") < text.index("BroadcastHashJoin")
    assert found.groupBy("g").count().agg(F.max("count"), F.count("*")).first() == (2, found.select("g").distinct().count())


def test_spans_read_two_columns_and_join_no_text_by_shuffle(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = plan(spans.shared_spans(docs))
    assert "title" not in text
    assert not any("text" in line and "Exchange hashpartitioning" in line for line in text.splitlines())


def test_thresholds_leave_few_rows(spark):
    staff = spark.range(100_000).select(F.col("id"), (F.col("id") % 7).alias("g"), (F.col("id") * 1.0).alias("score"))
    assert topn.top_n(staff, "g", "score", "id").count() == 35
