"""What the plans of the operators must look like."""

from quern.operators import records, references, skewed_keys
from tests.sql_match import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_read_four_columns(spark):
    rows = spark.read.parquet(f"{SMALL}/scu_continents_2.parquet")
    text = plan(skewed_keys.number_rows(rows.select("continent", "country", "city", "ndata"), ["continent", "country"], pin=False))
    schema = text.split("ReadSchema")[1].split("\n")[0]
    assert "sdata" not in schema and "ndata" in schema
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_records_are_parsed_without_a_shuffle(spark):
    text = plan(records.parse_records(spark.read.parquet(f"{SMALL}/raw_lines.parquet")))
    assert "MapInArrow" in text and "Exchange" not in text


def test_references_shuffle_no_child_row(spark):
    staff, parents = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("employees", "departments"))
    text = plan(references.orphans(staff.select("row_id", "department_id", "recorded_at"), "department_id", "recorded_at", parents))
    assert not any("row_id" in line and "Exchange hashpartitioning" in line for line in text.splitlines())
    assert "IsNotNull(department_id)" in text
