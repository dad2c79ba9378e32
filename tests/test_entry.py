import __spark_entry__


def test_entry_gives_rows_and_a_stable_schema(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["continent", "country", "n_rows", "sum_ndata", "n_city"] and df.count() > 0
