from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from quern.operators.references import bloom_blocks, might_exist, orphan_report, orphans

PARENT, CHILD = "id int, name string, created_at timestamp_ntz, deleted_at timestamp_ntz", "row_id bigint, department_id int, recorded_at timestamp_ntz, reason string, __parent int"
day = lambda n: dt(2024, 1, n)
PARENTS = [(1, "a", day(2), None), (1, "a", day(2), None), (2, "b", day(1), day(5)), (2, "b", day(8), None), (3, "c", None, None), (None, "d", day(1), None)]
CHILDREN = [(1, 1, day(3)), (2, 1, day(1)), (3, 2, day(5)), (4, 2, day(4)), (5, 2, day(9)), (6, 3, day(3)), (7, 99, day(3)), (8, None, day(3)), (9, 1, None), (10, 1, day(3)), (10, 99, day(3))]
WANT = sorted([(2, "not_yet"), (3, "deleted"), (6, "deleted"), (7, "missing"), (9, "deleted"), (10, "missing")])


def children(spark):
    return spark.createDataFrame([(*r, "old", 5) for r in CHILDREN], CHILD)


@pytest.mark.parametrize("limit", [32 << 20, 4096])
def test_orphans_by_broadcast_and_by_shuffle(spark, limit):
    parents = spark.createDataFrame(PARENTS + [(k, "x", day(1), None) for k in range(1000, 1300)], PARENT)
    found = orphans(children(spark), "department_id", "recorded_at", parents, max_broadcast=limit)
    assert found.columns == ["row_id", "department_id", "recorded_at", "reason", "__parent", "reason_"]
    assert sorted((r.row_id, r.reason_) for r in found.collect()) == WANT


def test_empty_sides(spark):
    none = spark.createDataFrame([], PARENT)
    found = orphans(children(spark), "department_id", "recorded_at", none).collect()
    assert len(found) == len(CHILDREN) - 1 and {r.reason_ for r in found} == {"missing"}
    assert orphans(children(spark).limit(0), "department_id", "recorded_at", none).count() == 0


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(20_000).select((F.col("id") * 7).alias("k"))
    blocks, n = bloom_blocks(keys, "k")
    from quern.operators.references import _block

    probes = spark.range(140_000).join(F.broadcast(blocks), _block(F.col("id"), n) == F.col("block"), "left").select("id", might_exist(F.col("id"), F.col("words")).alias("m"))
    hit = probes.groupBy((F.col("id") % 7 == 0).alias("real")).agg(F.avg(F.col("m").cast("int")).alias("share")).collect()
    share = {r.real: r.share for r in hit}
    assert share[True] == 1.0 and share[False] < 0.02


def test_report_counts_months(spark):
    parents = spark.createDataFrame(PARENTS, PARENT)
    report = orphan_report(orphans(children(spark).drop("reason"), "department_id", "recorded_at", parents), "e", "department_id", "recorded_at")
    assert {(r.month, r.reason): r.n_orphans for r in report.collect()} == {("2024-01", "not_yet"): 1, ("2024-01", "deleted"): 2, ("2024-01", "missing"): 2, (None, "deleted"): 1}
