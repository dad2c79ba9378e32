"""A sparse wide-column table as long rows ``(row_key, family, qualifier, ts, value)``; newest version wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.staging import stage

CELL = ["row_key", "family", "qualifier"]


def to_cells(df: DataFrame, key: str, families: dict[str, Sequence[str]], ts: str) -> DataFrame:
    """Cells of an ordinary table; null values make no cell."""
    cells = [F.struct(F.lit(f).alias("family"), F.lit(q).alias("qualifier"), F.col(q).cast("string").alias("value")) for f, qs in families.items() for q in qs]
    long = df.select(F.col(key).cast("string").alias("row_key"), F.col(ts).alias("ts"), F.explode(F.array(*cells)).alias("c"))
    return long.select("row_key", "c.family", "c.qualifier", "ts", "c.value").where("value IS NOT NULL")


def put(table: DataFrame, cells: DataFrame, families: Sequence[str]) -> DataFrame:
    """Append new versions. Families are fixed when the table is made; cells of others are an error at run time."""
    known = F.col("family").isin(*families)
    checked = cells.withColumn("family", F.when(known, F.col("family")).otherwise(F.raise_error(F.concat(F.lit("unknown family "), F.coalesce("family", F.lit("null"))))))
    return table.unionByName(checked)


def store(table: DataFrame) -> DataFrame:
    """The cells written once to the shared folder in the order of their keys, and read from there: the statistics of
    the files then let a range of keys skip all others."""
    return stage(table.repartitionByRange("row_key").sortWithinPartitions("row_key"), "cells").frame


def latest(table: DataFrame) -> DataFrame:
    """Each cell's newest value; of equal timestamps the largest value. Combined before the shuffle."""
    return table.groupBy(*CELL).agg(F.max(F.struct("ts", "value")).alias("v")).select(*CELL, "v.ts", "v.value")


def get(table: DataFrame, row_key: str) -> DataFrame:
    return latest(table.where(F.col("row_key") == row_key))


def scan(table: DataFrame, start: str | None = None, stop: str | None = None) -> DataFrame:
    """Rows from ``start`` (inclusive) to ``stop`` (exclusive), newest cells. The range reaches the scan of a stored table."""
    if start is not None:
        table = table.where(F.col("row_key") >= start)
    if stop is not None:
        table = table.where(F.col("row_key") < stop)
    return latest(table)


def pivoted(table: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per key with the named cells as columns ``family_qualifier``."""
    picks = [F.max(F.when((F.col("family") == f) & (F.col("qualifier") == q), F.col("value"))).alias(f"{f}_{q}") for f, q in columns]
    return latest(table).groupBy("row_key").agg(*picks)
