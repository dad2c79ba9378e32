"""The forms a user-defined function can take. Built-in expressions are preferred; these are for the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shout(text: str | None) -> str | None:
    return None if text is None else text.upper() + "!"


def register(spark: SparkSession) -> None:
    """Make ``shout`` and ``plus_tenth`` callable in SQL."""
    spark.udf.register("shout", shout, "string")
    spark.udf.register("plus_tenth", plus_tenth())


def plus_tenth():
    @F.pandas_udf("double")
    def plus(values: pd.Series) -> pd.Series:
        return values * 1.1

    return plus


def name_parts():
    """A vectorized function that returns a struct."""

    @F.pandas_udf("head string, length bigint")
    def parts(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"head": names.str.slice(0, 1), "length": names.str.len()})

    return parts


def spread():
    """A vectorized aggregate: highest minus lowest value of a group."""

    @F.pandas_udf("double")
    def span(values: pd.Series) -> float:
        return float(values.max() - values.min())

    return span


def word_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """A table function over partitions: one row per word, batch by batch."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(word=b[text].str.split(" ")).explode("word")[[key, "word"]]

    return df.select(key, text).mapInPandas(split, f"{key} {dict(df.dtypes)[key]}, word string")


def upto():
    """A table function: 0, 1 ... n - 1."""

    @F.udtf(returnType="i bigint")
    class Upto:
        def eval(self, n: int):
            for i in range(n or 0):
                yield (i,)

    return Upto
