"""Recommendations by alternating least squares."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recommend(ratings: DataFrame, user: str, item: str, rating: str, n: int = 2, rank: int = 5, rounds: int = 10, reg: float = 0.1, seed: int = 11) -> DataFrame:
    """``(user, item, score)``: the ``n`` best items of each user. Users and items are whole numbers; null ratings are left out."""
    known = ratings.where(F.col(user).isNotNull() & F.col(item).isNotNull() & F.col(rating).isNotNull()).select(F.col(user).cast("int").alias("u"), F.col(item).cast("int").alias("i"), F.col(rating).cast("float").alias("r"))
    model = ALS(rank=rank, maxIter=rounds, regParam=reg, userCol="u", itemCol="i", ratingCol="r", coldStartStrategy="drop", seed=seed).fit(known)
    rows = model.recommendForAllUsers(n).select("u", F.explode("recommendations").alias("x"))
    return rows.select(F.col("u").alias(user), F.col("x.i").alias(item), F.col("x.rating").alias("score"))
