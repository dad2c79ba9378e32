"""Nearest vectors by cosine: a stated query set, in blocks, against all rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4_096


def nearest(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """``(query, neighbour, cosine)``: the ``k`` rows of highest cosine for each query, other keys only; ties by smaller key.

    Queries are taken in blocks of QUERY_BLOCK; every input batch is multiplied with a block and gives at most ``k`` rows per
    query to the shuffle. Rows with a null key or vector, or a zero vector, are left out; vectors of another length are an error.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    sound = lambda d: d.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    for b in range(blocks):
        rows = sound(queries).where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).select(key, vector).collect()
        part = sound(df).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_matcher(rows, k), "query bigint, neighbour bigint, cosine double")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def _matcher(rows, k: int):
    ids = np.array([r[0] for r in rows], np.int64)
    if not len(ids):
        return lambda batches: iter(())
    wanted = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
    length = np.linalg.norm(wanted, axis=1)
    ids, wanted = ids[length > 0], wanted[length > 0] / length[length > 0, None]

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(ids) or not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            if v.shape[1] != wanted.shape[1]:
                raise ValueError(f"vectors of length {v.shape[1]}, queries of length {wanted.shape[1]}")
            norm = np.linalg.norm(v, axis=1)
            keys, v = keys[norm > 0], v[norm > 0] / norm[norm > 0, None]
            cosine = wanted @ v.T
            cosine[ids[:, None] == keys[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(keys, cosine.shape), -np.round(cosine, 12)), axis=1)[:, :k]
            q = np.repeat(np.arange(len(ids)), order.shape[1])
            n, c = keys[order].ravel(), np.take_along_axis(cosine, order, 1).ravel()
            ok = np.isfinite(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q][ok]), pa.array(n[ok]), pa.array(c[ok])], names=["query", "neighbour", "cosine"])

    return match
