"""Filling containers of fixed capacity with texts: best-two-fit over the histogram of sizes.

Which texts of equal size go where makes no difference to the unused space, so the packing is worked out on
the histogram of sizes, at most ``capacity`` numbers however many texts there are: a container is filled greedily,
largest size first; then its smallest text gives way to two unpacked texts that fill the enlarged gap
more tightly, if there are any. The same filling is repeated as often as the histogram allows. Texts of each
size are then numbered, in chunks, and take the places of their size in that order.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.staging import broadcast_if_small, measured, stage

#: fixed value: what counts as white space, as in Python's str.isspace
_SPACE = r"\t\n\x0B\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]+"


def count_tokens(text: Column) -> Column:
    """Runs of word characters and runs of characters that are neither word characters nor white space. Null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


#: fixed value: how the public byte-level vocabularies cut a text before merging
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the size histogram, the plan and its places are held by the driver: as many numbers as a container has tokens
MOST_CAPACITY = 1 << 20


def count_pieces(path: str, pattern: str = BYTE_PATTERN):
    """A column function that counts the tokens of a public byte-level vocabulary, in Arrow batches. The ranks file lies at
    ``path`` on every executor; it is read once per Python worker and never copied."""
    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        encode = _encoder(path, pattern)
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return counted


def _encoder(path: str, pattern: str, cache: dict = {}):  # noqa: B006 - one encoder per worker process
    if (path, pattern) not in cache:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return cache[path, pattern]


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """``[(how many containers, sizes in each)]`` for ``counts`` texts of each size 1..capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        if not 0 < size <= capacity:
            raise ValueError(f"size {size} does not fit into {capacity}")
        left[size] = n
    plan = []
    while left.any():
        bin_, gap = [], capacity
        while gap and len(fits := np.flatnonzero(left[: gap + 1])):
            size = int(fits[-1])
            take = int(min(left[size], gap // size))
            left[size] -= take
            bin_ += [size] * take
            gap -= size * take
        if gap and (two := _closest_two(left, gap + bin_[-1], bin_[-1])):
            left[bin_.pop()] += 1
            for size in two:
                left[size] -= 1
                bin_.append(size)
        used = Counter(bin_)
        # the same filling again, as long as every choice would be the same
        more = int(min(left[size] // n for size, n in used.items()))
        for size, n in used.items():
            left[size] -= more * n
        plan.append((1 + more, bin_))
    return plan


def _closest_two(left: np.ndarray, gap: int, than: int) -> tuple[int, int] | None:
    """Two unpacked sizes whose sum is at most ``gap``, as large as can be and larger than ``than``."""
    sizes = np.flatnonzero(left[: gap + 1])
    if not len(sizes):
        return None
    partner = np.searchsorted(sizes, gap - sizes, side="right") - 1  # the largest that still fits beside
    own = np.arange(len(sizes))
    partner = np.where((partner == own) & (left[sizes] < 2), partner - 1, partner)
    total = np.where(partner >= 0, sizes + sizes[np.maximum(partner, 0)], 0)
    best = int(total.argmax())
    return (int(sizes[best]), int(sizes[partner[best]])) if total[best] > than else None


def _numbered(df: DataFrame, by: str, order: list[str], chunk_rows: int) -> DataFrame:
    """Add ``nth``: 0, 1, 2 ... within each ``by``. Rows of one value are spread over chunks by the hash of ``order``,
    which must tell rows apart; counts per chunk, summed up, give each chunk its offset, so that no task sorts more than a chunk."""
    chunks = max(1, -(-df.count() // chunk_rows))
    cut = df.withColumn("chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    counts = stage(cut.groupBy(by, "chunk").agg(F.count(F.lit(1)).alias("n")), "chunk-counts")
    upto = Window.partitionBy(by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.frame.select(by, "chunk", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    ranked = cut.withColumn("r", F.row_number().over(Window.partitionBy(by, "chunk").orderBy(*order)) - 1)
    return ranked.join(broadcast_if_small(offsets, size=measured(counts.frame)[1]), [by, "chunk"]).withColumn("nth", F.col("offset") + F.col("r")).drop("chunk", "offset", "r")


def pack(df: DataFrame, doc: str = "doc_id", size: Column | None = None, capacity: int = 1024, text: str = "text", chunk_rows: int = 1_000_000) -> DataFrame:
    """``(doc, piece, n_pieces, first_token, n_tokens, container)``: one row per document, or per piece of a document larger than ``capacity``.

    A larger document is cut every ``capacity`` tokens: full pieces have containers of their own, the rest is packed
    like a document of its size. No container exceeds ``capacity``. Documents without tokens (null or empty) take no
    space and are spread over the containers. A ``capacity`` beyond MOST_CAPACITY is an error. Every row comes out, repeated and null ids too; an empty table gives no
    rows; extra columns are ignored.
    """
    if not 0 < capacity <= MOST_CAPACITY:
        raise ValueError(f"a capacity lies between 1 and {MOST_CAPACITY}")
    tokens = (count_tokens(F.col(f"`{text}`")) if size is None else size).cast("bigint")
    # the row's number tells repeated and null ids apart; it is written with the sizes, so it never changes
    sized = stage(df.select(F.col(f"`{doc}`").alias("doc"), tokens.alias("t"), F.monotonically_increasing_id().alias("row")), "sizes")
    full = F.floor(F.col("t") / capacity)
    rest = F.col("t") - full * capacity
    pieces = F.when(F.col("t") <= capacity, F.lit(1)).otherwise(full + (rest > 0).cast("bigint"))
    items = sized.frame.select("doc", "row", "t", pieces.cast("bigint").alias("n_pieces"), F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)).alias("piece"))
    items = items.select("doc", "row", "piece", "n_pieces", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("t") - F.col("piece") * capacity).cast("int").alias("n_tokens"))

    counts = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    counts.pop(0, None)
    places, base = [], 0
    taken: Counter = Counter()
    for many, sizes in best_two_fit(counts, capacity):
        for s, each in Counter(sizes).items():
            places.append((s, taken[s], taken[s] + many * each, each, base))
            taken[s] += many * each
        base += many
    schema = T.StructType([T.StructField(n, T.IntegerType() if n == "size" else T.LongType()) for n in ("size", "lo", "hi", "each", "base")])
    # as many rows as different fillings and sizes in them: bounded by the capacity, whatever the number of texts
    slots = broadcast_if_small(df.sparkSession.createDataFrame(places, schema), size=8 * 7 * len(places))
    nth = stage(_numbered(items, "n_tokens", ["row", "piece"], chunk_rows), "numbered")
    there = (F.col("n_tokens") == F.col("size")) & (F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi"))
    container = F.when(F.col("n_tokens") == 0, F.pmod("nth", F.lit(max(1, base)))).otherwise(F.col("base") + F.floor((F.col("nth") - F.col("lo")) / F.col("each")))
    out = nth.frame.join(slots, there, "left")
    return out.select(F.col("doc").alias(doc), "piece", "n_pieces", "first_token", F.col("n_tokens").cast("bigint").alias("n_tokens"), container.cast("bigint").alias("container"))


def fill_report(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: containers, tokens, unused tokens and the share of space in use."""
    return packed.agg(F.countDistinct("container").alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")).select(
        "n_containers",
        "n_tokens",
        (F.col("n_containers") * capacity - F.col("n_tokens")).alias("unused_tokens"),
        F.when(F.col("n_containers") > 0, F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("fill"),
    )
