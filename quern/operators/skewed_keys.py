"""Per-key results when a few keys hold most rows: exact offset chunking.

Rows are counted per (input partition, key); prefix sums over the partitions turn the counts into the
offset at which each partition's rows of a key begin; every row then has an exact position inside its
key, with no shuffle of rows. Positions are cut into equal chunks, chunks are aggregated on their own
(partially inside the input partition, before anything is shuffled), and the chunk states, which know their
boundaries, are merged per key. No task ever holds more of one key than one chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.columns import col, unused
from quern.staging import BROADCAST_BYTES, broadcast_if_small, measured, stage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row's number in its low 33 bits
_HALF = (1 << 32) - 1


def _plain_keys(df: DataFrame, keys: Sequence[str]) -> list[str]:
    missing = [k for k in keys if k not in df.columns]
    if missing or not keys:
        raise ValueError(f"keys not in the table: {missing or 'none given'}")
    return list(keys)


@dataclass
class _Numbered:
    """Rows in partition order with their number (``mid``: partition above, row below), and per (partition, key) where
    the key starts in the partition and how many rows of it earlier partitions hold."""

    rows: DataFrame
    offsets: DataFrame
    offset_bytes: int
    mid: str
    pid: str
    keys: list[str]
    start: str
    offset: str

    @property
    def partition(self) -> Column:
        return F.shiftright(self.mid, _ROW_BITS)

    @property
    def index(self) -> Column:
        return F.col(self.mid).bitwiseAND((1 << _ROW_BITS) - 1)

    @property
    def shift(self) -> Column:
        """What to add to a row's number in its partition to get its position in its key."""
        return F.coalesce(F.col(self.offset), F.lit(0)) - F.coalesce(F.col(self.start), F.lit(0))


def _number(df: DataFrame, keys: list[str], pin: bool) -> _Numbered:
    mid, p, n = unused(df, "__mid"), unused(df, "__pid"), unused(df, "__n")
    offset, start = unused(df, "__offset"), unused(df, "__start")
    ks = [unused(df, f"__k{i}") for i in range(len(keys))]
    named = [col(k).alias(a) for k, a in zip(keys, ks)]
    rows = df.sortWithinPartitions(*[col(k) for k in keys]).withColumn(mid, F.monotonically_increasing_id())
    if pin:
        rows = stage(rows, "numbered").frame
        counted = rows.select(F.shiftright(mid, _ROW_BITS).alias(p), *named)
    else:
        counted = df.select(F.spark_partition_id().cast("long").alias(p), *named)
    counts = stage(counted.groupBy(p, *ks).agg(F.count(F.lit(1)).alias(n)), "offsets")
    before = (Window.unboundedPreceding, -1)
    offsets = counts.frame.select(
        p,
        *ks,
        F.coalesce(F.sum(n).over(Window.partitionBy(*ks).orderBy(p).rowsBetween(*before)), F.lit(0)).alias(offset),
        F.coalesce(F.sum(n).over(Window.partitionBy(p).orderBy(*ks).rowsBetween(*before)), F.lit(0)).alias(start),
    )
    held, size = measured(counts.frame)
    return _Numbered(rows, offsets, size + 8 * held, mid, p, ks, start, offset)


def _at(partition: Column, keys: Sequence[Column], numbered: _Numbered) -> Column:
    on = partition == F.col(numbered.pid)
    for key, k in zip(keys, numbered.keys):
        on = on & key.eqNullSafe(F.col(k))
    return on


def number_rows(df: DataFrame, keys: Sequence[str], position: str = "position", pin: bool = True) -> DataFrame:
    """Add ``position``: 0, 1, 2 ... within each key, without moving rows between partitions.

    Null is a key value like any other; repeated rows get positions of their own; an empty table stays
    empty; all other columns pass through, and a column that is already named ``position`` makes the new one
    ``position_``. Which row of a key gets which position follows the input's partitions. ``pin`` writes the
    partition-sorted rows to the shared folder first, so that counting and numbering see the same partitions
    even if a scan were split anew after an executor's loss; without it positions are exact as long as both
    scans are split alike.

    The offsets, one row per (input partition, key), are broadcast behind a check of their size; beyond it the join
    shuffles on (partition, key), of which no group is larger than one input partition.
    """
    keys = _plain_keys(df, keys)
    x = _number(df, keys, pin)
    offsets = broadcast_if_small(x.offsets, size=x.offset_bytes)
    joined = x.rows.join(offsets, _at(x.partition, [col(k) for k in keys], x), "left")
    return joined.select(*[col(c) for c in df.columns], (x.index + x.shift).alias(unused(df, position)))


def _scans_files_only(df: DataFrame) -> bool:
    """Whether the partitions of ``df`` are those of a file scan, whichever columns are read."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "FileScan" in plan and not any(x in plan for x in ("Exchange", "ExistingRDD", "LocalTableScan", "Union", "Coalesce"))


def chunked_stats(df: DataFrame, keys: Sequence[str], value: str, distinct: str, chunk_rows: int = 100_000, max_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """Per key: ``n_rows``, ``sum_<value>``, ``n_<distinct>``, ``n_chunks`` and ``contiguous``, by exact offset chunking.

    ``value`` is an integer column, its sum an exact decimal(38,0) (null when every value is null, as in
    SQL); ``distinct`` counts different non-null values as written. Null keys form a group of their own.
    An empty table gives no rows. Extra columns are ignored, whatever their names.

    While the offsets fit into ``max_broadcast`` every row gets its position and chunks are cut at exact multiples of
    ``chunk_rows``. Beyond it no row is joined or shuffled either: rows are aggregated by blocks of ``chunk_rows`` rows
    of their partition first, the blocks' states get their positions, and a block belongs to the chunk in which it
    begins, so that a chunk has at most twice ``chunk_rows`` rows.

    ``n_chunks`` is how many chunks the key's positions take, the same on either way.

    A chunk's sum is kept as two longs (high and low halves of the values), which cannot overflow in a
    chunk and need no decimals per row. The chunk states carry their first and last position; merging them
    checks that they fill the key's positions without a gap, ``contiguous``; where they do not, ``n_rows`` is an error.
    """
    keys = _plain_keys(df, keys)
    k = [f"k{i}" for i in range(len(keys))]
    slim = df.select(*[col(c).alias(n) for c, n in zip(keys, k)], col(value).cast("long").alias("v"), col(distinct).alias("d"))
    # a file scan is read twice; the partitions of anything else are written first, so that both passes see the same
    x = _number(slim, k, pin=not _scans_files_only(slim))
    state = {
        "n": F.count(F.lit(1)),
        "nv": F.count("v"),
        "hi": F.sum(F.shiftright("v", 32)),
        "lo": F.sum(F.col("v").bitwiseAND(_HALF)),
    }
    if x.offset_bytes <= max_broadcast:
        placed = x.rows.join(F.broadcast(x.offsets), _at(x.partition, [F.col(c) for c in k], x), "left").withColumn("at", x.index + x.shift)
        pieces = placed.groupBy(*k, F.floor(F.col("at") / chunk_rows).alias("chunk"), "d").agg(*[c.alias(n) for n, c in state.items()], F.min("at").alias("first"), F.max("at").alias("last"))
    else:
        blocks = x.rows.groupBy(x.partition.alias("of"), *k, F.floor(x.index / chunk_rows).alias("block"), "d").agg(*[c.alias(n) for n, c in state.items()], F.min(x.index).alias("first"), F.max(x.index).alias("last"))
        blocks = blocks.join(x.offsets, _at(F.col("of"), [F.col(c) for c in k], x), "left").withColumn("shift", x.shift)
        begin = F.min("first").over(Window.partitionBy("of", *k, "block")) + F.col("shift")
        pieces = blocks.withColumn("chunk", F.floor(begin / chunk_rows)).groupBy(*k, "chunk", "d").agg(
            *[F.sum(n).alias(n) for n in state], F.min(F.col("first") + F.col("shift")).alias("first"), F.max(F.col("last") + F.col("shift")).alias("last")
        )
    wide = T.DecimalType(38, 0)
    total = F.sum(F.col("hi").cast(wide) * F.lit(1 << 32).cast(T.DecimalType(11, 0)) + F.col("lo").cast(wide))
    # one row per (key, chunk, distinct value) remains
    pieces = stage(pieces, "chunks")
    chunks = pieces.frame.groupBy(*k, "chunk").agg(
        F.sum("n").alias("n"),
        F.sum("nv").alias("nv"),
        total.cast(wide).alias("s"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    # a chunk's positions must follow one another, and so must the chunks: the states merge as plain aggregates, so
    # that a key of very many chunks is never held as a list
    merged = chunks.groupBy(*k).agg(
        F.sum("n").alias("n_rows"),
        F.when(F.sum("nv") > 0, F.sum("s")).cast(wide).alias("total"),
        F.ceil(F.sum("n") / chunk_rows).alias("n_chunks"),
        (F.bool_and(F.col("last") - F.col("first") + 1 == F.col("n")) & (F.min("first") == 0) & (F.max("last") + 1 == F.sum("n"))).alias("contiguous"),
    )
    values = pieces.frame.where("d IS NOT NULL").select(*k, "d").distinct().groupBy(*k).agg(F.count(F.lit(1)).alias("nd"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in k]
    return (
        merged.alias("a")
        .join(values.alias("b"), same, "left")
        .select(
            *[F.col(f"a.{n}").alias(c) for n, c in zip(k, keys)],
            F.when(F.col("contiguous"), F.col("n_rows")).otherwise(F.raise_error(F.lit("the chunks of a key leave a gap"))).alias("n_rows"),
            F.col("total").alias(f"sum_{value}"),
            F.coalesce("nd", F.lit(0)).alias(f"n_{distinct}"),
            "n_chunks",
            "contiguous",
        )
    )


def heavy_keys(stats: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """Of :func:`chunked_stats`, the keys with no null or blank part that hold ``share`` of all rows or more."""
    sound = F.lit(True)
    for key in keys:
        sound = sound & (F.length(F.trim(col(key))) > 0)
    everything = stats.agg(F.sum("n_rows")).scalar()
    return stats.where(sound & (F.col("n_rows") >= F.lit(share) * everything)).select(*[col(k) for k in keys])
