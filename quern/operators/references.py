"""References to records that do not exist: Bloom filter first, exact join for the rest.

The parent keys fill a blocked Bloom filter of fixed size: block = hash(key), then a few bits inside the
block. A child key that misses a bit refers to nothing at all: a definite orphan. Only keys that pass are
verified, by an exact join that also looks at the parent's lifetimes. Everything runs on JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.columns import col, unused
from quern.staging import BROADCAST_BYTES, measured, stage

BLOCK_WORDS = 512  # of 64 bits: 4 KiB a block
BITS_PER_KEY = 12
PROBES = 6


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(blocks))


def _bit(key: Column, probe: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(101 + probe)), F.lit(BLOCK_WORDS * 64))


def bloom_blocks(keys: DataFrame, key: str, max_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, int]:
    """``(block, words array<bigint>)`` over the distinct non-null ``key`` and the number of blocks.

    At most ``max_bytes`` large however many keys there are: beyond that the false-positive rate rises,
    and with it only the number of keys that the exact join has to verify.
    """
    distinct = keys.where(col(key).isNotNull()).select(col(key).cast("long").alias("k")).distinct()
    held = distinct.count()
    size = BLOCK_WORDS * 64
    blocks = max(1, min(-(-held * BITS_PER_KEY // size), max_bytes // (BLOCK_WORDS * 8)))
    k = F.col("k")
    bits = distinct.select(_block(k, blocks).alias("block"), F.explode(F.array(*[_bit(k, i) for i in range(PROBES)])).alias("bit"))
    words = bits.groupBy("block", F.floor(F.col("bit") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    packed = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return packed.select("block", dense.alias("words")), blocks


def might_exist(key: Column, words: Column) -> Column:
    """False if no parent has ``key`` (definite), true if one may."""
    test = words.isNotNull()
    for i in range(PROBES):
        bit = _bit(key, i)
        word = F.get(words, F.floor(bit / 64).cast("int"))
        test = test & (F.expr("1L") == F.getbit(word, (bit % 64).cast("int")).cast("long"))
    return F.coalesce(test, F.lit(False))


def _lifetimes(parents: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """The different lifetimes of each non-null key."""
    return parents.where(col(key).isNotNull()).select(col(key).cast("long"), col(since), col(until)).distinct()


def orphans(
    children: DataFrame,
    key: str,
    at: str,
    parents: DataFrame,
    parent_key: str = "id",
    since: str = "created_at",
    until: str = "deleted_at",
    salts: int = 16,
    max_broadcast: int = BROADCAST_BYTES,
) -> DataFrame:
    """The rows of ``children`` whose non-null ``key`` has no parent row alive at ``at``, with ``reason``.

    Alive: ``since <= at`` and (``until`` null or ``at < until``). Reasons: ``missing`` (no row has the id),
    ``not_yet`` (its first lifetime begins later), ``deleted`` (else; also where ``at`` is null).
    Rows with a null key refer to nothing and are left out; repeated rows and extra columns are kept (a column that
    is already named ``reason`` makes the new one ``reason_``); no
    parents makes every reference an orphan; no children gives no rows.

    The parents' lifetimes are broadcast only if their measured size is within ``max_broadcast``; then the children are
    read and probed once. Beyond it they are probed twice, once for the definite orphans, and for the others both sides shuffle on (key, salt), so that a parent with a third of all children spreads over ``salts`` tasks.
    """
    names = [col(c) for c in children.columns]
    n_block, n_words, n_maybe, n_salt, n_asked = (unused(children, x) for x in ("__block", "__words", "__maybe", "__salt", "__asked"))
    n_parent, n_since, n_until, n_id, n_first, n_each = (unused(children, x) for x in ("__parent", "__since", "__until", "__id", "__first", "__each"))
    told = unused(children, "reason")
    blocks, n = bloom_blocks(parents, parent_key, max_broadcast)
    own, when = col(key).cast("long"), col(at)
    filter_ = F.broadcast(blocks.select(F.col("block").alias(n_block), F.col("words").alias(n_words)))
    probed = children.where(own.isNotNull()).join(filter_, _block(own, n) == F.col(n_block), "left")
    probed = probed.withColumn(n_maybe, might_exist(own, F.col(n_words))).drop(n_block, n_words)
    lives = stage(_lifetimes(parents, parent_key, since, until).toDF(n_parent, n_since, n_until), "lifetimes")
    # a definite orphan's key is null in the joins that verify, so that it meets nothing and makes no task hot
    asked = F.when(F.col(n_maybe), own)
    alive = (F.col(n_asked) == F.col(n_parent)) & (F.col(n_since) <= when) & (F.col(n_until).isNull() | (when < F.col(n_until)))
    first = lives.frame.groupBy(F.col(n_parent).alias(n_id)).agg(F.min(n_since).alias(n_first))
    known = F.col(n_asked) == F.col(n_id)
    if measured(lives.frame)[1] <= max_broadcast:
        lost = probed.withColumn(n_asked, asked).join(F.broadcast(lives.frame), alive, "left_anti")
        lost = lost.join(F.broadcast(first), known, "left")
    else:
        # two branches: what needs no check must not be shuffled along
        every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        salted = probed.where(F.col(n_maybe)).withColumn(n_asked, asked).withColumn(n_salt, F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int"))
        lost = salted.join(lives.frame.withColumn(n_each, every), alive & (F.col(n_salt) == F.col(n_each)), "left_anti")
        lost = lost.join(first.withColumn(n_each, every), known & (F.col(n_salt) == F.col(n_each)), "left")
        lost = lost.drop(n_each, n_salt).unionByName(probed.where(~F.col(n_maybe)), allowMissingColumns=True)
    reason = F.when(F.col(n_id).isNull(), "missing").when(when < F.col(n_first), "not_yet").otherwise("deleted")
    return lost.select(*names, reason.alias(told))


def orphan_report(found: DataFrame, table: str, column: str, at: str) -> DataFrame:
    """Orphans per table, column, month of ``at`` and reason."""
    return found.groupBy(
        F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), F.date_format(at, "yyyy-MM").alias("month"), "reason"
    ).agg(F.count(F.lit(1)).alias("n_orphans"))

