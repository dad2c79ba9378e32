"""Long stretches of text that stand character by character in other documents too: level-wise doubling.

A window of ``length`` characters is looked for at a quarter, half and full length. At the shorter lengths
each full window is represented by one of its short windows, the one of lowest hash, which is the same in
every document that holds the full window, so that about one short window in a hundred has to be kept.
Full windows whose representative occurs in one document only are given up; those whose representative is
repeated are extended to twice its length and tested again. At full length the stretches of text around each
repeated representative meet, and their windows are compared. Exact copies of a whole text are recognised first
and stand in for each other.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.windows import PRIME, SLICE_CHARS, Hasher, PrimeHasher, lowest, slices
from quern.staging import BROADCAST_BYTES, broadcast_if_small, measured, stage

#: characters of the stretches that one task compares at once; representatives with more of them are hot
HOT_CHARS = 1 << 23
CHUNK_CHARS = 1 << 21


def _lengths(length: int) -> list[int]:
    return sorted({max(1, -(-length // 4)), max(1, -(-length // 2)), length})


def _hot_rows(length: int) -> int:
    """From how many rows on a hash is hot; a stretch has about one and a half times ``length`` characters."""
    return max(2, HOT_CHARS // (2 * length))


def _runs(of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal ``of`` at consecutive ``at``."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.flatnonzero((np.diff(of) != 0) | (np.diff(at) != 1)) + 1
    return np.concatenate(([0], new)), np.concatenate((new - 1, [len(at) - 1]))


def _open_windows(batches: Iterable[pa.RecordBatch], length: int, ranged: bool, hot: bool = False):
    """For slices of texts: ``(ids, first row, starts, code points, base, row of each window, places of the open windows)``. With
    ``ranged`` only windows that begin in one of the document's ranges are open, with ``hot`` only in one marked so."""
    for batch in batches:
        for a, starts, codes, base in slices(batch.column(1), length - 1):
            if len(codes) < length:
                continue
            n = len(starts) - 1
            rows = np.repeat(np.arange(n), np.diff(starts))[: len(codes) - length + 1]
            open_ = np.arange(len(rows)) + length <= starts[rows + 1]
            if ranged:
                first, last, marks = (batch.column(c).slice(a, n) for c in (2, 3, 4))
                shift = np.repeat(starts[:-1], first.value_lengths().to_numpy())
                ends = [np.clip(x.flatten().to_numpy() + k - base, 0, len(codes)) + shift for x, k in ((first, 0), (last, 1))]
                if hot:
                    marked = marks.flatten().to_numpy(zero_copy_only=False)
                    ends = [x[marked] for x in ends]
                open_ &= _covered(*ends, len(codes))[: len(rows)]
            at = np.flatnonzero(open_)
            if len(at):
                yield batch.column(0), a, starts, codes, base, rows, at


def _anchors(batches: Iterable[pa.RecordBatch], length: int, short: int, ranged: bool) -> Iterator[pa.RecordBatch]:
    """``(h, doc, first, last)``: the short windows that represent the full windows starting at first..last."""
    hasher = Hasher()
    for ids, a, starts, codes, base, rows, at in _open_windows(batches, length, ranged):
        hashes = hasher.windows(hasher.prefix(codes), short)
        # one run: neighbouring windows of the same representative; the last windows of a text are not
        # open, so no run crosses texts
        chosen = lowest(hashes, length - short + 1)[at]
        i, j = _runs(chosen, at)
        row = rows[at[i]]
        begin = starts[row] - base
        columns = {"h": pa.array(hashes[chosen[i]].view(np.int64)), "doc": ids.take(pa.array(row + a)), "first": pa.array((at[i] - begin).astype(np.int32)), "last": pa.array((at[j] - begin).astype(np.int32))}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _single_windows(batches: Iterable[pa.RecordBatch], length: int, ranged: bool, bases: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """``(h, g, doc, first)``: every open window (with ranges: of the hot ones) with two hashes modulo a prime."""
    one, other = map(PrimeHasher, bases)
    for ids, a, starts, codes, base, rows, at in _open_windows(batches, length, ranged, ranged):
        row = rows[at]
        columns = {"h": pa.array(one.windows(codes, length)[at].view(np.int64)), "g": pa.array(other.windows(codes, length)[at].view(np.int64)), "doc": ids.take(pa.array(row + a)), "first": pa.array((at - starts[row] + base).astype(np.int32))}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _stretches(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """``(h, doc, first, text)``: the text of the full windows of each run that is not hot."""
    for batch in batches:
        for i, (text, first, last, hot, h) in enumerate(zip(*(batch.column(c) for c in range(1, 6)))):
            runs = [(k, a, b) for k, a, b, x in zip(h.as_py(), first.as_py(), last.as_py(), hot.as_py()) if not x]
            if runs:
                text, doc = text.as_py(), batch.column(0).slice(i, 1)
                columns = [pa.array([k for k, *_ in runs], pa.int64()), doc.take(pa.array([0] * len(runs))), pa.array([a for _, a, _ in runs], pa.int32()), pa.array([text[a : b + length] for _, a, b in runs], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "doc", "first", "text"])


def _codes(texts: list[str]) -> np.ndarray:
    data = "".join(texts)
    return np.frombuffer(data.encode("ascii"), np.uint8) if data.isascii() else np.frombuffer(data.encode("utf-32-le"), np.uint32)


def _shared_in(stretches: pa.Table, length: int, hashers: tuple[PrimeHasher, PrimeHasher]) -> pa.RecordBatch | None:
    """``(doc, first, last)`` of the runs of windows that two documents of these stretches share."""
    texts = stretches["text"].to_pylist()
    ids = pa.concat_arrays(stretches["doc"].chunks)
    of_doc = ids.dictionary_encode().indices.to_numpy()
    first = stretches["first"].to_numpy()
    counts = np.array([len(t) - length + 1 for t in texts], np.int64)
    which, hashes, a = [], ([], []), 0
    sizes = np.cumsum(counts + length - 1)
    while a < len(texts):  # a slice of about SLICE_CHARS characters at a time
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + SLICE_CHARS, side="right")))
        codes = _codes(texts[a:b])
        own = np.repeat(np.arange(a, b), counts[a:b] + length - 1)
        place = np.arange(len(codes)) - np.repeat(sizes[a:b] - counts[a:b] - length + 1 - (sizes[a - 1] if a else 0), counts[a:b] + length - 1)
        valid = np.flatnonzero(place < counts[own])
        which.append(np.column_stack([own[valid], place[valid]]))
        for hasher, into in zip(hashers, hashes):
            into.append(hasher.windows(codes, length)[valid])
        a = b
    which, (h, g) = np.concatenate(which), map(np.concatenate, hashes)
    order = np.lexsort((g, h))
    new = np.flatnonzero(np.r_[True, (np.diff(h[order]) != 0) | (np.diff(g[order]) != 0)])
    docs = of_doc[which[order, 0]]
    several = np.minimum.reduceat(docs, new) != np.maximum.reduceat(docs, new)
    marked = np.zeros(len(order), bool)
    marked[order] = np.repeat(several, np.diff(np.r_[new, len(order)]))
    own, place = which[marked].T
    if not len(own):
        return None
    i, j = _runs(own, place)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(own[i])), pa.array((first[own[i]] + place[i]).astype(np.int32)), pa.array((first[own[i]] + place[j]).astype(np.int32))], names=["doc", "first", "last"])


def _compared(batches: Iterable[pa.RecordBatch], length: int, bases: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The stretches come sorted by representative; about CHUNK_CHARS characters of whole groups are compared at once."""
    hashers = tuple(map(PrimeHasher, bases))
    waiting: list[pa.RecordBatch] = []
    chars = 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            chars += batch.column(3).nbytes
        if chars > CHUNK_CHARS:
            table = pa.Table.from_batches(waiting)
            h = table["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last group may go on in the next batch
            if cut and (found := _shared_in(table.slice(0, cut), length, hashers)):
                yield found
            waiting = table.slice(cut).combine_chunks().to_batches()
            chars = 0 if cut else chars  # a group that is not whole waits on
    if waiting and (found := _shared_in(pa.Table.from_batches(waiting), length, hashers)):
        yield found


def _covered(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of 0..n lie in one of the ranges ``[begin, end)``."""
    edges = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(edges) > 0


def _repeated(found: DataFrame, hashes: list[str], most: int) -> DataFrame:
    """The rows whose hashes stand in more than one document; ``hot`` where more than ``most`` rows share them. Such keys
    are few, by count, and joined by broadcast, so that no task gets all rows of one."""
    groups = found.groupBy(*hashes).agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count(F.lit(1)).alias("n"))
    keys = stage(groups.where("a <> b").select(*hashes, (F.col("n") > most).alias("hot")), "repeated").frame
    size, hot = measured(keys)[1], keys.where("hot")
    if size <= BROADCAST_BYTES or not hot.head(1):
        return found.join(broadcast_if_small(keys, BROADCAST_BYTES, size), hashes)
    near = broadcast_if_small(hot, BROADCAST_BYTES)
    return found.join(near, hashes).unionByName(found.join(near, hashes, "left_anti").join(keys.where("NOT hot").hint("merge"), hashes))


def shared_spans(df: DataFrame, doc: str = "doc_id", text: str = "text", length: int = 300) -> DataFrame:
    """``(doc, span_start, span_end)``: for each document, the merged windows of ``length`` code points that stand
    in another document too; start from 0, end after the last character; overlapping or touching windows are one span.

    A document is a value of ``doc``; rows with a null id are left out; a null or short text has no window;
    a row repeated under the same id is no other document. An empty table gives no rows. Extra columns are
    ignored. Windows of full length are compared by two hashes of their code points modulo 2**61 - 1, at bases drawn
    at random for the run: two different windows are taken for equal with a probability of at most (length / 2**61) ** 2.

    What is shuffled are stretches of text, one for each run of windows with the same representative. Where too many share
    a representative for one task, its windows are counted one by one, combined before the shuffle.
    """
    docs = df.where(F.col(f"`{doc}`").isNotNull() & (F.length(f"`{text}`") >= length)).select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["doc"].dataType
    h, g, where = T.StructField("h", T.LongType()), T.StructField("g", T.LongType()), T.StructField("doc", kind)
    first, last = T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())
    bases = tuple(2 + secrets.randbelow(PRIME - 3) for _ in range(2))
    most = _hot_rows(length)

    marks = docs.select("doc", F.unhex(F.md5("text")).alias("m"), F.length("text").alias("chars"))
    classes = marks.groupBy("m", "chars").agg(F.min("doc").alias("one"), F.max("doc").alias("other")).where("one <> other")
    classes = stage(classes, "copy-classes").frame
    copies = marks.alias("d").join(broadcast_if_small(classes, BROADCAST_BYTES).alias("c"), ["m", "chars"]).select("d.doc", "one", F.col("chars").alias("span_end")).distinct()
    copies = stage(copies, "copies").frame
    again = copies.where("doc <> one").select(F.col("doc").alias("drop"))
    single = docs.join(broadcast_if_small(again, BROADCAST_BYTES), F.col("doc") == F.col("drop"), "left_anti")

    source, kept, some_hot = single, None, True
    for short in _lengths(length)[:-1]:
        found = stage(source.mapInArrow(lambda batches, s=short, r=kept is not None: _anchors(batches, length, s, r), T.StructType([h, where, first, last])), f"windows-{short}")
        if kept:
            kept.drop()
        per_doc = _repeated(found.frame, ["h"], most).groupBy("doc").agg(F.collect_list(F.struct("first", "last", "hot", "h")).alias("r"))
        kept = stage(per_doc.select(F.col("doc").alias("of"), "r.first", "r.last", "r.hot", "r.h"), f"open-{short}")
        found.drop()
        source = single.join(broadcast_if_small(kept.frame, BROADCAST_BYTES), F.col("doc") == F.col("of")).select("doc", "text", "first", "last", "hot", "h")
    runs = None
    if kept:
        some_hot = bool(kept.frame.where(F.exists("hot", lambda x: x)).head(1))
        pieces = source.mapInArrow(lambda batches: _stretches(batches, length), T.StructType([h, where, first, T.StructField("text", T.StringType())]))
        runs = pieces.repartition("h").sortWithinPartitions("h").mapInArrow(lambda batches: _compared(batches, length, bases), T.StructType([where, first, last]))
    if some_hot:  # without a shorter level nothing is known of any window
        found = stage(source.mapInArrow(lambda batches, r=kept is not None: _single_windows(batches, length, r, bases), T.StructType([h, g, where, first])), "windows")
        single_runs = _repeated(found.frame, ["h", "g"], most).select("doc", "first", F.col("first").alias("last")).distinct()
        runs = single_runs if runs is None else runs.unionByName(single_runs)
    back = Window.partitionBy("doc").orderBy("first", "last")
    upto = F.max("last").over(back.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("jump", F.coalesce((F.col("first") > upto + length).cast("int"), F.lit(1))).withColumn("i", F.sum("jump").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc", "i").agg(F.min("first").cast("bigint").alias("span_start"), (F.max("last") + length).cast("bigint").alias("span_end"))
    whole = copies.select("doc", F.lit(0).cast("bigint").alias("span_start"), F.col("span_end").cast("bigint").alias("span_end"))
    mine = broadcast_if_small(copies.select(F.col("doc").alias("drop")), BROADCAST_BYTES)
    merged = merged.join(mine, F.col("doc") == F.col("drop"), "left_anti").select("doc", "span_start", "span_end")
    return merged.unionByName(whole).withColumnRenamed("doc", doc)


def shared_amounts(df: DataFrame, spans: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``n_spans``, ``shared_chars`` and ``shared_share`` of its characters (0 without spans or text)."""
    sums = spans.groupBy(F.col(doc).alias("__of")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("span_end") - F.col("span_start")).alias("c"))
    chars = F.coalesce(F.length(f"`{text}`"), F.lit(0))
    base = df.where(F.col(f"`{doc}`").isNotNull()).groupBy(F.col(f"`{doc}`").alias(doc)).agg(F.max(chars).cast("bigint").alias("n_chars"))
    joined = base.join(sums, F.col(doc) == F.col("__of"), "left")
    shared = F.coalesce("c", F.lit(0))
    return joined.select(doc, "n_chars", F.coalesce("n", F.lit(0)).alias("n_spans"), shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("shared_share"))
