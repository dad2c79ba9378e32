"""Evaluation texts inside a corpus: latent semantic retrieval, then exact and paraphrase checks.

Corpus passages (overlapping windows of words) and evaluation passages are TF-IDF vectors over the words of
the evaluation texts; no other word can add to a product with one of them. Their latent directions come from a
randomised SVD: one distributed pass multiplies the matrix of all corpus passages with a random one (Nystroem
form); the evaluation passages are further rows of the matrix, weighted so that they outweigh the corpus and are
represented well. All corpus passages are projected and compared with every evaluation passage.

Candidates are the pairs of passages whose latent cosine reaches a threshold, a lower one for the check that costs
less. They are then checked: for a common run of ``run`` words, for the longest common subsequence with the item, and for
the answer. Where no common run may be missed at all, a bound takes the place of the threshold: a passage with a run
of an evaluation passage has an inner product with it of at least that run's own energy, and the product is at most the
latent product plus the product of the two residual norms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.tokens import Vocabulary, word_strings
from quern.llm.windows import Hasher
from quern.staging import Staged, measured, stage

#: about how many words are searched at once
SLICE_WORDS = 1 << 16
#: evaluation texts collected and encoded together, by their bytes
ITEM_BYTES = 1 << 26
#: passages of evaluation texts searched at once: their words x (PASSAGES + width) matrix is the driver's
PASSAGES = 512
PAIR_WORDS = 1 << 20
SUM_AT_ONCE = 1024  # partitions whose sums one task adds up
CHUNK = 1024  # passages projected at once
TERM_BLOCK = 256


class Items:
    """A block of evaluation passages of ``span`` words, with the whole texts that they are of; latent data once fitted.
    ``local`` maps the vocabulary's numbers to the block's own, 0 for words that the block has not."""

    def __init__(self, keys: list, words: list[np.ndarray], answers: list[np.ndarray], run: int, size: int, span: int = 64, cut: list[tuple[int, int]] | None = None):
        self.run, self.span = run, span
        cut = self.cuts(words, run, span) if cut is None else cut
        used = sorted({i for i, _ in cut})
        number = {i: k for k, i in enumerate(used)}
        self.keys = [keys[i] for i in used]
        known = np.unique(np.concatenate([np.empty(0, np.int64), *[words[i] for i in used], *[answers[i] for i in used]]))
        known = known[known > 0]
        self.size, self.local = len(known), np.zeros(size + 1, np.int32)
        self.local[known] = np.arange(1, len(known) + 1)
        self.words, self.answers = ([self.local[x[i]].astype(np.int64) for i in used] for x in (words, answers))
        self.passage_item = np.array([number[i] for i, _ in cut], np.int64)
        self.passages = [self.words[number[i]][a : a + span] for i, a in cut]
        grams, owner = [], []
        for i, w in enumerate(self.words):
            if len(w) >= run:
                grams.append(np.lib.stride_tricks.sliding_window_view(w, run))
                owner.append(np.full(len(w) - run + 1, i))
        self.grams = np.concatenate(grams) if grams else np.empty((0, run), np.int64)
        self.gram_item = np.concatenate(owner) if owner else np.empty(0, np.int64)
        hasher = Hasher()
        self.gram_hash = np.array([hasher.windows(hasher.prefix(g), run)[0] for g in self.grams], np.uint64)
        order = np.argsort(self.gram_hash, kind="stable")
        self.grams, self.gram_item, self.gram_hash = self.grams[order], self.gram_item[order], self.gram_hash[order]

    @staticmethod
    def cuts(words: list[np.ndarray], run: int, span: int = 64) -> list[tuple[int, int]]:
        """(text, first word) of every passage; any run of ``run`` words lies in one."""
        return [(i, a) for i, w in enumerate(words) for a in range(0, max(1, len(w) - run + 1), span - run + 1)]

    def fit(self, weight: np.ndarray, basis: np.ndarray) -> None:
        """``weight``: idf per word number; ``basis``: words x rank, orthonormal columns."""
        self.weight = weight
        self.table = (weight[:, None] * basis).astype(np.float32)
        self.latent = np.zeros((len(self.passages), basis.shape[1]), np.float32)
        self.residual, self.least = np.zeros(len(self.passages)), np.full(len(self.passages), np.inf)
        for p, w in enumerate(self.passages):
            if not len(w):
                continue
            self.latent[p] = self.table[w].sum(0)
            t, n = np.unique(w, return_counts=True)
            self.residual[p] = np.sqrt(max(0.0, float(((n * weight[t]) ** 2).sum()) - float((self.latent[p].astype(float) ** 2).sum())))
            for a in range(len(w) - self.run + 1):
                t, n = np.unique(w[a : a + self.run], return_counts=True)
                self.least[p] = min(self.least[p], float(((n * weight[t]) ** 2).sum()))
        self.length = np.sqrt((self.latent.astype(float) ** 2).sum(1))


def _halves(sizes: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut rows of ``sizes`` words into half passages: (row of each half, its first word, whether the next half is of the same row)."""
    n = np.maximum(1, -(-sizes // half))
    n[sizes == 0] = 0
    row = np.repeat(np.arange(len(sizes)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(np.cumsum(sizes) - sizes, n) + nth * half
    more = np.r_[row[1:] == row[:-1], False] if len(row) else np.empty(0, bool)
    return row, begin, more


def _word_slices(batch: pa.RecordBatch, local: np.ndarray, step: int = 1, overlap: int = 0) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(ids, sizes, words, None) of consecutive rows with about SLICE_WORDS words. A longer row comes alone, in pieces of
    SLICE_WORDS words, rounded to a multiple of ``step``, and ``overlap`` more, each with all the row's words behind it."""
    lists = batch.column(1)
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    values = local[lists.flatten().to_numpy()].astype(np.int64)
    most = -(-SLICE_WORDS // step) * step
    a = 0
    while a < len(sizes):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + most, side="right")))
        ids, words = batch.column(0).slice(a, b - a), values[done : ends[b - 1]]
        if len(words) > most:
            for at in range(0, max(1, len(words) - overlap), most):
                piece = words[at : at + most + overlap]
                yield ids, np.array([len(piece)]), piece, words
        else:
            yield ids, sizes[a:b], words, None
        a = b


def _encoded(docs: DataFrame, vocabulary: Vocabulary, kind: T.DataType) -> Staged:
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts, numbers in vocabulary.encode_all(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(numbers))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), lists], names=["doc", "words"])

    return stage(docs.mapInArrow(encode, T.StructType([T.StructField("doc", kind), T.StructField("words", T.ArrayType(T.IntegerType()))])), "words")


def _random(terms: int, width: int) -> np.ndarray:
    return np.random.default_rng(20240607).standard_normal((terms, width)).astype(np.float32)


def _sketch_of(sizes: np.ndarray, words: np.ndarray, passage: int, omega: np.ndarray, df: np.ndarray, z: np.ndarray) -> int:
    """Add the passages of some rows to the document frequencies and to T'T omega; their number."""
    row, begin, _ = _halves(sizes, passage)
    if not len(row):
        return 0
    at = np.repeat(np.arange(len(row)), np.diff(np.r_[begin, len(words)]))
    known = words > 0
    keys, n = np.unique(at[known] * len(df) + words[known], return_counts=True)
    passages, terms = keys // len(df), keys % len(df)
    df += np.bincount(terms, minlength=len(df))
    if not len(keys):
        return len(row)
    counts = n.astype(np.float32)[:, None]
    first = np.flatnonzero(np.r_[True, np.diff(passages) != 0])
    y = np.add.reduceat(omega[terms] * counts, first, axis=0)
    y = y[np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(keys)]))] * counts
    order = np.argsort(terms, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(terms[order]) != 0])
    z[terms[order][first]] += np.add.reduceat(y[order], first, axis=0)
    return len(row)


def _sum_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the float64 vectors of each block as they stream by: memory is that of the blocks, not of the rows."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            vector = np.frombuffer(data.as_buffer(), np.float64)
            sums[block] = sums[block] + vector if block in sums else vector.copy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "data"])


def fit_latent(encoded: DataFrame, items: Items, passage: int, rank: int, width: int) -> None:
    """Document frequencies and the randomised SVD over the passages of all documents and items; fits ``items``.

    With T the passages' word counts and D the idf weights, the SVD is that of X = T D. One pass gives both df
    and Z = T'T O for a random O; X'X (D^-1 O) = D Z, so the weights, known only afterwards, need no second pass.
    The driver gets the words x ``width`` matrix of one block of items and adds the block's passages as rows of the same
    total weight as the corpus: words x (``width`` + PASSAGES), bounded by the block.
    """
    terms = items.size + 1

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega, df, z, total = _random(terms, width), np.zeros(terms, np.int64), np.zeros((terms, width)), 0
        for batch in batches:
            for _, sizes, words, _ in _word_slices(batch, items.local, passage):
                total += _sketch_of(sizes, words, passage, omega, df, z)
        if total:
            df[0] = total
            both = np.column_stack([df.astype(float), z])
            blocks = range(0, terms, TERM_BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([both[a : a + TERM_BLOCK].tobytes() for a in blocks], pa.binary())], names=["block", "data"])

    kind = "block int, data binary"
    summed = encoded.mapInArrow(sketch, kind)
    blocks, sources = -(-terms // TERM_BLOCK), encoded.rdd.getNumPartitions()
    if sources > SUM_AT_ONCE:  # many partitions are added up in groups first
        groups = -(-sources // SUM_AT_ONCE)
        salted = summed.select((F.col("block") * groups + F.pmod(F.spark_partition_id(), F.lit(groups))).alias("block"), "data")
        summed = salted.repartition(blocks * groups, "block").mapInArrow(_sum_blocks, kind).select(F.floor(F.col("block") / groups).cast("int").alias("block"), "data")
    summed = summed.repartition(blocks, "block").mapInArrow(_sum_blocks, kind)
    both = np.zeros((terms, width + 1))
    for r in summed.collect():
        data = np.frombuffer(r["data"], np.float64).reshape(-1, width + 1)
        both[r["block"] * TERM_BLOCK : r["block"] * TERM_BLOCK + len(data)] = data
    df, z = both[:, 0].astype(np.int64), both[:, 1:].copy()
    total, omega = df[0], _random(terms, width)
    df[0] = 0
    for p in items.passages:
        if len(p):
            total += _sketch_of(np.array([len(p)]), p, len(p), omega, df, z)
    weight = np.log1p((1 + total) / (1 + df))
    weight[0] = 0
    y, core = weight[:, None] * z, omega.T.astype(float) @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > max(1e-9 * values.max(initial=0), 1e-12)
    corpus = y @ (vectors[:, keep] / np.sqrt(values[keep]))  # corpus @ corpus.T is about X'X
    own = np.zeros((terms, len(items.passages)))
    for p, words in enumerate(items.passages):
        np.add.at(own[:, p], words, weight[words])
    own *= np.sqrt(max(1.0, np.square(corpus).sum()) / max(1e-9, np.square(own).sum()))
    basis, strength, _ = np.linalg.svd(np.column_stack([corpus, own]), full_matrices=False)
    found = max(1, min(rank, int((strength > 1e-9 * strength.max(initial=0)).sum())))
    items.fit(weight, basis[:, :found])


class _Search:
    """Candidates and checks for slices of encoded documents against one fitted block of items."""

    def __init__(self, items: Items, passage: int, cosine: float | None, lcs: float, run_cosine: float | None = None):
        self.items, self.half, self.cosine, self.lcs, self.run_cosine = items, passage // 2, cosine, lcs, run_cosine
        self.hasher = Hasher()

    def passages(self, sizes: np.ndarray, words: np.ndarray):
        """(row, first word, end) of every passage: two halves each; the next passage begins with the second."""
        row, begin, more = _halves(sizes, self.half)
        first = np.flatnonzero(more | np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
        row, begin = row[first], begin[first]
        return row, begin, np.minimum(begin + 2 * self.half, np.cumsum(sizes)[row])

    def project(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Latent vectors of consecutive passages; each half is projected once."""
        items = self.items
        middle = np.minimum(begin + self.half, end)
        halves = np.unique(np.concatenate([begin, middle]))
        known = words > 0
        upto = np.concatenate(([0], np.cumsum(known)))
        kept = words[known]
        stop = np.minimum(halves + self.half, np.concatenate([halves[1:], [end[-1]]]))
        # a half ends with the passage or where the next begins, so that words between two rows' passages are nobody's
        sums = np.zeros((len(halves), items.table.shape[1]), np.float32)
        full = np.flatnonzero(upto[stop] > upto[halves])
        if len(full):
            a, b = upto[halves[full]], upto[stop[full]]
            gathered = items.table[kept[a[0] : b[-1]]]
            sums[full] = np.add.reduceat(gathered, a - a[0], axis=0)
        latent = sums[np.searchsorted(halves, begin)]
        second = middle < end
        latent[second] += sums[np.searchsorted(halves, middle[second])]
        return latent

    def residual(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray, latent: np.ndarray) -> np.ndarray:
        """The norms of what the projection leaves out."""
        size, long = self.items.size + 1, end - begin
        at = np.arange(long.sum()) + np.repeat(begin - (np.cumsum(long) - long), long)
        w, p = words[at], np.repeat(np.arange(len(begin)), long)
        keys, n = np.unique(p[w > 0] * size + w[w > 0], return_counts=True)
        norm = np.bincount(keys // size, (n * self.items.weight[keys % size]) ** 2, len(begin))
        return np.sqrt(np.maximum(0.0, norm - np.einsum("ij,ij->i", latent, latent, dtype=np.float64)) + 1e-6 * norm)

    def candidates(self, words, begin, end) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What to check: passages x items, whether a common run is looked for, and (passage, evaluation passage, latent
        cosine) of the pairs to be compared by subsequence."""
        items, runs, pairs = self.items, [], []
        length = items.length.astype(np.float32)
        first = np.flatnonzero(np.r_[True, np.diff(items.passage_item) != 0])
        for chunk in np.array_split(np.arange(len(begin)), -(-len(begin) // CHUNK)):
            latent = self.project(words, begin[chunk], end[chunk])
            product = latent @ items.latent.T
            norms = np.maximum(np.sqrt(np.einsum("ij,ij->i", latent, latent))[:, None] * length, 1e-9)
            if self.run_cosine is None:
                rest = self.residual(words, begin[chunk], end[chunk], latent)
                run = product + rest[:, None].astype(np.float32) * items.residual.astype(np.float32) >= (items.least * 0.999).astype(np.float32)
                product /= norms
            else:
                product /= norms
                run = product >= self.run_cosine
            runs.append(run if len(first) == run.shape[1] else np.logical_or.reduceat(run, first, axis=1))
            if self.cosine is not None:
                p, q = np.nonzero(product >= self.cosine)
                pairs.append((chunk[p], q, product[p, q]))
        none = np.empty(0, np.int64)
        return np.concatenate(runs), *(map(np.concatenate, zip(*pairs)) if pairs else (none, none, np.empty(0)))

    def verbatim(self, words, ends, row, begin, candidate) -> set[tuple[int, int]]:
        """(row, item) of the candidates with a common run, by its hash and then by its words."""
        items, run = self.items, self.items.run
        asked = candidate.any(1)
        if not len(items.grams) or len(words) < run or not asked.any():
            return set()
        # windows of known words that begin in a passage with a candidate; one that begins in the second half of a
        # row's last passage lies in that passage
        upto = np.concatenate(([0], np.cumsum(words > 0)))
        starts = np.flatnonzero(upto[run:] - upto[:-run] == run)
        of = np.searchsorted(begin, starts, side="right") - 1
        inside = asked[of] & (starts + run <= ends[row[of]])
        starts, of = starts[inside], of[inside]
        hashes = self.hasher.windows(self.hasher.prefix(words), run)[starts]
        left = np.searchsorted(items.gram_hash, hashes, side="left")
        right = np.searchsorted(items.gram_hash, hashes, side="right")
        found = set()
        for k in np.flatnonzero(left < right):
            for g in range(left[k], right[k]):
                i = int(items.gram_item[g])
                if candidate[of[k], i] and np.array_equal(words[starts[k] : starts[k] + run], items.grams[g]):
                    found.add((int(row[of[k]]), i))
        return found

    def paraphrases(self, words, ends, row, begin, p, q, cosine) -> dict[tuple[int, int], tuple[float, float]]:
        """(row, item) -> (cosine, LCS share) of the candidates with enough words of the item in its order around the passage."""
        items = self.items
        best: dict[tuple[int, int], tuple[float, float]] = {}
        if not len(p):
            return best
        of, starts = items.passage_item[q], np.concatenate(([0], ends[:-1]))
        sizes = np.array([len(w) for w in items.words])
        a = np.maximum(starts[row[p]], begin[p] - sizes[of] // 2)
        z = np.minimum(ends[row[p]], begin[p] + 2 * self.half + sizes[of] // 2)
        common = np.zeros(len(p), np.int64)
        short = sizes[of] <= 64
        for k in np.flatnonzero(~short):
            common[k] = lcs_length(items.words[of[k]], words[a[k] : z[k]])
        at = np.flatnonzero(short)
        if len(at):
            wide = int((z[at] - a[at]).max())
            for part in np.array_split(at, -(-len(at) * max(1, wide) // PAIR_WORDS)):
                common[part] = lcs_lengths(self.masks, sizes[of[part]], of[part], words, a[part], z[part])
        share = common / np.maximum(1, sizes[of])
        for k in np.flatnonzero((share >= self.lcs) & (sizes[of] > 0)):
            key = int(row[p[k]]), int(of[k])
            best[key] = max(best.get(key, (0.0, 0.0)), (float(cosine[k]), float(share[k])), key=lambda x: (x[1], x[0]))
        return best

    @cached_property
    def masks(self) -> np.ndarray:
        """For each item of up to 64 words and each word, the places where it stands, as bits."""
        out = np.zeros((len(self.items.words), self.items.size + 1), np.uint64)
        for i, item in enumerate(self.items.words):
            if len(item) <= 64:
                np.bitwise_or.at(out[i], item, np.uint64(1) << np.arange(len(item), dtype=np.uint64))
        out[:, 0] = 0
        return out

    def run(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = self.items
        if not items.keys:
            return
        # a piece of a very long text holds whatever begins in it: passages and the words around them; answers are looked for in all of it
        overlap = 4 * self.half + max([2 * len(w) for w in items.words], default=0)
        for batch in batches:
            long, answered = None, {}
            for ids, sizes, words, whole in _word_slices(batch, items.local, self.half, overlap):
                if not len(words):
                    continue
                if whole is not long:
                    long, answered = whole, {}
                row, begin, end = self.passages(sizes, words)
                ends = np.cumsum(sizes)
                candidate, p, q, cosines = self.candidates(words, begin, end)
                exact = self.verbatim(words, ends, row, begin, candidate)
                near = self.paraphrases(words, ends, row, begin, p, q, cosines)
                pairs = sorted(exact | near.keys())
                if not pairs:
                    continue
                starts = np.cumsum(sizes) - sizes
                out = []
                for r, i in pairs:
                    cosine, share = near.get((r, i), (None, None))
                    if self.cosine is None:
                        answer = None
                    elif whole is None:
                        answer = holds(words[starts[r] : starts[r] + sizes[r]], items.answers[i])
                    else:
                        answer = answered[i] if i in answered else answered.setdefault(i, holds(whole, items.answers[i]))
                    out.append((ids[r].as_py(), items.keys[i], (r, i) in exact, cosine, share, answer))
                docs, keys, found, cosines, shares, answers = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, ids.type), pa.array(keys, pa.int64()), pa.array(found), pa.array(cosines, pa.float64()), pa.array(shares, pa.float64()), pa.array(answers, pa.bool_())],
                    names=["doc", "item", "verbatim", "cosine", "lcs_share", "has_answer"],
                )


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``; unknown words (0) match nothing."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        if w:
            masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_lengths(masks: np.ndarray, sizes: np.ndarray, of: np.ndarray, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """:func:`lcs_length` of many pairs at once: item ``of`` (of ``sizes`` words, up to 64) and ``words[begin:end]``."""
    full = np.full(len(of), np.iinfo(np.uint64).max, np.uint64) >> (64 - np.maximum(1, sizes)).astype(np.uint64)
    v = full.copy()
    for step in range(int((end - begin).max())):
        at = begin + step
        u = v & masks[of, np.where(at < end, words[np.minimum(at, len(words) - 1)], 0)]
        v = ((v + u) | (v - u)) & full
    return np.maximum(1, sizes) - np.bitwise_count(v)


def holds(text: np.ndarray, part: np.ndarray) -> bool:
    """Whether ``part`` stands in ``text`` word by word; an empty part does not."""
    if not len(part) or len(part) > len(text):
        return False
    at = np.flatnonzero(text[: len(text) - len(part) + 1] == part[0])
    return any(np.array_equal(text[a : a + len(part)], part) for a in at)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    answer: str | None = "answer",
    run: int = 13,
    rank: int = 128,
    width: int = 80,
    cosine: float | None = 0.25,
    lcs: float = 0.5,
    run_cosine: float | None = 0.15,
    passage: int | None = None,
    block: int = PASSAGES,
) -> DataFrame:
    """``(doc, item, verbatim, cosine, lcs_share, has_answer)``, one row per document and item that are linked.

    ``verbatim``: ``run`` or more consecutive words of the item stand in a passage of latent cosine ``run_cosine`` or more;
    with ``run_cosine=None`` in any passage that can hold such a run by the bound on its inner product, which misses none at
    any rank, and rules out few at a low one. Paraphrases: a passage of latent cosine ``cosine`` or more shares a subsequence
    of at least ``lcs`` of the item's words; with ``cosine=None`` only verbatim pairs come out. ``has_answer``: the answer stands anywhere in the document. Passages have
    ``passage`` words (three runs and one by default), half of them shared with the next.

    Items are a query set: their texts are collected, up to ITEM_BYTES together, and the documents are encoded once for all of
    those; ``block`` passages of them are searched at a time, with a basis of their own.

    Rows with a null id are left out; null, empty or short texts link to nothing; repeated rows of one id give
    one row; an item that equals another is found along with it. Empty tables give no rows; extra columns are ignored.
    """
    kind = docs.schema[doc].dataType
    plain = docs.where(F.col(f"`{doc}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    asked = items.where(F.col(f"`{item}`").isNotNull() & F.col(f"`{item_text}`").isNotNull()).select(
        F.col(f"`{item}`").cast("long").alias("item"), F.col(f"`{item_text}`").alias("text"), (F.col(f"`{answer}`") if answer else F.lit(None)).cast("string").alias("answer")
    )
    schema = T.StructType([T.StructField("doc", kind), T.StructField("item", T.LongType()), T.StructField("verbatim", T.BooleanType()), T.StructField("cosine", T.DoubleType()), T.StructField("lcs_share", T.DoubleType()), T.StructField("has_answer", T.BooleanType())])
    passage = 2 * ((3 * run + 1) // 2) if passage is None else passage
    if passage % 2 or passage // 2 < run - 1:
        raise ValueError("a passage has an even number of words and half of it at least all but one of a run")
    parts = []
    groups = max(1, -(-measured(asked)[1] // ITEM_BYTES))
    for n in range(groups):
        mine = asked if groups == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == n)
        rows = sorted(set(map(tuple, mine.collect())), key=str)
        texts, answers = [word_strings(r[1]) for r in rows], [word_strings(r[2]) for r in rows]
        vocabulary = Vocabulary([*texts, *answers])
        numbers = lambda ws: np.array([vocabulary.ids[w] for w in ws], np.int64)
        keys, texts, answers = [r[0] for r in rows], list(map(numbers, texts)), list(map(numbers, answers))
        cuts = Items.cuts(texts, run)
        encoded = _encoded(plain, vocabulary, kind).frame
        for at in range(0, max(1, len(cuts)), block):
            chosen = Items(keys, texts, answers, run, vocabulary.size, cut=cuts[at : at + block])
            fit_latent(encoded, chosen, passage, rank, width)
            search = _Search(chosen, passage, cosine, lcs, run_cosine)
            parts.append(encoded.mapInArrow(lambda batches, s=search: s.run(batches), schema))
    per_pair = reduce(DataFrame.unionByName, parts).groupBy("doc", "item").agg(*[F.max(c).alias(c) for c in schema.names[2:]])
    return per_pair.withColumnsRenamed({"doc": doc, "item": item})
