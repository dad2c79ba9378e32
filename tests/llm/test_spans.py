import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import spans, windows

SCHEMA = "doc_id bigint, text string, h bigint, first int, doc string"


def brute(texts, length):
    owners = {}
    for d, t in texts:
        for s in range(len(t) - length + 1):
            owners.setdefault(t[s : s + length], set()).add(d)
    out = set()
    for d in {d for d, _ in texts}:
        marked = sorted({s for e, t in texts if e == d for s in range(len(t) - length + 1) if len(owners[t[s : s + length]]) > 1})
        span = None
        for s in marked:
            if span and s <= span[1]:
                span[1] = s + length
            else:
                out |= {(d, *span)} if span else set()
                span = [s, s + length]
        out |= {(d, *span)} if span else set()
    return out


def run(spark, texts, length):
    df = spark.createDataFrame([(d, t, 1, 1, "x") for d, t in texts], SCHEMA)
    return {tuple(r) for r in spans.shared_spans(df, length=length).collect()}


def corpus(seed=5):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab é\n😀") for _ in range(rng.randrange(5, 400))) for _ in range(12)]
    texts = [(i, t) for i, t in enumerate(base)]
    for i in range(12, 40):
        a, b = rng.choice(base), rng.choice(base)
        texts.append((i, a[rng.randrange(len(a)) :] + "-" * rng.randrange(3) + b[: rng.randrange(len(b) + 1)]))
    return texts + [(40, base[0]), (41, base[0]), (42, ""), (43, None), (44, "a" * 300), (45, "a" * 200)]


@pytest.mark.parametrize("length", [1, 2, 7, 40, 100])
def test_equals_brute_force(spark, length):
    texts = corpus()
    assert run(spark, texts, length) == brute([(d, t or "") for d, t in texts], length)


def test_copies_stand_in_for_each_other(spark):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(80))
    got = run(spark, [(i, text) for i in range(6)] + [(9, "zz" + text[10:70] + "zz")], 40)
    assert got == {(i, 0, len(text)) for i in range(6)} | {(9, 2, 62)}


def test_repeats_inside_one_document_do_not_count(spark):
    assert run(spark, [(1, "abcdefgh" * 20), (1, "abcdefgh" * 20), (2, "x" * 200)], 16) == set()


def test_null_ids_empty_table_and_nothing_shared(spark):
    assert run(spark, [], 10) == set()
    assert run(spark, [(None, "a" * 50), (1, "b" * 50), (2, "c" * 50)], 10) == set()
    assert run(spark, [(None, "a" * 50), (1, "a" * 50)], 10) == set()


@pytest.mark.parametrize("chars", [40, 800])
def test_hot_hashes_and_shuffled_joins_give_the_same(spark, monkeypatch, chars):
    texts = corpus(8)
    want = run(spark, texts, 20)
    monkeypatch.setattr(spans, "HOT_CHARS", chars)
    monkeypatch.setattr(spans, "CHUNK_CHARS", 50)
    monkeypatch.setattr(spans, "BROADCAST_BYTES", -1)
    assert run(spark, texts, 20) == want == brute([(d, t or "") for d, t in texts], 20)


def test_texts_that_a_hash_modulo_a_power_of_two_takes_for_equal(spark):
    """Two complementary Thue-Morse texts of 1,024 characters have the same hash at every odd base."""
    rng = random.Random(3)
    shared = "".join(rng.choices("abcdefghij", k=3072))
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    hasher = windows.Hasher()
    h = [hasher.windows(hasher.prefix(np.frombuffer(t.encode(), np.uint8)), 1024)[0] for t in (thue, other)]
    assert h[0] == h[1]
    prime = windows.PrimeHasher(987654321987654321)
    assert len({int(prime.windows(np.frombuffer(t.encode(), np.uint8), 1024)[0]) for t in (thue, other)}) == 2
    assert run(spark, [(1, shared + thue), (2, shared + other)], 4096) == set()
    assert run(spark, [(1, shared + thue + "x"), (2, "y" + shared + thue), (3, shared + other)], 4096) == {(1, 0, 4096), (2, 1, 4097)}


def test_prime_hashes(monkeypatch):
    rng = np.random.default_rng(1)
    base, p = 2**60 + 12345, windows.PRIME
    a, b = (rng.integers(0, p, 500, dtype=np.uint64) for _ in "ab")
    a[:3], b[:3] = p - 1, [p - 1, 1, 0]
    assert [int(x) for x in windows._times(a, b)] == [int(x) * int(y) % p for x, y in zip(a, b)]
    codes = rng.integers(0, 0x10FFFF, 200).astype(np.uint32)
    want = [sum((int(c) + 1) * pow(base, k, p) for k, c in enumerate(codes[i : i + 37])) % p for i in range(164)]
    assert [int(x) for x in windows.PrimeHasher(base).windows(codes, 37)] == want


def test_one_passage_in_a_third_of_all_documents(spark, monkeypatch):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choices("klmnopqrst", k=n))
    passage = "".join(rng.choices("abcdefghij", k=90))
    texts = [(i, noise(120) if i % 3 else noise(rng.randrange(30)) + passage + noise(30)) for i in range(90)]
    monkeypatch.setattr(spans, "HOT_CHARS", 400)
    assert run(spark, texts, 40) == brute(texts, 40)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(windows, "SLICE_CHARS", 64)
    rng = random.Random(2)
    long = "".join(rng.choice("abcdef") for _ in range(1000))
    texts = [(1, long), (2, "x" * 70 + long[333:555] + "y"), (3, long[900:] + long[:50])]
    schema = pa.schema([("doc", pa.int64()), ("text", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in texts]), pa.array([t for _, t in texts])], schema=schema)
    cut = {tuple(r.values()) for b in spans._single_windows([batch], 40, False, (5, 7)) for r in b.to_pylist()}
    monkeypatch.setattr(windows, "SLICE_CHARS", 1 << 20)
    whole = {tuple(r.values()) for b in spans._single_windows([batch], 40, False, (5, 7)) for r in b.to_pylist()}
    assert cut == whole and len(whole) == sum(max(0, len(t) - 39) for _, t in texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.integers(1, 20))
def test_lowest_window(values, width):
    hashes = np.array(values, np.uint64)
    got = windows.lowest(hashes, width)
    top = [v >> 28 for v in values]  # hashes are told apart by their upper 36 bits, then by place
    assert got.tolist() == [min(range(i, i + width), key=lambda k: (top[k], k)) for i in range(len(values) - width + 1)]


def test_shared_amounts(spark):
    df = spark.createDataFrame([(1, "a" * 10), (2, None), (3, "b")], "doc_id bigint, text string")
    found = spark.createDataFrame([(1, 0, 4), (1, 6, 8)], "doc_id bigint, span_start bigint, span_end bigint")
    got = {r.doc_id: (r.n_chars, r.n_spans, r.shared_chars, r.shared_share) for r in spans.shared_amounts(df, found).collect()}
    assert got == {1: (10, 2, 6, 0.6), 2: (0, 0, 0, 0.0), 3: (1, 0, 0, 0.0)}
