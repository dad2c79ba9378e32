import random

import numpy as np
import pytest

from quern.llm import leakage
from quern.llm.tokens import word_strings
from tests.sql_match import SMALL

VOCAB = [f"w{i}" for i in range(300)]


def runs(doc, item, n):
    grams = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
    return any(tuple(doc[i : i + n]) in grams for i in range(len(doc) - n + 1))


def make(seed=4):
    rng = random.Random(seed)
    items = [[rng.choice(VOCAB) for _ in range(rng.choice([3, 13, 30, 90]))] for _ in range(25)]
    docs = []
    for _ in range(150):
        words = [rng.choice(VOCAB + ["common"] * 200) for _ in range(rng.randrange(0, 200))]
        if rng.random() < 0.5:
            item = rng.choice(items)
            a = rng.randrange(len(item))
            at = rng.randrange(len(words) + 1)
            words[at:at] = item[a : a + rng.choice([12, 13, 14, 40])]
        docs.append(words)
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, " ".join(w), "x", 1) for i, w in enumerate(docs)], "doc_id bigint, text string, item string, words int")
    e = spark.createDataFrame([(i, " ".join(w), None, "y") for i, w in enumerate(items)], "item_id bigint, text string, answer string, topic string")
    return d, e


@pytest.mark.parametrize("rank,width,block", [(512, 80, 2000), (1, 4, 2000), (8, 8, 7)])
def test_verbatim_is_complete_at_any_rank(spark, rank, width, block):
    docs, items = make()
    want = {(i, j) for i, d in enumerate(docs) for j, e in enumerate(items) if runs(d, e, 13)}
    got = leakage.leaks(*frames(spark, docs, items), cosine=None, run_cosine=None, rank=rank, width=width, block=block)
    assert {(r.doc_id, r.item_id) for r in got.collect() if r.verbatim} == want and len(want) > 20


def test_sums_in_two_steps_give_the_same(spark, monkeypatch):
    docs, items = make(3)
    d, e = frames(spark, docs, items)
    want = {(r.doc_id, r.item_id) for r in leakage.leaks(d, e, cosine=None, run_cosine=None).collect()}
    monkeypatch.setattr(leakage, "SUM_AT_ONCE", 2)
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d.repartition(7), e, cosine=None, run_cosine=None).collect()} == want


def test_pieces_of_long_documents(spark, monkeypatch):
    docs, items = make(9)
    long = [w for d in docs for w in d]
    monkeypatch.setattr(leakage, "SLICE_WORDS", 26 * 3)
    block = leakage.Items(list(range(len(items))), [np.array([VOCAB.index(w) + 1 for w in e]) for e in items], [np.empty(0, np.int64)] * len(items), 13, len(VOCAB))
    rng = np.random.default_rng(0)
    block.fit(np.r_[0, rng.random(block.size) + 1], np.linalg.qr(rng.random((block.size + 1, 5)))[0])
    import pyarrow as pa

    numbers = [VOCAB.index(w) + 1 if w in VOCAB else 0 for w in long]
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([numbers], pa.list_(pa.int32()))], names=["doc", "words"])
    got = {r["item"] for b in leakage._Search(block, 26, None, 0.5).run([batch]) for r in b.to_pylist()}
    assert got == {j for j, e in enumerate(items) if runs(long, e, 13)}


def test_paraphrase_and_answer(spark):
    rng = random.Random(1)
    item = [f"q{i}" for i in range(30)]
    changed = [w for i, w in enumerate(item) if i % 6] + ["the", "answer", "forty", "two"]
    noise = lambda n: [rng.choice(VOCAB) for _ in range(n)]
    docs = [noise(60) + changed + noise(60), noise(150), noise(20) + item + noise(20)]
    d, _ = frames(spark, docs, [])
    e = spark.createDataFrame([(5, " ".join(item), "Forty-two"), (6, "", None), (7, None, "x")], "item_id bigint, text string, answer string")
    got = {(r.doc_id, r.item_id): r for r in leakage.leaks(d, e).collect()}
    assert got.keys() == {(0, 5), (2, 5)}
    assert not got[0, 5].verbatim and got[0, 5].has_answer and got[0, 5].lcs_share == pytest.approx(25 / 30)
    assert got[2, 5].verbatim and not got[2, 5].has_answer


def test_answer_anywhere_in_a_long_document(spark):
    rng = random.Random(2)
    item, answer = [f"q{i}" for i in range(30)], ["forty", "two"]
    noise = lambda n: rng.choices(VOCAB, k=n)
    far = 2 * leakage.SLICE_WORDS + 500
    docs = [item + noise(far) + answer, answer + noise(far) + item, item + noise(far), item + noise(leakage.SLICE_WORDS - 31) + answer + noise(9)]
    d, _ = frames(spark, docs, [])
    e = spark.createDataFrame([(5, " ".join(item), "Forty-two")], "item_id bigint, text string, answer string")
    assert {r.doc_id: r.has_answer for r in leakage.leaks(d, e).collect()} == {0: True, 1: True, 2: False, 3: True}


def test_empty_null_and_repeated(spark):
    docs, items = make(2)
    d, e = frames(spark, docs, items)
    assert leakage.leaks(d.limit(0), e).count() == 0
    assert leakage.leaks(d, e.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, " ".join(items[2]), "x", 1), (1, None, "x", 1), (2, " ".join(items[2]), "x", 1), (2, " ".join(items[2]), "x", 1)], d.schema)
    rows = leakage.leaks(odd, e.union(e), cosine=None, run_cosine=None).collect()
    assert all(r.doc_id == 2 for r in rows) and len(rows) == len({(r.doc_id, r.item_id) for r in rows})


@pytest.mark.parametrize("a,b,n", [("abcbdab", "bdcaba", 4), ("", "abc", 0), ("abc", "", 0), ("aaaa", "aa", 2), ("abc", "xyz", 0)])
def test_lcs(a, b, n):
    f = lambda s: np.array([ord(c) for c in s], np.int64)
    assert leakage.lcs_length(f(a), f(b)) == n


def test_many_lcs_at_once():
    rng = np.random.default_rng(3)
    block = leakage.Items(list(range(9)), [rng.integers(1, 30, n) for n in (0, 1, 5, 13, 31, 63, 64, 64, 2)], [np.empty(0, np.int64)] * 9, 13, 30)
    words = rng.integers(0, block.size + 1, 400)
    of, begin = rng.integers(0, 9, 200), rng.integers(0, 300, 200)
    end = begin + rng.integers(0, 100, 200)
    got = leakage.lcs_lengths(leakage._Search(block, 40, 0.2, 0.5).masks, np.array([len(w) for w in block.words])[of], of, words, begin, end)
    assert got.tolist() == [leakage.lcs_length(block.words[i], words[a:z]) for i, a, z in zip(of, begin, end)]


def test_halves_add_up_to_the_passages():
    rng = np.random.default_rng(4)
    block = leakage.Items([1], [np.arange(1, 41)], [np.empty(0, np.int64)], 13, 50)
    block.fit(rng.random(block.size + 1) * (np.arange(block.size + 1) > 0), np.linalg.qr(rng.random((block.size + 1, 6)))[0])
    search = leakage._Search(block, 40, 0.2, 0.5)
    sizes = np.array([0, 3, 20, 21, 40, 41, 0, 107, 1, 200])
    words = rng.integers(0, block.size + 1, sizes.sum()) * (rng.random(sizes.sum()) < 0.5)
    _, begin, end = search.passages(sizes, words)
    for chunk in (slice(None), slice(2, 9), slice(0, 1), slice(-1, None)):
        latent = search.project(words, begin[chunk], end[chunk])
        residual = search.residual(words, begin[chunk], end[chunk], latent)
        assert np.allclose(latent, [block.table[words[a:z]].sum(0) for a, z in zip(begin[chunk], end[chunk])], atol=1e-4)
        full = [np.bincount(words[a:z], minlength=block.size + 1) * block.weight for a, z in zip(begin[chunk], end[chunk])]
        assert np.allclose(residual**2 + (latent.astype(float) ** 2).sum(1), [(x[1:] ** 2).sum() * (1 + 1e-6) for x in full], atol=1e-3)


@pytest.mark.parametrize("folder,least_id,n_docs", [("sf0.001", 0, 10**9), ("sf0.1", 2_000, 400)])
def test_recall_of_paraphrases_against_brute_force(spark, folder, least_id, n_docs):
    """On documents that did not serve to choose the threshold: every document and item whose longest common subsequence
    around some passage is half of the item's words, as found by comparing all passages with all items."""
    import pyarrow.parquet as pq

    base = SMALL.rsplit("/", 1)[0]
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{base}/{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist() if r["doc_id"] >= least_id][:n_docs]
    asked = pq.read_table(f"{base}/{folder}/eval_items.parquet").to_pylist()
    texts = [word_strings(r["text"]) for r in asked]
    vocabulary = leakage.Vocabulary(texts)
    items = [np.array([vocabulary.ids[w] for w in t]) for t in texts]
    block = leakage.Items(list(range(len(items))), items, [np.empty(0, np.int64)] * len(items), 13, vocabulary.size)
    search, sizes = leakage._Search(block, 40, 0.25, 0.5), np.array([len(w) for w in items])
    want = set()
    for d, text in docs:
        words = block.local[np.array(vocabulary.encode(text), np.int64)].astype(np.int64)
        for a in range(0, max(1, len(words) - 20), 20):
            begin, end = np.maximum(0, a - sizes // 2), np.minimum(len(words), a + 40 + sizes // 2)
            if len(words):
                share = leakage.lcs_lengths(search.masks, sizes, np.arange(len(items)), words, begin, end) / sizes
                want |= {(d, asked[i]["item_id"]) for i in np.flatnonzero(share >= 0.5)}
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.read.parquet(f"{base}/{folder}/eval_items.parquet")).collect() if r.lcs_share}
    assert got <= want and len(want) > 10
    print(folder, len(got), len(want))
    assert len(got) >= 0.9 * len(want)


def test_columnar_words_are_those_of_each_text():
    import pyarrow as pa

    texts = ["", None, "Ünï  x", "日本 語a", "İx ſ ΑΣ ΣΑ", "a­b c", "x​y", "١٢ 3", "_a_b_", "\n\n", "A-b C", "😀𝐀b ﬁ", "Q" * 9, "a\nb"]
    for at_once in (1, 10, 1 << 22):
        vocabulary = leakage.Vocabulary([["ünï", "x", "日本", "ας", "σα", "abc", "a", "b", "١٢"]])
        vocabulary.AT_ONCE = at_once
        got = [(first + i, n.tolist()) for first, counts, numbers in vocabulary.encode_all(pa.array(texts)) for i, n in enumerate(np.split(numbers, np.cumsum(counts)[:-1]))]
        assert got == [(i, vocabulary.encode(t)) for i, t in enumerate(texts)]


def test_long_items_and_small_blocks(spark):
    """An item of many passages is searched in several blocks and found whole."""
    rng = random.Random(8)
    item = [f"q{rng.randrange(400)}" for _ in range(500)]
    changed = [w for i, w in enumerate(item) if i % 5]
    docs = [rng.choices(VOCAB, k=50) + changed + rng.choices(VOCAB, k=50), item[490:] + rng.choices(VOCAB, k=90), rng.choices(VOCAB, k=30) + item[301:314]]
    d, e = frames(spark, docs, [item, item[:40], ["x"]])
    got = {(r.doc_id, r.item_id): r for r in leakage.leaks(d, e, block=3).collect()}
    assert got[0, 0].lcs_share == pytest.approx(0.8) and not got[0, 0].verbatim and got[2, 0].verbatim and (1, 0) not in got and (0, 1) in got


def test_words():
    assert word_strings("Ab_c-1, ＤＥ­​f Ünï\n٣") == ["ab", "c", "1", "def", "ünï", "٣"]
    assert word_strings("A-b 3.5_x") == ["a", "b", "3", "5", "x"]
    assert word_strings(None) == word_strings("") == []
