import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm.packing import TOKEN, best_two_fit, count_tokens, fill_report, pack


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=20))
def test_plan_places_every_text_once_and_never_overfills(counts):
    plan = best_two_fit(counts, 32)
    placed = Counter()
    for many, sizes in plan:
        assert many > 0 and sum(sizes) <= 32
        for s in sizes:
            placed[s] += many
    assert placed == Counter(counts)
    # no two containers could be merged, but for one
    loads = sorted(sum(s) for m, s in plan for _ in range(min(m, 2)))
    assert len(loads) < 2 or loads[0] + loads[1] > 32 or sum(counts.values()) < 2


def test_two_texts_replace_the_smallest():
    # greedy: 6 + 3 leaves 1 of 10; 2 + 2 in place of the 3 fill it
    assert best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])


def test_size_beyond_the_capacity_is_an_error():
    with pytest.raises(ValueError):
        best_two_fit({11: 1}, 10)


@pytest.mark.parametrize("capacity", [0, -1, 2**20 + 1])
def test_capacities_have_bounds(spark, capacity):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), capacity=capacity)


@pytest.mark.parametrize("chunk", [1, 5, 10**6])
def test_pack(spark, chunk):
    rng = random.Random(3)
    texts = [" ".join(["w"] * rng.choice([0, 1, 3, 7, 10, 11, 25, 30])) for _ in range(200)]
    rows = [(i if i % 10 else None, t, "x", 1) for i, t in enumerate(texts)] + [(1, "w w", "x", 1), (1, "w w", "x", 1), (500, None, "x", 1)]
    got = pack(spark.createDataFrame(rows, "doc_id bigint, text string, container string, row int"), capacity=10, chunk_rows=chunk).collect()
    load = defaultdict(int)
    for r in got:
        assert r.container is not None and 0 < r.n_tokens <= 10 or r.n_tokens == 0
        load[r.container] += r.n_tokens
    assert max(load.values()) <= 10
    assert sum(load.values()) == sum(len((t or "").split()) for _, t, *_ in rows)
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(r[0] for r in rows)
    assert all(r.n_pieces == max(1, -(-len(texts[r.doc_id].split()) // 10)) for r in got if r.doc_id is not None and 1 < r.doc_id < 200)
    assert all(r.first_token == 10 * r.piece for r in got)


def test_empty_table_and_only_empty_texts(spark):
    schema = "doc_id bigint, text string"
    assert pack(spark.createDataFrame([], schema)).count() == 0
    got = pack(spark.createDataFrame([(1, ""), (2, None)], schema)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_pieces) for r in got) == [(1, 0, 1), (2, 0, 1)]
    assert fill_report(pack(spark.createDataFrame([], schema))).first().n_containers == 0


@pytest.mark.parametrize("text,n", [("", 0), ("a b", 2), ("a,b", 3), ("don't", 3), ("x_1 ²", 2), ("...!?", 1), ("a b c", 3), ("é́", 2), ("日本 語", 2), ("a​b", 3), ("\x1c\x85", 0)])
def test_tokens_as_in_python(spark, text, n):
    import re

    assert len(re.findall(r"\w+|[^\w\s]+", text)) == n
    assert spark.createDataFrame([(text,)], "t string").select(count_tokens(F.col("t"))).first()[0] == n, TOKEN


def test_very_long_text(spark):
    got = pack(spark.createDataFrame([(1, "ab, " * 500_000)], "doc_id bigint, text string")).agg(F.sum("n_tokens").alias("t"), F.max("n_pieces").alias("n")).first()
    assert got.t == 1_000_000 and got.n == 977
