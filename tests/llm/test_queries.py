"""The queries of the training-data problems: with SQL as DuckDB, without it against brute force."""

import re
import unicodedata
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from quern.llm.queries import registry
from tests.sql_match import SMALL, assert_same, connection


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", [n for n in registry.queries if n != "p8_found"])
def test_query(spark, con, name):
    if sql := registry.sql.get(name):
        assert_same(spark, con, registry.queries[name], sql, SMALL)
    else:
        df = registry.queries[name](spark, SMALL)
        assert df.columns and df.count() >= 0


def texts():
    return [(r["doc_id"], r["text"] or "") for r in pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]


def words(text):
    text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf").lower()
    return re.findall(r"[^\W_]+", text)


def test_p8_found_equals_brute_force(spark):
    grams = defaultdict(set)
    for r in pq.read_table(f"{SMALL}/eval_items.parquet").to_pylist():
        w = words(r["text"] or "")
        for i in range(len(w) - 12):
            grams[tuple(w[i : i + 13])].add(r["item_id"])
    want = {(d, i) for d, t in texts() for w in [words(t)] for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    assert {tuple(r) for r in registry.queries["p8_found"](spark, SMALL).collect()} == want


def test_p9_found_equals_brute_force(spark):
    from tests.llm.test_spans import brute

    assert {tuple(r) for r in registry.queries["p9_found"](spark, SMALL).collect()} == brute(texts(), 300)
