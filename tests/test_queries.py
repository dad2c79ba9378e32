"""Every registered query runs; those with SQL give what DuckDB gives."""

import pytest

from quern.plans import data_problems, jobs, relational, systems
from tests.sql_match import SMALL, assert_same, connection

REGISTRIES = (data_problems.registry, relational.registry, jobs.registry, systems.registry)
CASES = [(n, q, r.sql.get(n)) for r in REGISTRIES for n, q in r.queries.items()]


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name,query,sql", CASES, ids=[c[0] for c in CASES])
def test_query(spark, con, name, query, sql):
    if sql:
        assert_same(spark, con, query, sql, SMALL)
    else:
        df = query(spark, SMALL)
        assert df.columns and df.count() >= 0
