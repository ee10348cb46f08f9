"""Every query of the subpackage with SQL gives the same rows as DuckDB."""

import oracle
import pytest

from chunklake.llm import queries

CASES = [(k, f, queries.SQL.get(k)) for k, f in queries.QUERIES.items()]


@pytest.mark.parametrize("name,query,sql", CASES, ids=[c[0] for c in CASES])
def test_query(spark, duck, data, name, query, sql):
    if sql is None:
        assert query(spark, data).count() > 0
    else:
        oracle.check(spark, duck, data, query, sql)
