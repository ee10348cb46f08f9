"""Every query with SQL gives the same rows as DuckDB."""

import oracle
import pytest

from chunklake.queries import accounting, files, misc, planning, problems, registry, streams

MODULES = [problems, registry, accounting, planning, streams, misc, files]
CASES = [(k, f, m.SQL.get(k)) for m in MODULES for k, f in m.QUERIES.items()]


@pytest.mark.parametrize("name,query,sql", CASES, ids=[c[0] for c in CASES])
def test_query(spark, duck, data, name, query, sql):
    if sql is None:
        assert query(spark, data).count() > 0
    else:
        oracle.check(spark, duck, data, query, sql)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
