"""Registered queries of this subpackage against their SQL texts."""

import pytest

from tessera.llm import queries
from tests.test_oracles import DATA, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, name):  # noqa: F811
    got = queries.QUERIES[name](spark, DATA)
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
