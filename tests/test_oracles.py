"""Every query of the core catalogue against its SQL text."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: "null" if x is None or isinstance(x, float) and math.isnan(x) else repr(x) if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_pages_that_share_a_url_keep_their_own_contents(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"u{k % 2}", f"<p>{k}</p>") for k in range(8)] + [(8, None, "x")], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalogue.QUERIES["image_contents"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(catalogue.ORACLE_SQL["image_contents"]).fetchall())
