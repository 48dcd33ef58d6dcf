"""Every registered terrain query against its DuckDB statement on the smallest tables."""

import math
import os

import pytest

from cellgrove.plans import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "customer embeddings events lineitem nation orders part region supplier".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 5) + 0.0
        return x

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_statement(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    got = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(got.fetchall(), names)
