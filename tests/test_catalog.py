"""Every query of the graph engine with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from quern.plans import catalog

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, f"{DATA}/sf0.001")
    rows = [r.asDict() for r in found.collect()]
    if name not in catalog.ORACLES:
        return
    relation = duck.sql(catalog.ORACLES[name])
    wanted = [dict(zip(relation.columns, r)) for r in relation.fetchall()]
    assert sorted(found.columns) == sorted(relation.columns)
    key = lambda r: repr(sorted(r.items()))
    assert sorted(map(key, rows)) == sorted(map(key, wanted))
