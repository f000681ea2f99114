"""Every query against its DuckDB statement on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from panelwright.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return [normal(v) for v in value]
    return value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([normal(r[c]) for c in columns] for r in df.collect()), key=str)
    if name not in registry.ORACLES:
        return
    result = oracle.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(([normal(row[names.index(c)]) for c in columns] for row in result.fetchall()), key=str)
    assert got == want


def test_oracles_have_queries():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
