"""Each query against its SQL on another engine, on the small test tables."""

import os

import duckdb
import pytest

from parley.plans import registry

SF = os.environ.get("PARLEY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    conn = duckdb.connect()
    for t in TABLES:
        conn.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return conn


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: "null" if v is None else f"{v:.8g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    found = duck.execute(registry.oracles()[name])
    assert got == rows([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_rows_without_sql(spark, name):
    """There are rows, no two of them equal, and the same ones again from a second run."""
    first, second = (rows(df.columns, df.collect()) for df in (registry.queries()[name](spark, SF) for _ in range(2)))
    assert first and first == second and len(set(first)) == len(first)
