"""Every query with SQL against DuckDB on the same tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from linkspan.plans import catalog, documents, folds, joined, logs  # noqa: F401  all register their queries in the catalog


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else value.isoformat()
    return value


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_is_its_sql(spark, duck, sf_dir, name):
    found = catalog.queries()[name](spark, sf_dir)
    want = duck.execute(catalog.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    assert sorted(found.columns) == names
    order = [[d[0] for d in want.description].index(n) for n in names]
    expected = Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    got = Counter(tuple(plain(v) for v in r) for r in found.select(*names).collect())
    assert sum(got.values()) > 0
    assert got == expected, list((got - expected).items())[:2] + list((expected - got).items())[:2]
