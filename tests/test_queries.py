"""Every query outside the training-data subpackage against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tideline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def value(x):
    return "null" if x is None or isinstance(x, float) and math.isnan(x) else f"{x + 0.0:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted("|".join(map(value, r)) for r in df.select(*columns).collect())
    if name in registry.ORACLES:
        found = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert sorted("|".join(value(r[names.index(c)]) for c in columns) for r in found.fetchall()) == rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
