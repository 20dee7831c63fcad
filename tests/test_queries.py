"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from turnmill.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{x:.8g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    got = sorted([plain(r[c]) for c in order] for r in df.collect())
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == order
    assert sorted([plain(r[names.index(c)]) for c in order] for r in found.fetchall()) == got
