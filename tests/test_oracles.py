"""Every registered query of the library with a DuckDB equivalent, on the smallest tables."""

import datetime
import decimal
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, float | decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in place) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
