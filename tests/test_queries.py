"""Every registered catalog query against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from vitrine import queries, upkeep  # noqa: F401  upkeep registers its queries with the others

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def told(v) -> str:
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    return "nan" if math.isnan(v) else repr(round(float(v), 6) + 0.0)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in queries.SQL:
        assert rows
        return
    found = duck.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(told(x[names.index(c)]) for c in df.columns) for x in found.fetchall())
    assert sorted(tuple(map(told, r)) for r in rows) == want


def test_entry(spark):
    df = queries.entry(spark, DATA)
    assert df.columns[0] == "id" and len(df.collect()) <= 100
