"""Every registered query runs on the smallest tables and, where it has SQL, equals it."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from notewright import queries as core

QUERIES, SQL = core.queries(), core.oracle_sql()


def rows_of(frame, columns):
    def plain(v):
        if v is None or str(v) in ("NaT", "<NA>") or (isinstance(v, float) and math.isnan(v)):
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
    assert set(core.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data).toPandas()
    assert name == "link_jaccard" or len(got) > 0
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got, sorted(got.columns)) == rows_of(want, sorted(got.columns))
