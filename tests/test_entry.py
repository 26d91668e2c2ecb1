"""Every query of the core against its SQL on the smallest tables."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from filament.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def _rows(frame, columns):
    def plain(v):
        if v is None or v != v:
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return Counter(tuple(plain(v) for v in r) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, duck, name):
    got, expected = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    columns = sorted(expected.columns)
    assert _rows(got, columns) == _rows(expected, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
