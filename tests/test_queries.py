"""Every registered query against its oracle, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    shown = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted((tuple(shown(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
