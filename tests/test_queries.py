"""Every registered query against its SQL twin at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tabloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalogue.QUERIES, catalogue.ORACLES


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return round(float(v), 6)
        return v.isoformat() if hasattr(v, "isoformat") else v

    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE:
        result = duck.execute(ORACLE[name])
        assert got == table([d[0] for d in result.description], result.fetchall())
    else:
        assert got[1]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() == 6
