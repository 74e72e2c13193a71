"""Every query with SQL against DuckDB, on the smallest tables."""

import pathlib

import duckdb
import pytest

from terrasift.plans.oracle import ORACLE_SQL
from terrasift.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"create view {t.stem} as select * from read_parquet('{t}')")
    return con


def rows(values):
    return sorted(tuple(map(repr, r)) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows(map(tuple, got.select(*columns).collect())) == rows(duck.sql(f"select {quoted} from ({ORACLE_SQL[name]})").fetchall())


def test_entry_names():
    import __spark_entry__

    assert set(ORACLE_SQL) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_halves_are_rounded_as_in_duckdb(spark):
    """The double times the power of ten is below the half, its shortest decimals are at it (F1)."""
    import duckdb

    from terrasift.plans.queries import _r

    v = [130.1609375, 129.8796875, 0.1609375, -129.8796875, 2.5, 7.0]
    got = [r.v for r in spark.createDataFrame([(x,) for x in v], "v double").select(_r("v")).collect()]
    assert got == [duckdb.execute("select round(?::double, 6) + 0.0", [x]).fetchone()[0] for x in v] and got[0] == 130.160937
