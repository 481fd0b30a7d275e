"""Every query with SQL gives the rows of DuckDB; every other runs with a stable schema."""

import math
from pathlib import Path

import duckdb
import pytest

from lontar.plans import queries as core


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if type(v).__name__ == "Decimal":
        return round(float(v), 8)
    return tuple(map(canon, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query(spark, data, duck, name):
    made = core.QUERIES[name](spark, data)
    got = rows_of(made.columns, [tuple(r) for r in made.collect()])
    if name not in core.SQL:
        assert made.columns
        return
    wanted = duck.sql(core.SQL[name])
    assert sorted(made.columns) == sorted(wanted.columns)
    assert got == rows_of(wanted.columns, wanted.fetchall())


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
