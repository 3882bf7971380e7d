"""Every registered query against its DuckDB oracle on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from plumbline.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{small}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return round(float(v), 6) if hasattr(v, "as_tuple") else v


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, small, name):
    df = catalog.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.oracles():
        assert got
        return
    cursor = duck.execute(catalog.oracles()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == ordered(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
