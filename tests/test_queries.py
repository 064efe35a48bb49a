"""Every query against its SQL on DuckDB, as multisets of rows with columns sorted by name."""

import math
from collections import Counter

import duckdb
import pytest

from assay import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, con, name):
    df = core.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    found = con.execute(core.oracle_sql()[name])
    assert sorted(d[0] for d in found.description) == names
    at = {d[0]: i for i, d in enumerate(found.description)}
    want = Counter(tuple(plain(r[at[n]]) for n in names) for r in found.fetchall())
    assert got == want


def test_all_have_sql():
    assert core.queries().keys() == core.oracle_sql().keys()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert core.queries().keys() <= e.queries().keys()
