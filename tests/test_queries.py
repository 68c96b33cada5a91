"""Core queries against their SQL on the smallest tables, with repeated rows and extra columns."""

import glob
import os

import duckdb
import pytest

from titlegrain.plans import core_queries as C
from titlegrain.plans import detail_queries, search_queries  # noqa: F401


def plain(rows):
    return sorted(tuple("" if x is None else repr(round(float(x), 4)) if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(C.SQL))
def test_equal(spark, data, name):
    con = duckdb.connect()
    for p in glob.glob(data + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = C.QUERIES[name](spark, data)
    got = con.execute(C.SQL[name]).df()
    assert sorted(df.columns) == sorted(got.columns)
    cols = sorted(df.columns)
    mine = plain(tuple(r[c] for c in cols) for r in df.collect())
    got = got[cols].astype(object).where(got[cols].notna(), None)
    assert mine == plain(got.itertuples(index=False))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
