"""Every registered query of the library, at the smallest scale, next to its SQL."""

import glob
import math

import duckdb
import pytest

from quorumlake import plans

SF = "/root/testdata/sf0.001"


def plain(v):
    return (None if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {path.split('/')[-1][:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_equals_sql(spark, con, name):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = plans.queries()[name](spark, SF)
    rel = con.sql(plans.oracle_sql()[name])
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    want = sorted(repr([plain(r[rel.columns.index(c)]) for c in cols]) for r in rel.fetchall())
    assert got == want
