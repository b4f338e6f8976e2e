"""The registered queries over the smallest tables, next to DuckDB where it is there."""

import math
import os

import pytest

import __spark_entry__ as entry
from boardlens import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(float(f"{v:.9g}")) if isinstance(v, float) else v.isoformat(sep=" ") if hasattr(v, "isoformat") else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = plans.queries()[name](spark, SF)
    want = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect())
    rows = sorted(tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in want.fetchall())
    assert got == rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "error_context" in entry.queries()
