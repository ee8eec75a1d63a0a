"""The command table: names, columns, and agreement of a few queries with their SQL."""

import glob
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["ate_targeted", "att", "weight_report", "calibration", "evalues", "ltmle_survival"])
def test_queries_agree_with_sql(spark, name):
    import __spark_entry__ as E

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = E.queries()[name](spark, SF).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = [c for c in cols if got[c].dtype == object] or cols
    a, b = got[cols].sort_values(key).to_dict("records"), want[cols].sort_values(key).to_dict("records")
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for c in cols:
            assert x[c] == pytest.approx(y[c], abs=1e-9) if isinstance(x[c], float) else x[c] == y[c]


def test_entry_runs(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() == 5
