"""Registered queries against their DuckDB twins at sf0.001 (the driver runs sf0.01),
with plan guards on each."""

import duckdb
import pytest

import __spark_entry__ as E
import registered
from tools.check_oracle import digest, type_diff
from tests.conftest import SF_SMALL

NAMES = sorted(registered.SPEC)            # the training-data queries have tests of their own
PYTHON_OK = {"sequence_scores", "sequence_scores_scaled"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "part"):
        c.execute(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    # plan guards: no cartesian / nested-loop joins; Python only where a predictor runs
    txt = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in txt and "BroadcastNestedLoopJoin" not in txt
    has_python = "MapInArrow" in txt or "MapInPandas" in txt or "ArrowEvalPython" in txt or "BatchEvalPython" in txt
    assert has_python == (name in PYTHON_OK)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert type_diff(df, con, E.oracle_sql()[name]) == {}
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_entry_flagship(spark):
    out = E.entry(spark).collect()
    assert len(out) == 7
