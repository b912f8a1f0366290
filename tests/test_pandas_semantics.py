"""Spark column functions against the pandas operations they re-express."""

import datetime as dt
import math

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from demandlens.functions.bins import discount_bin, fine_discount_bin, report_bin
from demandlens.functions.calendar import calendar_columns
from demandlens.schema import DISCOUNT_BIN_EDGES, FINE_BIN_EDGES, REPORT_BIN_EDGES, REPORT_BIN_LABELS

values = st.lists(st.one_of(st.floats(min_value=-0.2, max_value=1.2, allow_nan=False),
                            st.sampled_from([0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.75, 1.0,
                                             -0.001, -0.0005])), min_size=1, max_size=60)


@settings(max_examples=15, deadline=None)
@given(values)
def test_bins_match_pandas_cut(spark, xs):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, d double")
    got = df.select("i", discount_bin(F.col("d")).alias("a"), fine_discount_bin(F.col("d")).alias("b"),
                    report_bin(F.col("d")).alias("c")).orderBy("i").collect()
    s = pd.Series(xs, dtype=float)
    a = pd.cut(s, bins=list(DISCOUNT_BIN_EDGES), labels=list(range(5))).astype(float)
    b = pd.cut(s, bins=list(FINE_BIN_EDGES), labels=list(range(10))).astype(float)
    c = pd.cut(s, bins=list(REPORT_BIN_EDGES), labels=list(REPORT_BIN_LABELS))
    for r, ea, eb, ec in zip(got, a, b, c):
        assert (r["a"] is None and math.isnan(ea)) or r["a"] == ea
        assert (r["b"] is None and math.isnan(eb)) or r["b"] == eb
        assert (r["c"] is None and pd.isna(ec)) or r["c"] == ec


def test_calendar_matches_pandas(spark):
    days = [dt.date(2015, 12, 20) + dt.timedelta(days=i) for i in range(0, 4000, 3)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select(*calendar_columns(F.col("d"), "base")).collect()
    s = pd.to_datetime(pd.Series(days))
    want = pd.DataFrame({"month": s.dt.month, "year": s.dt.year, "quarter": s.dt.quarter,
                         "day_of_week": s.dt.dayofweek, "day_of_year": s.dt.dayofyear,
                         "week_of_year": s.dt.isocalendar().week.astype(int)})
    want["week_sin"] = np.sin(2 * np.pi * want["week_of_year"] / 52)
    want["month_cos"] = np.cos(2 * np.pi * want["month"] / 12)
    for r, (_, w) in zip(got, want.iterrows()):
        for c in ("month", "year", "quarter", "day_of_week", "day_of_year", "week_of_year"):
            assert r[c] == w[c], c
        assert abs(r["week_sin"] - w["week_sin"]) < 1e-12 and abs(r["month_cos"] - w["month_cos"]) < 1e-12
