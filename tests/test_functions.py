"""Hand rows: one per semantic rule (bins, counters, rolling, calendar, clamp, ratios)."""

import math

import pytest
from pyspark.sql import functions as F

from demandlens.functions.bins import (
    calibration_bin, discount_bin, fine_discount_bin, report_bin, report_bin_ordinal,
)
from demandlens.functions.numeric import clamp_non_negative, ratio_with_inf
from demandlens.operators.windows import rolling

DISCOUNTS = [-.5, -.001, -.0005, 0.0, .05, .1, .2, .3, .4, 1.0, 1.01, None]


def _col(spark, values, name="d"):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"i int, {name} double")


def _ordered(df, col):
    return [r[col] for r in df.orderBy("i").collect()]


def test_discount_bin(spark):
    df = _col(spark, DISCOUNTS).select("i", discount_bin(F.col("d")).alias("b"))
    assert _ordered(df, "b") == [None, None, 0, 0, 0, 1, 2, 3, 4, 4, None, None]


def test_fine_bin(spark):
    df = _col(spark, DISCOUNTS).select("i", fine_discount_bin(F.col("d")).alias("b"))
    assert _ordered(df, "b") == [None, None, None, None, 0, 1, 3, 5, 6, 9, None, None]


def test_report_bin(spark):
    df = _col(spark, DISCOUNTS).select("i", report_bin(F.col("d")).alias("b"),
                                       report_bin_ordinal(F.col("d")).alias("o"))
    assert _ordered(df, "b") == [None, None, "0-5%", "0-5%", "0-5%", "5-10%", "15-20%", "20-30%",
                                 "30-40%", "40%+", None, None]
    assert _ordered(df, "o") == [None, None, 0, 0, 0, 1, 3, 4, 5, 6, None, None]


def test_calibration_bin_missing_goes_high(spark):
    df = _col(spark, [0.1, 0.15, 0.3, 0.41, None]).select("i", calibration_bin(F.col("d")).alias("b"))
    assert _ordered(df, "b") == ["0-10%", "10-20%", "20-30%", "40%+", "40%+"]


def test_change_counter(spark):
    from demandlens.operators.windows import time_series_features
    d = [0.0, 0.0, .2, .2, .2, .4, .41, None, .4]
    rows = [("k", f"2021-01-{i + 1:02d}", 1.0, v) for i, v in enumerate(d)]
    df = spark.createDataFrame(rows, "KEY string, DATE string, QUANTITY_SOLD double, dc double") \
        .select("KEY", F.to_date("DATE").alias("DATE"), "QUANTITY_SOLD", "dc", F.lit(1).alias("month"))
    out = time_series_features(df, discount_col="dc").orderBy("DATE")
    assert [r["days_since_discount_change"] for r in out.collect()] == [1, 2, 0, 1, 2, 0, 1, 2, 3]


def test_rolling_two_skips_missing(spark):
    vals = [1.0, None, 3.0, None, None, None]
    rows = [("k", i, v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "KEY string, DATE int, q double")
    out = df.select("DATE", F.avg("q").over(rolling(2, False)).alias("r")).orderBy("DATE")
    assert [r["r"] for r in out.collect()] == [1.0, 1.0, 3.0, 3.0, None, None]


def test_iso_week_and_weekday(spark):
    from demandlens.functions.calendar import calendar_columns
    df = spark.createDataFrame([("2021-01-03",), ("2020-12-31",), ("2024-12-30",), ("2021-01-04",)], "d string")
    out = df.select(*calendar_columns(F.to_date("d"), "base")).collect()
    assert [r["week_of_year"] for r in out[:3]] == [53, 53, 1]
    assert out[0]["day_of_week"] == 6 and out[3]["day_of_week"] == 0


def test_clamp(spark):
    df = _col(spark, [-2.0, float("nan"), None, 3.0]).select("i", clamp_non_negative(F.col("d")).alias("c"))
    assert _ordered(df, "c") == [0.0, 0.0, 0.0, 3.0]


def test_product_percent_error_inf_and_order(spark):
    from demandlens.operators.reports import product_summary
    rows = [("a", 1.0, 0.0, 1.0), ("b", 0.0, 0.0, 0.0), ("c", 3.0, 2.0, 1.0)]
    d = spark.createDataFrame(rows, "KEY string, Predicted_Sales double, Actual_Sales double, Absolute_Error double") \
        .withColumn("DISCOUNT", F.lit(0.1))
    out = product_summary(d).collect()
    assert [r["KEY"] for r in out] == ["a", "c", "b"]
    assert math.isinf(out[0]["Percent_Error"]) and out[1]["Percent_Error"] == 50.0 and out[2]["Percent_Error"] is None


def test_ratio_with_inf(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 2.0)], "n double, d double")
    out = [r[0] for r in df.select(ratio_with_inf(F.col("n"), F.col("d"))).collect()]
    assert out[0] == float("inf") and out[1] == float("-inf") and out[2] is None and out[3] == 50.0


def test_histogram_two_bins(spark):
    from demandlens.operators.histogram import histogram
    df = spark.createDataFrame([(float(v),) for v in range(5)], "x double")
    out = histogram(df, "x", 2).orderBy("bin").collect()
    assert [r["count"] for r in out] == [2, 3]
    assert [r["bin_start"] for r in out] == [0.0, 2.0] and out[-1]["bin_end"] == 4.0


def test_histogram_matches_numpy(spark):
    import numpy as np
    from demandlens.operators.histogram import histogram
    rng = np.random.default_rng(7)
    xs = np.concatenate([rng.exponential(3.0, 500), [0.0, 0.1 * 3, 7.0]])
    df = spark.createDataFrame([(float(v),) for v in xs], "x double")
    counts, edges = np.histogram(xs, bins=30)
    out = histogram(df, "x", 30).orderBy("bin").collect()
    assert [r["count"] for r in out] == counts.tolist()
    assert [r["bin_start"] for r in out] == pytest.approx(edges[:-1].tolist(), abs=1e-12)


def test_one_row_product_defaults(spark):
    from demandlens.operators.features import build_features
    df = spark.createDataFrame([("k", "2021-06-07", 5.0, 0.1, 0.0)],
                               "KEY string, DATE string, QUANTITY_SOLD double, DISCOUNT double, is_eoss double") \
        .withColumn("DATE", F.to_date("DATE"))
    r = build_features(df, "base").first()
    assert (r["trend"], r["trend_diff"], r["seasonal_indicator"]) == (0.5, 0.0, 0.0)


def test_linear_predict_forms_agree(spark):
    import random
    from demandlens.operators.scoring import linear_predict, linear_predict_columns
    rnd = random.Random(5)
    cols = [f"f{i}" for i in range(7)]
    rows = [tuple([rnd.uniform(-3, 3) for _ in cols] + [[rnd.uniform(-1, 1) for _ in cols], rnd.uniform(-1, 1)])
            for _ in range(50)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", coef array<double>, b double")
    out = df.select(linear_predict(F.array(*cols), F.col("b"), F.col("coef")).alias("x"),
                    linear_predict_columns(cols, "b", "coef").alias("y")).collect()
    assert all(r["x"] == r["y"] for r in out)
    short = df.select(linear_predict_columns(cols + ["f0"], "b", "coef").alias("z")).collect()
    assert all(r["z"] is None for r in short)


def test_raw_versus_clipped_discount(spark):
    """nn: interactions and tiers use the raw discount, powers/bins the cleaned
    and clipped one; base: nothing is cleaned before squaring and binning."""
    import datetime as dt
    from demandlens.operators.features import row_features
    rows = [("k", dt.date(2021, 3, 1), 1.0, 1.2, 1.0, 0.0), ("k", dt.date(2021, 3, 8), 1.0, None, 1.0, 0.0),
            ("k", dt.date(2021, 3, 15), 1.0, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "KEY string, DATE date, QUANTITY_SOLD double, DISCOUNT double, "
                                     "is_eoss double, holiday_label double")
    nn = {r["DATE"].day: r for r in row_features(df, "nn").collect()}
    hi, miss, zero = nn[1], nn[8], nn[15]
    assert hi["DISCOUNT"] == 1.0 and hi["DISCOUNT_RAW"] == 1.2 and hi["discount_tier_high"] == 1.0
    assert hi["DISCOUNT_EOSS"] == 1.2 and hi["DISCOUNT_SQUARED"] == 1.0 and hi["DISCOUNT_BIN"] == 4.0
    assert miss["DISCOUNT"] == 0.0 and miss["DISCOUNT_EOSS"] is None
    assert (miss["discount_tier_high"], miss["discount_tier_med"], miss["discount_tier_low"]) == (0.0, 0.0, 0.0)
    assert zero["DISCOUNT_FINE_BIN"] is None and zero["DISCOUNT_BIN"] == 0.0 and zero["discount_tier_low"] == 1.0
    base = {r["DATE"].day: r for r in row_features(df, "base").collect()}
    assert base[1]["DISCOUNT_SQUARED"] == 1.44 and base[1]["DISCOUNT_BIN"] is None
    assert base[8]["DISCOUNT_SQUARED"] is None and base[8]["DISCOUNT_RAW"] is None
