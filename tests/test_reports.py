"""Reports on hand-made details: empty bins, ties, comparison pairing, DQ, medians."""

import statistics

from pyspark.sql import functions as F

from demandlens.functions.bins import report_bin
from demandlens.operators import compare as C
from demandlens.operators import reports as R
from demandlens.operators.quality import duplicate_keys
from demandlens.operators.quantiles import exact_median, exact_medians
from demandlens.plans.comparison import compare_models


def details(spark, rows):
    df = spark.createDataFrame(rows, "KEY string, DATE date, Actual_Sales double, Predicted_Sales double, "
                                     "DISCOUNT double, is_eoss double")
    ae = F.abs(F.col("Predicted_Sales") - F.col("Actual_Sales"))
    return df.select("*", ae.alias("Absolute_Error"),
                     (ae / (F.col("Actual_Sales") + 1e-5) * 100).alias("Percent_Error"),
                     report_bin(F.col("DISCOUNT")).alias("Discount_Bin"))


def test_empty_bins_appear(spark):
    import datetime as dt
    d = details(spark, [("a", dt.date(2021, 1, 4), 1.0, 2.0, .01, 0.0),
                        ("a", dt.date(2021, 1, 11), 3.0, 2.0, .02, 0.0)])
    out = {r["Discount_Bin"]: r for r in R.bin_performance(d).collect()}
    assert len(out) == 7
    empty = [r for k, r in out.items() if k != "0-5%"]
    assert all(r["Actual_Sales_sum"] == 0.0 and r["Actual_Sales_count"] == 0 and r["Actual_Sales_mean"] is None
               for r in empty)
    assert out["0-5%"]["Actual_Sales_count"] == 2


def test_unbinned_rows_stay_in_totals(spark):
    import datetime as dt
    d = details(spark, [("a", dt.date(2021, 1, 4), 1.0, 2.0, None, 0.0),
                        ("b", dt.date(2021, 1, 4), 3.0, 2.0, .2, 1.0),
                        ("c", dt.date(2021, 1, 4), 5.0, 2.0, 1.5, 1.0)])
    bins = R.bin_performance(d).agg(F.sum("Actual_Sales_count"), F.sum("Actual_Sales_sum")).first()
    m = R.metrics_summary(d).first()
    assert bins[0] == 1 and bins[1] == 3.0
    assert m["total_predictions"] == 3 and m["total_actual_sales"] == 9.0


def test_top_k_ties_alphabetical(spark):
    import datetime as dt
    rows = [(k, dt.date(2021, 1, 4), 5.0, 5.0, .1, 0.0) for k in ("c", "a", "b")]
    d = details(spark, rows)
    assert [r["KEY"] for r in R.top_volume_products(d, k=2).collect()] == ["a", "b"]


def test_comparison_pairs_by_key_not_position(spark):
    import datetime as dt
    rows = [("a", dt.date(2021, 1, 4), 1.0, 1.0, .1, 0.0), ("b", dt.date(2021, 1, 4), 2.0, 5.0, .1, 0.0)]
    a = details(spark, rows)
    b = details(spark, [(k, d, act, pred + 1, disc, e) for k, d, act, pred, disc, e in reversed(rows)])
    out = {r["KEY"]: r for r in compare_models(a, b).details.collect()}
    assert out["a"]["Linear_Predicted"] == 1.0 and out["a"]["Neural_Predicted"] == 2.0
    assert out["b"]["Better_Model"] == "Linear"


def test_equal_and_win_rates(spark):
    import datetime as dt
    rows = [("a", dt.date(2021, 1, 4), 1.0, 2.0, .1, 0.0), ("b", dt.date(2021, 1, 4), 1.0, 3.0, .1, 0.0)]
    a = details(spark, rows)
    b = details(spark, [("a", dt.date(2021, 1, 4), 1.0, 0.0, .1, 0.0), ("b", dt.date(2021, 1, 4), 1.0, 1.0, .1, 0.0)])
    cmp = compare_models(a, b)
    s = cmp.summary.first()
    assert s["linear_win_rate"] + s["neural_win_rate"] + s["equal_rate"] == 100.0
    assert s["equal_rate"] == 50.0
    row = [r for r in cmp.by_bin.collect() if r["Discount_Bin"] == "5-10%"][0]
    assert row["Linear_Win_Rate"] == 0.0 and row["Neural_Win_Rate"] == 100.0   # ties count as neural here


def test_common_pairs_and_restrict(spark):
    import datetime as dt
    a = details(spark, [("a", dt.date(2021, 1, 4), 1.0, 2.0, .1, 0.0), ("x", dt.date(2021, 1, 4), 1.0, 2.0, .1, 0.0)])
    b = details(spark, [("a", dt.date(2021, 1, 4), 1.0, 2.0, .1, 0.0)])
    pairs = C.common_pairs(a, b)
    assert pairs.count() == 1 and C.restrict_to(a, pairs).count() == 1


def test_duplicate_keys_reported(spark):
    import datetime as dt
    df = spark.createDataFrame([("a", dt.date(2021, 1, 4)), ("a", dt.date(2021, 1, 4)), ("b", dt.date(2021, 1, 4))],
                               "KEY string, DATE date")
    out = duplicate_keys(df).collect()
    assert [(r["KEY"], r["rows"]) for r in out] == [("a", 2)]


def test_exact_median_matches_python(spark):
    import random
    rnd = random.Random(3)
    for n in (1, 2, 7, 1000, 1001):
        vals = [float(rnd.choice([0, 0, 0, 1.5, rnd.random() * 100])) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in vals], "x double")
        assert exact_median(df, "x") == statistics.median(vals)


def test_exact_medians_many_ties_and_nulls(spark):
    vals = [0.0] * 500 + [1.0] * 10 + [None] * 5
    df = spark.createDataFrame([(v, v) for v in vals], "x double, y double")
    assert exact_medians(df, ["x", "y"]) == {"x": 0.0, "y": 0.0}


def test_eoss_guard_needs_two_values(spark):
    import datetime as dt
    d = details(spark, [("a", dt.date(2021, 1, 4), 1.0, 2.0, .1, 0.0)])
    assert R.eoss_mae(d).count() == 0


def test_duplicate_date_reported_in_skips(spark):
    import datetime as dt
    from demandlens.plans.linear import evaluate_linear
    from demandlens.sources import fixtures as fx
    days = [dt.date(2021, 1, 4) + dt.timedelta(days=7 * i) for i in range(8)]
    train = spark.createDataFrame([("k", d, 1.0, 0.1, 0.0, 0.0) for d in days[:6]] + [("k", days[2], 2.0, 0.1, 0.0, 0.0)],
                                  "KEY string, DATE date, QUANTITY_SOLD double, DISCOUNT double, is_eoss double, "
                                  "holiday_label double")
    test = spark.createDataFrame([("k", d, 1.0, 0.1, 0.0, 0.0) for d in days[6:]], train.schema)
    models = spark.createDataFrame([("k", 0.0, [0.0] * len(fx.profile_features("base")))],
                                   "KEY string, intercept double, coef array<double>")
    ev = evaluate_linear(train, test, models, fx.feature_spec(spark, "base"))
    reasons = [r["reason"] for r in ev.skips.collect()]
    assert reasons == ["duplicate_key_date"] and ev.details.count() == 2


def test_empty_details_give_full_schema_outputs(spark):
    from demandlens.operators.histogram import histogram
    d = details(spark, [])
    m = R.metrics_summary(d).first()
    assert m["total_predictions"] == 0 and m["median_absolute_error"] is None and m["overall_error"] is None
    bins = R.bin_performance(d).collect()
    assert len(bins) == 7 and all(r["Actual_Sales_count"] == 0 for r in bins)
    assert [r["count"] for r in histogram(d, "Absolute_Error", 3).collect()] == [0, 0, 0]
    assert compare_models(d, d).details.count() == 0


def test_median_methods_agree_on_small_data(spark):
    import datetime as dt
    rows = [("a", dt.date(2021, 1, 4) + dt.timedelta(days=7 * i), float(i % 5), float(i % 3), .1, 0.0)
            for i in range(41)]
    d = details(spark, rows)
    exact = R.metrics_summary(d, median="exact").first()
    pct = R.metrics_summary(d, median="percentile").first()
    approx = R.metrics_summary(d, median="approx").first()
    assert exact["median_absolute_error"] == pct["median_absolute_error"] == approx["median_absolute_error"]


def test_exact_medians_by_radix(spark, monkeypatch):
    """All values distinct, of both signs and all sizes; infinities; only nulls.  No pass
    returns more than a bucket table for each rank, and nothing is ordered in one task."""
    import random
    from demandlens.operators import quantiles
    sizes, buckets = [], quantiles._buckets

    def counted(*args):
        out = buckets(*args)
        sizes.append(len(out))
        return out

    def never(*_):
        raise AssertionError("one task")

    monkeypatch.setattr(quantiles, "_buckets", counted)
    monkeypatch.setattr(quantiles.F, "percentile", never)
    rnd = random.Random(1)
    vals = [rnd.choice([-1, 1]) * rnd.random() * 10.0 ** rnd.randrange(-300, 300) for _ in range(4000)]
    vals += [0.0, -0.0, 5e-324, -5e-324, 1.7976931348623157e308]
    rows = [(v, float("-inf") if i < 3000 else v, None, [-3.0, -1.0, float("nan"), None][i % 4]) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "x double, y double, z double, w double")
    assert exact_medians(df, ["x", "y", "z", "w"]) == {"x": statistics.median(vals), "y": float("-inf"), "z": None, "w": -3.0}
    assert len(sizes) == 4 and max(sizes) <= 2 * 3 * 65536


def test_order_keys_keep_the_order(spark):
    from demandlens.operators.quantiles import order_key, value_of
    xs = [float("-inf"), -1e300, -2.0, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1.5, 2.0, 1e300, float("inf")]
    keys = [r.k for r in spark.createDataFrame([(x,) for x in xs], "x double").select(order_key(F.col("x")).alias("k")).collect()]
    assert keys == sorted(set(keys)) and [value_of(k) for k in keys] == xs
    assert spark.createDataFrame([(-0.0,)], "x double").select(order_key(F.col("x"))).first()[0] == 0


def test_top_volume_rows(spark):
    import datetime as dt
    d = details(spark, [(k, dt.date(2021, 1, 4 + i), v, 2.0, .1, 0.0) for k, v in (("a", 1.0), ("b", 5.0), ("c", 5.0), ("d", 2.0)) for i in range(3)])
    assert sorted((r.KEY, r.DATE.day) for r in R.top_volume_rows(d, 2).collect()) == [(k, 4 + i) for k in "bc" for i in range(3)]
