"""Plan shape and invariants on the sf0.001 panel."""

import pytest
from pyspark.sql import functions as F

import registered
from demandlens.operators.features import build_features
from tests.conftest import SF_SMALL


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def panel(spark):
    return registered.panel(spark, SF_SMALL)


def test_feature_stage_single_exchange_and_sort(spark, panel):
    txt = plan_text(build_features(panel, "nn"))
    assert txt.count("Exchange hashpartitioning(KEY") == 1
    assert txt.count("Sort [KEY") == 1


def test_linear_scoring_has_no_python(spark):
    txt = plan_text(registered.details_a(spark, SF_SMALL))
    assert "Python" not in txt and "ArrowEval" not in txt


def test_sequence_scoring_crosses_to_python_once(spark):
    txt = plan_text(registered.q_sequence_scores(spark, SF_SMALL))
    assert txt.count("MapInArrow") == 1


def test_bin_calibration_broadcast_and_topk(spark):
    d = registered.details_a(spark, SF_SMALL)
    assert "BroadcastHashJoin" in plan_text(d)
    from demandlens.operators.reports import top_error_products
    assert "TakeOrderedAndProject" in plan_text(top_error_products(d))


def test_leakage_invariant(spark, panel):
    f = build_features(panel, "base").filter(F.col("_rn") > 1)
    bad = f.filter(F.abs(F.col("lag_1") + F.col("trend_diff") - F.col("QUANTITY_SOLD")) > 1e-9).count()
    assert bad == 0


def test_bins_plus_unbinned_equal_overall(spark):
    from demandlens.operators import reports as R
    d = registered.details_a(spark, SF_SMALL)
    binned = R.bin_performance(d).agg(F.sum("Actual_Sales_count")).first()[0]
    unbinned = d.filter(F.col("Discount_Bin").isNull() & F.col("Actual_Sales").isNotNull()).count()
    assert binned + unbinned == d.filter(F.col("Actual_Sales").isNotNull()).count()
    assert d.filter(F.col("Predicted_Sales") < 0).count() == 0


def test_calibration_outcomes_all_present(spark):
    d = registered.details_a(spark, SF_SMALL)
    levels = {r[0] for r in d.select("calibration_level").distinct().collect()}
    assert levels <= {"product_eoss", "product_discount", "product", "discount_bin", "none"}
    assert {"product", "discount_bin", "none"} <= levels


def lineitem_scans(txt):
    return sum("FileScan" in line and "l_partkey" in line for line in txt.splitlines())


def test_one_scan_of_the_history(spark):
    """Gates, scope, parameters and the audit derive nothing from the panel a second time."""
    ev = registered.linear_eval(spark, SF_SMALL, min_history=200)
    for df in (ev.details, ev.skips, registered.q_sequence_scores(spark, SF_SMALL)):
        assert lineitem_scans(plan_text(df)) == 1
    assert "LeftAnti" not in plan_text(ev.skips) and "LeftSemi" not in plan_text(ev.details)


def test_reports_run_no_job_before_the_action(spark):
    from demandlens.operators import reports as R
    from demandlens.operators.histogram import histograms
    d = registered.linear_eval(spark, SF_SMALL).details
    sc = spark.sparkContext
    sc.setJobGroup("lazy", "lazy")
    try:
        R.eoss_mae(d)
        histograms(d, {"a": "Absolute_Error", "b": "Percent_Error"}, 5)
        assert list(sc.statusTracker().getJobIdsForGroup("lazy")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_stored_results_pair_without_exchange(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        txt = plan_text(registered.q_compare_colocated(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in txt and "Exchange" not in txt


def test_sequence_tensor():
    import numpy as np
    import pyarrow as pa
    from demandlens.operators.scoring import sequence_tensor
    seq = pa.array([[[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0], [7.0, None]], [[9.0, 1.0], [2.0, 3.0]]])
    x = sequence_tensor(seq)
    assert x.shape == (3, 2, 2) and np.isnan(x[1, 1, 1]) and x[2].tolist() == [[9.0, 1.0], [2.0, 3.0]]
    assert sequence_tensor(seq[2:]).tolist() == [[[9.0, 1.0], [2.0, 3.0]]] and len(sequence_tensor(seq[:0])) == 0
    with pytest.raises(ValueError):
        sequence_tensor(pa.array([[[1.0], [2.0]], [[1.0]]]))


@pytest.mark.parametrize("batch", [1, 7, 256, 10_000])
def test_sequence_scores_do_not_depend_on_batches(spark, batch):
    from demandlens.operators.scoring import MeanOfFeature, score_sequences
    rows = [(i, [[float(i), 1.0], [float(i + 1), float("nan")]]) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, sequence array<array<double>>").repartition(3)
    for col, want in ((0, lambda i: i + 0.5), (1, lambda i: None)):
        got = score_sequences(df, MeanOfFeature(col), batch_size=batch).collect()
        assert {r.i: r.Raw_Prediction for r in got} == {i: want(i) for i in range(50)}
