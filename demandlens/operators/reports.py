"""Error metrics and reports over evaluation details.

Every report aggregates with partial (map-side) aggregation; bin reports
left-join their result onto the fixed 7-row bin table (broadcast, proven
size) so empty bins appear with sum 0, count 0 and NULL means, and rows
without a bin are left out of bin reports but not of the overall metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.functions.bins import report_bin_table
from demandlens.functions.numeric import ratio_with_inf
from demandlens.operators.quantiles import medians_of_keys, order_key, quick_medians
from demandlens.schema import (
    EOSS_LABELS, LOSS_ERROR_CLIP, LOSS_PRED_FLOOR, METRIC_LABELS, OVER_WEIGHT, SCATTER_MARGIN,
    SHORT_LABEL_LEN, TOP_K, UNDER_WEIGHT,
)
from demandlens.session import materialize


def _sum0(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


MEDIANS = {"Absolute_Error": "median_absolute_error", "Percent_Error": "median_percent_error"}


def metrics_summary(details: DataFrame, *, median: str = "exact") -> DataFrame:
    """One row: products, predictions, mean/median absolute and percent error,
    totals and overall error %.  ``median``: 'exact' (distributed, see
    ``quantiles``; the columns it needs are written once, so the evaluation behind
    ``details`` runs once), 'approx' (``percentile_approx``) or 'percentile'."""
    if median == "exact":
        cols = ["KEY", "Actual_Sales", "Predicted_Sales", *MEDIANS]
        details = materialize(details.select(*cols, *[order_key(F.col(c)).alias(f"k{i}") for i, c in enumerate(MEDIANS)]),
                              "metrics")
        found = medians_of_keys(details, len(MEDIANS))
        meds = {name: F.lit(v).cast("double") for name, v in zip(MEDIANS.values(), found)}
    else:
        meds = quick_medians(MEDIANS, median)
    totals = details.agg(
        F.countDistinct("KEY").alias("total_products"),
        F.count(F.lit(1)).alias("total_predictions"),
        F.avg("Absolute_Error").alias("mean_absolute_error"),
        F.avg("Percent_Error").alias("mean_percent_error"),
        _sum0("Actual_Sales").alias("total_actual_sales"),
        _sum0("Predicted_Sales").alias("total_predicted_sales"),
        *[c.alias(n) for n, c in meds.items()])
    ta, tp = F.col("total_actual_sales"), F.col("total_predicted_sales")
    return totals.select(*[c for c, _ in METRIC_LABELS if c != "overall_error"],
                         ratio_with_inf(tp - ta, ta).alias("overall_error"))


def metrics_long(summary: DataFrame) -> DataFrame:
    """(pos, metric, value) - the summary as labelled rows."""
    cols = [F.col(c).cast("double").alias(label) for c, label in METRIC_LABELS]
    long = summary.select(*cols).unpivot([], [label for _, label in METRIC_LABELS], "metric", "value")
    order = F.array_position(F.array(*[F.lit(label) for _, label in METRIC_LABELS]), F.col("metric"))
    return long.select((order - 1).cast("int").alias("pos"), "metric", "value")


def _by_bin(details: DataFrame, aggs: list[Column], fills: dict[str, Column] | None = None) -> DataFrame:
    grouped = (details.filter(F.col("Discount_Bin").isNotNull())
               .groupBy("Discount_Bin").agg(*aggs))
    bins = F.broadcast(report_bin_table(details.sparkSession))
    out = bins.join(grouped, "Discount_Bin", "left")
    if fills:
        out = out.select(*[fills.get(c, F.col(c)).alias(c) if c in fills else F.col(c) for c in out.columns])
    return out


def bin_performance(details: DataFrame) -> DataFrame:
    """Per report bin: sums, means, count of actuals, total and percent error."""
    out = _by_bin(details, [
        F.sum("Actual_Sales").alias("Actual_Sales_sum"),
        F.avg("Actual_Sales").alias("Actual_Sales_mean"),
        F.count("Actual_Sales").alias("Actual_Sales_count"),
        F.sum("Predicted_Sales").alias("Predicted_Sales_sum"),
        F.avg("Predicted_Sales").alias("Predicted_Sales_mean"),
        F.avg("Absolute_Error").alias("Absolute_Error_mean"),
        F.avg("Percent_Error").alias("Percent_Error_mean"),
    ], {"Actual_Sales_sum": F.coalesce(F.col("Actual_Sales_sum"), F.lit(0.0)),
        "Actual_Sales_count": F.coalesce(F.col("Actual_Sales_count"), F.lit(0)),
        "Predicted_Sales_sum": F.coalesce(F.col("Predicted_Sales_sum"), F.lit(0.0))})
    te = F.col("Predicted_Sales_sum") - F.col("Actual_Sales_sum")
    return out.select("*", te.alias("Total_Error"),
                      ratio_with_inf(te, F.col("Actual_Sales_sum")).alias("Error_Percent"))


def bin_mae(details: DataFrame) -> DataFrame:
    """Mean absolute error per report bin (chart data)."""
    return _by_bin(details, [F.avg("Absolute_Error").alias("Absolute_Error")])


def bin_means(details: DataFrame) -> DataFrame:
    """Mean actual and predicted per report bin (chart data)."""
    return _by_bin(details, [F.avg("Actual_Sales").alias("Actual_Sales"),
                             F.avg("Predicted_Sales").alias("Predicted_Sales")])


def eoss_mae(details: DataFrame) -> DataFrame:
    """Mean absolute error per is_eoss value, only when there is more than one
    value; labelled EOSS / Non-EOSS (other values get no label)."""
    grouped = (details.filter(F.col("is_eoss").isNotNull()).groupBy("is_eoss")
               .agg(F.avg("Absolute_Error").alias("Absolute_Error")))
    label = None
    for v, name in EOSS_LABELS.items():
        cond = F.col("is_eoss") == F.lit(v)
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    out = grouped.select("is_eoss", "Absolute_Error", label.alias("EOSS_Status"))
    # a scalar subquery over the same aggregate, so its shuffle is reused
    values = grouped.agg(F.count(F.struct("is_eoss", "Absolute_Error"))).scalar()
    return out.filter(values > 1)


def product_summary(details: DataFrame) -> DataFrame:
    """Per product: summed actual/predicted, mean absolute error and discount,
    total error and percent error (+inf/-inf when actual is 0, NULL for 0/0).
    Ordered by percent error descending, missing last, ties by KEY."""
    g = details.groupBy("KEY").agg(
        _sum0("Actual_Sales").alias("Actual_Sales"),
        _sum0("Predicted_Sales").alias("Predicted_Sales"),
        F.avg("Absolute_Error").alias("Absolute_Error"),
        F.avg("DISCOUNT").alias("DISCOUNT"))
    te = F.col("Predicted_Sales") - F.col("Actual_Sales")
    return (g.select("*", te.alias("Total_Error"),
                     ratio_with_inf(te, F.col("Actual_Sales")).alias("Percent_Error"))
            .orderBy(F.desc_nulls_last("Percent_Error"), F.asc("KEY")))


def top_error_products(details: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k products with the largest percent error (TakeOrderedAndProject)."""
    return (product_summary(details)
            .select("KEY", "Actual_Sales", "Predicted_Sales", "Percent_Error", "DISCOUNT")
            .orderBy(F.desc_nulls_last("Percent_Error"), F.asc("KEY")).limit(k))


def top_volume_products(details: DataFrame, k: int = TOP_K) -> DataFrame:
    """Totals of the k best-selling products, best first, with a short label."""
    g = details.groupBy("KEY").agg(_sum0("Actual_Sales").alias("Actual_Sales"),
                                   _sum0("Predicted_Sales").alias("Predicted_Sales"))
    label = F.concat(F.substring("KEY", 1, SHORT_LABEL_LEN), F.lit("..."))
    return g.select("KEY", label.alias("Label"), "Actual_Sales", "Predicted_Sales") \
            .orderBy(F.desc("Actual_Sales"), F.asc("KEY")).limit(k)


def top_volume_rows(details: DataFrame, k: int = TOP_K) -> DataFrame:
    """All rows of the k best-selling products: a semi join with the top keys,
    which are at most ``k`` rows and so broadcast."""
    top = top_volume_products(details, k).select("KEY")
    return details.join(F.broadcast(top), "KEY", "left_semi")


def scatter_limit(details: DataFrame) -> DataFrame:
    """Axis limit of the actual-vs-predicted chart."""
    return details.agg((F.greatest(F.max("Actual_Sales"), F.max("Predicted_Sales"))
                        * F.lit(SCATTER_MARGIN)).alias("max_val"))


def discount_sensitive_loss(details: DataFrame, *, actual: str = "Actual_Sales",
                            predicted: str = "Predicted_Sales",
                            group_by: list[str] | None = None) -> DataFrame:
    """Mean of w * clip(e)^2, e = actual - max(predicted, 1e-7),
    w = 1.5 for under-prediction (e > 0) else 1.0."""
    e = F.col(actual) - F.greatest(F.col(predicted), F.lit(LOSS_PRED_FLOOR))
    w = F.when(e > 0, F.lit(UNDER_WEIGHT)).otherwise(F.lit(OVER_WEIGHT))
    clipped = F.least(F.greatest(e, F.lit(-LOSS_ERROR_CLIP)), F.lit(LOSS_ERROR_CLIP))
    loss = F.avg(w * clipped * clipped).alias("loss")
    if group_by:
        return details.groupBy(*group_by).agg(loss, F.count(F.lit(1)).alias("n"))
    return details.agg(loss, F.count(F.lit(1)).alias("n"))
