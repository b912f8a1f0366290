"""Side-by-side comparison of two evaluation results.

Rows are paired by (KEY, DATE) with one inner equi-join (both sides hash
partitioned on the pair, or one broadcast when Spark measures it small),
not by position.  The semi-join and intersect forms are kept as operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.functions.bins import report_bin, report_bin_table
from demandlens.schema import MODEL_LABELS

PAIR = ["KEY", "DATE"]


def common_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct (KEY, DATE) present in both results."""
    return a.select(*PAIR).intersect(b.select(*PAIR))


def restrict_to(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of ``df`` whose (KEY, DATE) is in ``pairs``."""
    return df.join(pairs, PAIR, "left_semi")


def display_key(df: DataFrame) -> DataFrame:
    """KEY_DATE text label (display only: concatenation can collide)."""
    return df.withColumn("KEY_DATE", F.concat_ws("_", F.col("KEY"), F.col("DATE").cast("string")))


def pair_results(linear: DataFrame, neural: DataFrame) -> DataFrame:
    """Comparison details with Better_Model and Discount_Bin."""
    l = linear.select(*PAIR, "Actual_Sales", F.col("Predicted_Sales").alias("Linear_Predicted"),
                      F.col("Absolute_Error").alias("Linear_Error"),
                      F.col("Percent_Error").alias("Linear_Pct_Error"), "DISCOUNT", "is_eoss")
    n = neural.select(*PAIR, F.col("Predicted_Sales").alias("Neural_Predicted"),
                      F.col("Absolute_Error").alias("Neural_Error"),
                      F.col("Percent_Error").alias("Neural_Pct_Error"))
    j = l.join(n, PAIR, "inner")
    le, ne = F.col("Linear_Error"), F.col("Neural_Error")
    better = F.when(le < ne, "Linear").when(ne < le, "Neural").otherwise("Equal")
    return j.select(*PAIR, "Actual_Sales", "Linear_Predicted", "Neural_Predicted", "Linear_Error",
                    "Neural_Error", "Linear_Pct_Error", "Neural_Pct_Error", "DISCOUNT", "is_eoss",
                    better.alias("Better_Model"), report_bin(F.col("DISCOUNT")).alias("Discount_Bin"))


def _rate(label: str):
    return F.avg(F.when(F.col("Better_Model") == label, 1.0).otherwise(0.0)) * 100


def comparison_summary(details: DataFrame) -> DataFrame:
    """MAE and MAPE per model and win rates (ties excluded from both)."""
    return details.agg(
        F.count(F.lit(1)).alias("common_predictions"),
        F.avg("Linear_Error").alias("linear_mae"), F.avg("Neural_Error").alias("neural_mae"),
        F.avg("Linear_Pct_Error").alias("linear_mape"), F.avg("Neural_Pct_Error").alias("neural_mape"),
        _rate("Linear").alias("linear_win_rate"), _rate("Neural").alias("neural_win_rate"),
        _rate("Equal").alias("equal_rate"))


def comparison_by_bin(details: DataFrame) -> DataFrame:
    """Per report bin; the neural win rate here is 100 - linear (ties count
    for the neural side), unlike the overall rate."""
    g = (details.filter(F.col("Discount_Bin").isNotNull()).groupBy("Discount_Bin").agg(
        F.sum("Actual_Sales").alias("Actual_Sales"),
        F.sum("Linear_Predicted").alias("Linear_Predicted"),
        F.sum("Neural_Predicted").alias("Neural_Predicted"),
        F.avg("Linear_Error").alias("Linear_Error"), F.avg("Neural_Error").alias("Neural_Error"),
        F.avg("Linear_Pct_Error").alias("Linear_Pct_Error"),
        F.avg("Neural_Pct_Error").alias("Neural_Pct_Error"),
        _rate("Linear").alias("Linear_Win_Rate")))
    bins = F.broadcast(report_bin_table(details.sparkSession))   # 7 rows
    out = bins.join(g, "Discount_Bin", "left")
    zero = F.lit(0.0)
    return out.select(
        "bin_ordinal", "Discount_Bin",
        F.coalesce("Actual_Sales", zero).alias("Actual_Sales"),
        F.coalesce("Linear_Predicted", zero).alias("Linear_Predicted"),
        F.coalesce("Neural_Predicted", zero).alias("Neural_Predicted"),
        "Linear_Error", "Neural_Error", "Linear_Pct_Error", "Neural_Pct_Error", "Linear_Win_Rate",
        (F.lit(100.0) - F.col("Linear_Win_Rate")).alias("Neural_Win_Rate"))


def bin_error_long(details: DataFrame) -> DataFrame:
    """(Discount_Bin, Model, Error): mean error per bin and model, long form."""
    wide = comparison_by_bin(details).select("bin_ordinal", "Discount_Bin", "Linear_Error", "Neural_Error")
    long = wide.unpivot(["bin_ordinal", "Discount_Bin"], list(MODEL_LABELS), "Model", "Error")
    label = None
    for k, v in MODEL_LABELS.items():
        cond = F.col("Model") == k
        label = F.when(cond, F.lit(v)) if label is None else label.when(cond, F.lit(v))
    return long.select("bin_ordinal", "Discount_Bin", label.alias("Model"), "Error")
