"""Per-product linear model evaluation over one tagged history.

Plan shape (one scan of the history, one shuffle, one sort):

  history (split = train / test)  -->  hash(KEY), sort (KEY, DATE)
    -> row features -> windows; gates and scope are window flags
    -> test rows -> clean/scale (projection)
    -> left join model on KEY (co-partitioned, or broadcast if Spark measures it small)
    -> intercept + sum coef[i] * x_i  (flat codegen'd expression, no Python)
    -> reason, if any: the skip audit and the details are two filters of this
    -> calibration join on KEY -> clamp, errors, report bin

Nothing is derived from the history a second time: no key sets, no semi joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.operators.calibration import apply_calibration
from demandlens.operators.features import assemble, build_features, feature_list
from demandlens.operators.scaling import standard_scale
from demandlens.operators.scoring import finalize_results, linear_predict_columns
from demandlens.plans.common import TEST, Evaluation, judge, result_inputs, union_history
from demandlens.schema import MIN_TRAIN_ROWS_LINEAR
from demandlens.session import prepare_session
from demandlens.sources.readers import normalize


def one_model_per_key(models: DataFrame) -> DataFrame:
    """(KEY, intercept, coef), failing on a key with several models.  Grouped
    on KEY, the column of the join that follows, so no further exchange."""
    grouped = models.filter(F.col("KEY").isNotNull()).groupBy("KEY").agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct("intercept", "coef")).alias("_m"))
    several = F.raise_error(F.concat(F.lit("more than one model for KEY "), F.col("KEY")))
    model = F.when(F.col("_n") > 1, several.cast(grouped.schema["_m"].dataType)).otherwise(F.col("_m"))
    return grouped.select("KEY", model.alias("_m")).select("KEY", "_m.intercept", "_m.coef")


RESULT_KEEP = ["KEY", "DATE", "Actual_Sales", "DISCOUNT_IN", "EOSS_IN"]
FLAGS = ["split", "_n_train", "_test_no", "_dup"]


def judged_rows(feats: DataFrame, models: DataFrame, feature_cols: list[str], scaler: DataFrame | None,
                min_history: int) -> DataFrame:
    """Every test row with its raw prediction and, if it has no result, the reason;
    also the other rows of evaluated products that repeat a date."""
    is_test = F.col("split") == TEST
    rows = feats.filter(is_test | (F.col("_dup") & (F.col("_n_test") > 0)))
    inputs = result_inputs(rows)
    staged = rows.select("*", inputs[2], inputs[3].alias("DISCOUNT_IN"), inputs[4].alias("EOSS_IN"))
    assembled = assemble(staged, feature_cols, keep=RESULT_KEEP + FLAGS)
    if scaler is not None:
        assembled = standard_scale(assembled, feature_cols, scaler)
    joined = assembled.join(one_model_per_key(models).withColumn("_model", F.lit(True)), "KEY", "left")
    known = F.coalesce(F.col("_model"), F.lit(False))
    usable = F.coalesce((F.size("coef") == len(feature_cols)) & F.col("intercept").isNotNull(), F.lit(False))
    return joined.select(
        "KEY", "DATE", "Actual_Sales", F.col("DISCOUNT_IN").alias("DISCOUNT"), F.col("EOSS_IN").alias("is_eoss"),
        linear_predict_columns(feature_cols, "intercept", "coef").alias("Raw_Prediction"),
        "split", "_n_train", "_model", usable.alias("_usable"), (is_test & (F.col("_test_no") == 1)).alias("_first"),
        (F.col("_dup") & known).alias("_repeated"),
        judge([("no_model", is_test & ~known), ("insufficient_history", is_test & (F.col("_n_train") < min_history)),
               ("missing_date", is_test & F.col("DATE").isNull()), ("incomplete_features", is_test & ~usable)]))


def evaluate_history(history: DataFrame, models: DataFrame, feature_spec: DataFrame, *,
                     scaler: DataFrame | None = None, calibration: DataFrame | None = None,
                     min_history: int = MIN_TRAIN_ROWS_LINEAR, leak_free: bool = False) -> Evaluation:
    """Score every test row (``split`` = 'test') of every product that has a model
    and at least ``min_history`` train rows.  ``leak_free`` moves the rolling/trend
    frames strictly before the scored row (the default reproduces the original,
    whose rolling means include the row's own actual)."""
    prepare_session(history.sparkSession)
    feature_cols = [f for f, _, _ in feature_list(feature_spec)]
    feats = build_features(normalize(history), "base", leak_free=leak_free)
    judged = judged_rows(feats, normalize(models), feature_cols, scaler, min_history)

    def finish(rows: DataFrame) -> DataFrame:
        # spelled as single conditions, so each one reaches the side of the join it reads
        good = rows.filter((F.col("split") == TEST) & F.col("_model") & (F.col("_n_train") >= min_history)
                           & F.col("DATE").isNotNull() & F.col("_usable"))
        scored = good.select("KEY", "DATE", "Actual_Sales", "DISCOUNT", "is_eoss", "Raw_Prediction")
        return finalize_results(apply_calibration(scored, calibration))

    return Evaluation(judged, finish)


def evaluate_linear(train: DataFrame, test: DataFrame, models: DataFrame, feature_spec: DataFrame, *,
                    scaler: DataFrame | None = None, calibration: DataFrame | None = None,
                    min_history: int = MIN_TRAIN_ROWS_LINEAR, leak_free: bool = False) -> Evaluation:
    """``evaluate_history`` of separate train and test tables."""
    return evaluate_history(union_history(normalize(train), normalize(test)), models, feature_spec, scaler=scaler,
                            calibration=calibration, min_history=min_history, leak_free=leak_free)
