"""Schemas and the fixed values the evaluation semantics depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the evaluated system's values for the
# results to be identical; they are stated here once, in natural order.
# ---------------------------------------------------------------------------
QUANTITY_LAGS = (1, 2, 3, 4, 8, 12, 26, 52)
DISCOUNT_LAGS = (1, 2, 4)
ROLLING_WINDOWS = (4, 8, 12)
SEASON_MONTHS = (12, 1, 6, 7)
SINGLE_ROW_TREND = 0.5
PERCENT_EPSILON = 1e-5            # Percent_Error = abs / (actual + eps) * 100
PREV_SALES_EPSILON = 1e-5         # DISCOUNT_PREV_SALES denominator
CHANGE_THRESHOLD = 0.05           # |discount_change| >= this is a change point
TIER_HIGH = 0.4
TIER_MED = 0.2
EXP_CAP = 0.3
DISCOUNT_BIN_EDGES = (-0.001, 0.05, 0.15, 0.25, 0.35, 1.0)          # labels 0..4
FINE_BIN_EDGES = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.75, 1.0)  # labels 0..9
REPORT_BIN_EDGES = (-0.001, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 1.0)
REPORT_BIN_LABELS = ("0-5%", "5-10%", "10-15%", "15-20%", "20-30%", "30-40%", "40%+")
CALIBRATION_BIN_UPPER = (0.1, 0.2, 0.3, 0.4)
CALIBRATION_BIN_LABELS = ("0-10%", "10-20%", "20-30%", "30-40%", "40%+")
CALIBRATION_LEVELS = ("product_eoss", "product_discount", "product", "discount_bin")
EOSS_LABELS = {0.0: "Non-EOSS", 1.0: "EOSS"}
MODEL_LABELS = {"Linear_Error": "Linear", "Neural_Error": "Neural"}
UNDER_WEIGHT = 1.5
OVER_WEIGHT = 1.0
LOSS_PRED_FLOOR = 1e-7
LOSS_ERROR_CLIP = 1e6
HIST_BINS = 50
COMPARE_HIST_BINS = 30
SCATTER_MARGIN = 1.1
TOP_K = 10
SHORT_LABEL_LEN = 10
SEQUENCE_LENGTH = 52
MIN_TRAIN_ROWS_LINEAR = 5
METRIC_LABELS = (
    ("total_products", "Total Products"),
    ("total_predictions", "Total Predictions"),
    ("mean_absolute_error", "Mean Absolute Error"),
    ("median_absolute_error", "Median Absolute Error"),
    ("mean_percent_error", "Mean Percent Error"),
    ("median_percent_error", "Median Percent Error"),
    ("total_actual_sales", "Total Actual Sales"),
    ("total_predicted_sales", "Total Predicted Sales"),
    ("overall_error", "Overall Error"),
)
# ---------------------------------------------------------------------------

PANEL_SCHEMA = T.StructType([
    T.StructField("KEY", T.StringType()),
    T.StructField("DATE", T.DateType()),
    T.StructField("QUANTITY_SOLD", T.DoubleType()),
    T.StructField("DISCOUNT", T.DoubleType()),
    T.StructField("is_eoss", T.DoubleType()),
    T.StructField("holiday_label", T.DoubleType()),
])

RESULT_SCHEMA = T.StructType([
    T.StructField("KEY", T.StringType()),
    T.StructField("DATE", T.DateType()),
    T.StructField("Actual_Sales", T.DoubleType()),
    T.StructField("Predicted_Sales", T.DoubleType()),
    T.StructField("Raw_Prediction", T.DoubleType()),
    T.StructField("Absolute_Error", T.DoubleType()),
    T.StructField("Percent_Error", T.DoubleType()),
    T.StructField("DISCOUNT", T.DoubleType()),
    T.StructField("is_eoss", T.DoubleType()),
])

RESULT_COLUMNS = [f.name for f in RESULT_SCHEMA.fields]

FEATURE_SPEC_SCHEMA = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("feature", T.StringType()),
    T.StructField("is_discount", T.BooleanType()),
    T.StructField("is_categorical", T.BooleanType()),
])

LINEAR_MODEL_SCHEMA = T.StructType([
    T.StructField("KEY", T.StringType()),
    T.StructField("intercept", T.DoubleType()),
    T.StructField("coef", T.ArrayType(T.DoubleType())),
])

SCALER_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("kind", T.StringType()),      # 'standard' (p1 mean, p2 scale) | 'minmax' (p1 scale, p2 min)
    T.StructField("p1", T.DoubleType()),
    T.StructField("p2", T.DoubleType()),
])

CALIBRATION_SCHEMA = T.StructType([
    T.StructField("level", T.StringType()),
    T.StructField("KEY", T.StringType()),
    T.StructField("is_eoss", T.DoubleType()),
    T.StructField("discount_bin", T.StringType()),
    T.StructField("factor", T.DoubleType(), nullable=False),
])


def is_discount_feature(name: str) -> bool:
    """A feature belongs to the discount scaling set if its name mentions discount."""
    return "discount" in name.lower()
