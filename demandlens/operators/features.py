"""Feature profiles, feature assembly and the ordered feature vector.

Two profiles reproduce the two evaluated feature sets:

* ``base`` - calendar, raw-discount square/bin/EOSS interaction, lags,
  rolling means, trend.  The discount is used as given.
* ``nn``   - float calendar, raw-discount interactions and tiers, cleaned and
  clipped discount powers/bins, discount lags and dynamics, lags, rolling
  means, trend.

Optional inputs (DISCOUNT, is_eoss, holiday_label) are checked on
``df.columns`` at plan time; features that need them are simply absent.
``DISCOUNT_RAW`` always carries the discount as read (the value reported in
results and used by calibration).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.functions.calendar import calendar_columns
from demandlens.functions.discount import (
    base_discount_columns, clip01, nn_clean_columns, nn_raw_interactions,
)
from demandlens.functions.numeric import clean_feature
from demandlens.operators.windows import time_series_features
from demandlens.schema import DISCOUNT_LAGS, QUANTITY_LAGS, ROLLING_WINDOWS

_CAL_BASE = ["month", "year", "quarter", "day_of_week", "day_of_year", "week_of_year"]
_CAL_NN = ["month", "quarter", "day_of_week", "week_of_year"]
_CYCLIC = ["month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos", "week_sin", "week_cos"]
_LAGS = [f"lag_{k}" for k in QUANTITY_LAGS]
_ROLL = [f"rolling_mean_{w}" for w in ROLLING_WINDOWS] + ["trend", "trend_diff", "seasonal_indicator"]

BASE_FEATURES = (_CAL_BASE + _CYCLIC
                 + ["DISCOUNT", "DISCOUNT_SQUARED", "DISCOUNT_BIN", "DISCOUNT_EOSS", "is_eoss"]
                 + _LAGS + _ROLL)
NN_FEATURES = (_CAL_NN + _CYCLIC
               + ["DISCOUNT", "DISCOUNT_MONTH", "DISCOUNT_HOLIDAY", "DISCOUNT_EOSS",
                  "discount_tier_high", "discount_tier_med", "discount_tier_low",
                  "EOSS_HIGH_DISCOUNT", "EOSS_MED_DISCOUNT", "EOSS_LOW_DISCOUNT",
                  "DISCOUNT_SQUARED", "DISCOUNT_CUBE", "DISCOUNT_SQRT", "DISCOUNT_LOG",
                  "DISCOUNT_EXP", "DISCOUNT_BIN", "DISCOUNT_FINE_BIN", "is_eoss", "holiday_label"]
               + _LAGS + [f"discount_lag_{k}" for k in DISCOUNT_LAGS]
               + ["discount_change", "discount_acceleration", "days_since_discount_change",
                  "DISCOUNT_PREV_SALES"]
               + _ROLL)


def _opt(df: DataFrame, name: str) -> Column | None:
    return F.col(name) if name in df.columns else None


def row_features(df: DataFrame, profile: str) -> DataFrame:
    """Row-wise (calendar + discount) features of a profile, one ``select``."""
    if profile not in ("base", "nn"):
        raise ValueError(f"unknown profile {profile!r}")
    date = F.col("DATE")
    d, eoss, hol = _opt(df, "DISCOUNT"), _opt(df, "is_eoss"), _opt(df, "holiday_label")
    cal = calendar_columns(date, profile)
    keep = [c for c in df.columns if c != "DISCOUNT"]
    raw = [F.col("DISCOUNT").alias("DISCOUNT_RAW")] if d is not None else [F.lit(0.0).alias("DISCOUNT_RAW")]
    if profile == "base":
        disc = [d.alias("DISCOUNT")] + base_discount_columns(d, eoss) if d is not None else []
        return df.select(*keep, *raw, *cal, *disc)
    # nn: interactions on the raw discount need month_sin, so stage it
    staged = df.select(*keep, *raw, *cal)
    if d is None:
        return staged
    raw_d = F.col("DISCOUNT_RAW")
    inter = nn_raw_interactions(raw_d, F.col("month_sin"), hol, eoss)
    staged = staged.select("*", *inter, clip01(raw_d).alias("DISCOUNT"))
    return staged.select("*", *nn_clean_columns(F.col("DISCOUNT")))


def build_features(df: DataFrame, profile: str, *, leak_free: bool = False) -> DataFrame:
    """All features of a profile (row-wise + windows).  Input: KEY, DATE,
    QUANTITY_SOLD and any optional columns; rows with a missing KEY are dropped."""
    df = df.filter(F.col("KEY").isNotNull())
    rows = row_features(df, profile)
    has_d = "DISCOUNT" in df.columns
    return time_series_features(rows, discount_col="DISCOUNT" if (profile == "nn" and has_d) else None,
                                leak_free=leak_free)


def assemble(df: DataFrame, feature_cols: Sequence[str], *, keep: Sequence[str] = ()) -> DataFrame:
    """Cleaned feature columns in one ``select``: absent names become 0.0,
    +-inf/missing become 0.0, everything double."""
    present = set(df.columns)
    cols = [(clean_feature(c) if c in present else F.lit(0.0)).alias(c) for c in feature_cols]
    return df.select(*keep, *cols)


def feature_vector(feature_cols: Sequence[str]) -> Column:
    """The ordered feature vector (positional, like the model expects)."""
    return F.array(*[F.col(c) for c in feature_cols])


def feature_list(feature_spec: DataFrame) -> list[tuple[str, bool, bool]]:
    """(feature, is_discount, is_categorical) in ``pos`` order, without KEY/DATE.
    The spec has one row per feature, so collecting it is bounded."""
    rows = feature_spec.orderBy("pos").collect()
    return [(r["feature"], bool(r["is_discount"]), bool(r["is_categorical"]))
            for r in rows if r["feature"] not in ("KEY", "DATE")]
