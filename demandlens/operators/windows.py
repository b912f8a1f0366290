"""Per-product time-series features with window functions.

All features of a profile share ONE partitioning (KEY) and ONE ordering
(DATE ascending, missing dates last), so the whole feature stage costs a
single hash exchange and a single sort; stacked ``Window`` operators reuse
them.  A product's partition holds one row per date, so its size is bounded
by the calendar, not by the data volume.

Contract: (KEY, DATE) is unique (see ``quality.duplicate_keys``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandlens.schema import (
    CHANGE_THRESHOLD, DISCOUNT_LAGS, PREV_SALES_EPSILON, QUANTITY_LAGS, ROLLING_WINDOWS,
    SEASON_MONTHS, SINGLE_ROW_TREND,
)

def by_key():
    """The whole product partition.  Spelled as the time-ordered spec with a
    full frame so whole-partition aggregates share the Window operator (and
    the single sort) of the ordered features."""
    return in_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def in_time():
    """The product partition in time order, missing dates last."""
    return Window.partitionBy("KEY").orderBy(F.asc_nulls_last("DATE"))


def to_now():
    return in_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def rolling(w: int, leak_free: bool):
    """Row frame of a rolling mean: the current row and w-1 before it, or the
    w rows strictly before it when ``leak_free``."""
    return in_time().rowsBetween(-w, -1) if leak_free else in_time().rowsBetween(-(w - 1), 0)


def first_pass(q: Column, dc: Column | None, split: Column | None, leak_free: bool) -> list[Column]:
    """Window columns that read only input columns."""
    cols = [
        F.row_number().over(in_time()).alias("_rn"),
        F.count(F.lit(1)).over(by_key()).alias("_n"),
        # a repeated (KEY, DATE) breaks the one-row-per-date contract; flag it in the same pass
        F.coalesce(F.lag("DATE", 1).over(in_time()) == F.col("DATE"), F.lit(False)).alias("_dup"),
    ]
    if split is not None:
        # scope and gates of an evaluation, decided in the same pass
        cols += [F.count(F.when(split == "train", 1)).over(by_key()).alias("_n_train"),
                 F.count(F.when(split == "test", 1)).over(by_key()).alias("_n_test"),
                 F.count(F.when(split == "test", 1)).over(to_now()).alias("_test_no")]
    cols += [F.lag(q, k).over(in_time()).alias(f"_lag_{k}") for k in QUANTITY_LAGS]
    cols += [F.avg(q).over(rolling(w, leak_free)).alias(f"_rolling_mean_{w}") for w in ROLLING_WINDOWS]
    if leak_free:
        diff = F.lag(q, 1).over(in_time()) - F.lag(q, 2).over(in_time())
    else:
        diff = q - F.lag(q, 1).over(in_time())
    cols.append(diff.alias("_diff"))
    if dc is not None:
        prev1 = F.lag(dc, 1).over(in_time())
        prev2 = F.lag(dc, 2).over(in_time())
        cols += [F.lag(dc, k).over(in_time()).alias(f"_discount_lag_{k}") for k in DISCOUNT_LAGS]
        cols.append((dc - prev1).alias("_discount_change"))
        # second difference: change_t - change_{t-1}, same operations as diff().diff()
        cols.append(((dc - prev1) - (prev1 - prev2)).alias("_discount_acceleration"))
    return cols


def second_pass(month: Column, has_discount: bool, dc: Column | None) -> list[Column]:
    """Window columns over first-pass outputs, plus the fills."""
    n, rn = F.col("_n"), F.col("_rn")
    many = n > 1
    in_season = F.coalesce(month.isin(*SEASON_MONTHS).cast("double"), F.lit(0.0))
    cols = [F.coalesce(F.col(f"_lag_{k}"), F.lit(0.0)).alias(f"lag_{k}") for k in QUANTITY_LAGS]
    cols += [F.coalesce(F.col(f"_rolling_mean_{w}"), F.lit(0.0)).alias(f"rolling_mean_{w}")
             for w in ROLLING_WINDOWS]
    cols += [
        F.when(many, (rn - 1) / n).otherwise(F.lit(SINGLE_ROW_TREND)).alias("trend"),
        F.when(many, F.coalesce(F.col("_diff"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("trend_diff"),
        F.when(many, in_season).otherwise(F.lit(0.0)).alias("seasonal_indicator"),
    ]
    if has_discount:
        change = F.col("_discount_change")
        last_change = F.max(F.when(F.abs(change) >= F.lit(CHANGE_THRESHOLD), rn)).over(to_now())
        lag1 = F.coalesce(F.col("_lag_1"), F.lit(0.0))
        cols += [F.coalesce(F.col(f"_discount_lag_{k}"), F.lit(0.0)).alias(f"discount_lag_{k}")
                 for k in DISCOUNT_LAGS]
        cols += [
            F.coalesce(change, F.lit(0.0)).alias("discount_change"),
            F.coalesce(F.col("_discount_acceleration"), F.lit(0.0)).alias("discount_acceleration"),
            (rn - F.coalesce(last_change, F.lit(0))).cast("double").alias("days_since_discount_change"),
            (dc * lag1 / (F.avg(lag1).over(by_key()) + F.lit(PREV_SALES_EPSILON))).alias("DISCOUNT_PREV_SALES"),
        ]
    return cols


def time_series_features(df: DataFrame, *, discount_col: str | None = None,
                         leak_free: bool = False) -> DataFrame:
    """Add lag, rolling, trend (and, given ``discount_col``, discount-dynamics)
    features.  Requires KEY, DATE, QUANTITY_SOLD and ``month``.

    ``discount_col`` names the cleaned discount the discount lags, changes and
    DISCOUNT_PREV_SALES use (nn profile); ``None`` leaves them out (base).
    Helper columns ``_rn``, ``_n``, ``_dup`` (date repeats the previous row's)
    and, if ``split`` exists, ``_n_train``, ``_n_test`` and ``_test_no`` (test rows
    so far) stay.
    """
    q = F.col("QUANTITY_SOLD")
    dc = F.col(discount_col) if discount_col else None
    split = F.col("split") if "split" in df.columns else None
    keep = list(df.columns)
    staged = df.select(*keep, *first_pass(q, dc, split, leak_free))
    helpers = ["_rn", "_n", "_dup"] + (["_n_train", "_n_test", "_test_no"] if split is not None else [])
    return staged.select(*keep, *helpers, *second_pass(F.col("month"), dc is not None, dc))
