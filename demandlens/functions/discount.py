"""Discount transforms of the two feature profiles.

``base`` uses the discount as given (no cleaning before squaring/binning).
``nn`` builds the interactions and tiers from the *raw* discount, then cleans
(missing/inf -> 0) and clips it to [0, 1] for powers, bins and lags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandlens.functions.bins import discount_bin, fine_discount_bin
from demandlens.functions.numeric import nan_to_null
from demandlens.schema import EXP_CAP, TIER_HIGH, TIER_MED


def clip01(d: Column) -> Column:
    """Missing/inf -> 0, then clip to [0, 1]."""
    return F.least(F.greatest(F.coalesce(nan_to_null(d), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def flag(cond: Column) -> Column:
    """Boolean -> 1.0/0.0 where a missing comparison counts as False."""
    return F.coalesce(cond.cast("double"), F.lit(0.0))


def base_discount_columns(d: Column, is_eoss: Column | None) -> list[Column]:
    cols = [(d * d).alias("DISCOUNT_SQUARED"), discount_bin(d).alias("DISCOUNT_BIN")]
    if is_eoss is not None:
        cols.append((d * is_eoss).alias("DISCOUNT_EOSS"))
    return cols


def nn_raw_interactions(d: Column, month_sin: Column, holiday: Column | None,
                        is_eoss: Column | None) -> list[Column]:
    """Interactions on the raw discount (before cleaning)."""
    cols = [(d * month_sin).alias("DISCOUNT_MONTH")]
    if holiday is not None:
        cols.append((d * holiday).alias("DISCOUNT_HOLIDAY"))
    if is_eoss is not None:
        high = flag(d >= F.lit(TIER_HIGH))
        med = flag((d >= F.lit(TIER_MED)) & (d < F.lit(TIER_HIGH)))
        low = flag(d < F.lit(TIER_MED))
        cols += [
            (d * is_eoss).alias("DISCOUNT_EOSS"),
            high.alias("discount_tier_high"), med.alias("discount_tier_med"),
            low.alias("discount_tier_low"),
            (is_eoss * high).alias("EOSS_HIGH_DISCOUNT"),
            (is_eoss * med).alias("EOSS_MED_DISCOUNT"),
            (is_eoss * low).alias("EOSS_LOW_DISCOUNT"),
        ]
    return cols


def nn_clean_columns(dc: Column) -> list[Column]:
    """Powers, log/exp and bins of the cleaned, clipped discount ``dc``."""
    capped = F.least(F.greatest(dc, F.lit(0.0)), F.lit(EXP_CAP))
    return [
        (dc * dc).alias("DISCOUNT_SQUARED"),
        F.pow(dc, F.lit(3.0)).alias("DISCOUNT_CUBE"),
        F.sqrt(dc).alias("DISCOUNT_SQRT"),
        F.log1p(dc * F.lit(10.0)).alias("DISCOUNT_LOG"),
        (F.exp(capped) - F.lit(1.0)).alias("DISCOUNT_EXP"),
        discount_bin(dc).alias("DISCOUNT_BIN"),
        fine_discount_bin(dc).alias("DISCOUNT_FINE_BIN"),
    ]
