"""Discount binning.

Report/feature bins are right-closed and left-open; values outside the
outermost edges get no bin (NULL).  ``Bucketizer`` and ``width_bucket`` are
left-closed, so the ladders are spelled out as ``when`` chains.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandlens.schema import (
    CALIBRATION_BIN_LABELS, CALIBRATION_BIN_UPPER, DISCOUNT_BIN_EDGES, FINE_BIN_EDGES,
    REPORT_BIN_EDGES, REPORT_BIN_LABELS,
)


def right_closed_bins(x: Column, edges: Sequence[float], labels: Sequence) -> Column:
    """Label i for edges[i] < x <= edges[i+1]; NULL outside (no otherwise)."""
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def discount_bin(x: Column) -> Column:
    """DISCOUNT_BIN: 5 coarse bins, as double 0..4."""
    return right_closed_bins(x, DISCOUNT_BIN_EDGES, [float(i) for i in range(5)])


def fine_discount_bin(x: Column) -> Column:
    """DISCOUNT_FINE_BIN: 10 bins starting at an open 0, as double 0..9."""
    return right_closed_bins(x, FINE_BIN_EDGES, [float(i) for i in range(10)])


def report_bin(x: Column) -> Column:
    """Report label ('0-5%' .. '40%+'), NULL when out of range or missing."""
    return right_closed_bins(x, REPORT_BIN_EDGES, REPORT_BIN_LABELS)


def report_bin_ordinal(x: Column) -> Column:
    """Report bin position 0..6 (labels do not sort as text)."""
    return right_closed_bins(x, REPORT_BIN_EDGES, list(range(len(REPORT_BIN_LABELS))))


def calibration_bin(x: Column) -> Column:
    """Calibration bin: upper-bounded ladder; missing falls through to '40%+'."""
    expr = None
    for hi, lab in zip(CALIBRATION_BIN_UPPER, CALIBRATION_BIN_LABELS):
        cond = x <= F.lit(hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(CALIBRATION_BIN_LABELS[-1]))


def report_bin_table(spark: SparkSession) -> DataFrame:
    """The 7 report bins with their ordinal: the frame every bin report
    left-joins from, so empty bins still appear.  Fixed size: safe to broadcast."""
    from demandlens.sources.local import local_frame
    rows = [(i, lab) for i, lab in enumerate(REPORT_BIN_LABELS)]
    return local_frame(spark, rows, [("bin_ordinal", "INT"), ("Discount_Bin", "STRING")])
