"""Missing-value, infinity and division rules (NULL logic throughout)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandlens.schema import PERCENT_EPSILON

_INF = float("inf")


def nan_to_null(c: Column) -> Column:
    """NaN and +-inf become NULL; Spark orders NaN above everything, so it
    must not reach comparisons or averages."""
    return F.when(F.isnan(c) | (c == _INF) | (c == -_INF), F.lit(None).cast("double")).otherwise(c)


def clean_feature(name: str) -> Column:
    """Feature cleaning of a column: +-inf and missing become 0.0, result is double.
    One parsed expression: plans have dozens of these, and every operator of a
    Column costs the driver a call."""
    x = f"CAST(`{name}` AS DOUBLE)"
    return F.expr(f"coalesce(CASE WHEN isnan({x}) OR {x} = DOUBLE('Infinity') OR {x} = DOUBLE('-Infinity') "
                  f"THEN NULL ELSE {x} END, 0.0D)")


def clamp_non_negative(c: Column) -> Column:
    """``max(0, p)`` with Python semantics: NaN and NULL give 0."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).when(c > 0, c).otherwise(F.lit(0.0))


def percent_error(abs_err: Column, actual: Column) -> Column:
    """abs / (actual + eps) * 100, guarded against an exact zero denominator."""
    den = actual + F.lit(PERCENT_EPSILON)
    return F.when(den != 0, abs_err / den * F.lit(100.0))


def ratio_with_inf(num: Column, den: Column) -> Column:
    """num / den * 100 with float semantics for den == 0: +inf, -inf, or NULL for 0/0."""
    return (F.when(den != 0, num / den * F.lit(100.0))
            .when(num > 0, F.lit(_INF))
            .when(num < 0, F.lit(-_INF)))
