"""Feature scaling from a scaler table (feature, kind, p1, p2).

``standard``: (x - p1) / p2, a zero scale counts as 1.
``minmax``:   x * p1 + p2.
The table has one row per feature, so it is read at plan time and turned
into column arithmetic inside the same projection (no join, no UDF).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaler_params(scaler: DataFrame) -> dict[str, tuple[str, float, float]]:
    return {r["feature"]: (r["kind"], float(r["p1"]), float(r["p2"])) for r in scaler.collect()}


def _apply(c: Column, kind: str, p1: float, p2: float) -> Column:
    if kind == "standard":
        return (c - F.lit(p1)) / F.lit(p2 if p2 != 0 else 1.0)
    if kind == "minmax":
        return c * F.lit(p1) + F.lit(p2)
    raise ValueError(f"unknown scaler kind {kind!r}")


def _scaled(df: DataFrame, plan: dict[str, tuple[str, float, float]]) -> DataFrame:
    return df.select(*[(_apply(F.col(c), *plan[c]).alias(c) if c in plan else F.col(c))
                       for c in df.columns])


def standard_scale(df: DataFrame, feature_cols: Sequence[str], scaler: DataFrame) -> DataFrame:
    """One standard scaler over every feature (positional in the original)."""
    params = scaler_params(scaler)
    missing = [c for c in feature_cols if c not in params]
    if missing:
        raise ValueError(f"scaler has no parameters for {missing[:5]}")
    plan = {c: ("standard", params[c][1], params[c][2]) if params[c][0] == "standard" else params[c]
            for c in feature_cols}
    return _scaled(df, plan)


def split_scale(df: DataFrame, features: Sequence[tuple[str, bool, bool]], scaler: DataFrame) -> DataFrame:
    """Discount features (by name) min-max, other non-categorical features
    standard, categorical features untouched."""
    params = scaler_params(scaler)
    plan: dict[str, tuple[str, float, float]] = {}
    for name, is_disc, is_cat in features:
        if not is_disc and is_cat:
            continue
        want = "minmax" if is_disc else "standard"
        if name not in params or params[name][0] != want:
            raise ValueError(f"scaler lacks {want} parameters for feature {name!r}")
        plan[name] = params[name]
    return _scaled(df, plan)
