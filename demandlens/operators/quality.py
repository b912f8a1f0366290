"""Data-quality checks and panel profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame) -> DataFrame:
    """(KEY, DATE, rows) for every pair that occurs more than once.  The
    window features require (KEY, DATE) to be unique."""
    return (df.groupBy("KEY", "DATE").agg(F.count(F.lit(1)).alias("rows"))
            .filter(F.col("rows") > 1))


def panel_profile(df: DataFrame) -> DataFrame:
    """Rows and distinct products per split (and overall as split 'all')."""
    per = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"),
                                  F.countDistinct("KEY").alias("products"))
    total = df.agg(F.lit("all").alias("split"), F.count(F.lit(1)).alias("rows"),
                   F.countDistinct("KEY").alias("products"))
    return per.unionByName(total)
