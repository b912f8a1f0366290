"""Calibration lookup: first hit wins, NULL flag skips the product/flag level,
an empty table is the identity."""

from pyspark.sql import functions as F

from demandlens.operators.calibration import apply_calibration
from demandlens.schema import CALIBRATION_SCHEMA

ROWS = [("k1", 0.45, 1.0), ("k1", 0.45, None), ("k1", 0.15, 0.0), ("k2", 0.25, 0.0), ("k3", None, 0.0),
        ("k3", 0.05, 0.0)]


def scored(spark):
    return spark.createDataFrame(ROWS, "KEY string, DISCOUNT double, is_eoss double") \
        .withColumn("Raw_Prediction", F.lit(10.0))


def table(spark, rows):
    return spark.createDataFrame(rows, CALIBRATION_SCHEMA)


def test_levels_in_order(spark):
    cal = table(spark, [("product_eoss", "k1", 1.0, "40%+", 0.8),
                        ("product_discount", "k1", None, "10-20%", 0.9),
                        ("product", "k1", None, None, 1.05),
                        ("discount_bin", None, None, "20-30%", 0.95),
                        ("discount_bin", None, None, "40%+", 0.9)])
    out = apply_calibration(scored(spark), cal).select("KEY", "DISCOUNT", "is_eoss", "calibration_factor",
                                                        "calibration_level").collect()
    got = {(r["KEY"], r["DISCOUNT"], r["is_eoss"]): (r["calibration_factor"], r["calibration_level"]) for r in out}
    assert got[("k1", 0.45, 1.0)] == (0.8, "product_eoss")
    assert got[("k1", 0.45, None)] == (1.05, "product")          # NULL flag skips level 1
    assert got[("k1", 0.15, 0.0)] == (0.9, "product_discount")
    assert got[("k2", 0.25, 0.0)] == (0.95, "discount_bin")
    assert got[("k3", None, 0.0)] == (0.9, "discount_bin")        # missing discount -> '40%+'
    assert got[("k3", 0.05, 0.0)] == (1.0, "none")


def test_empty_table_is_identity(spark):
    out = apply_calibration(scored(spark), table(spark, [])).collect()
    assert {r["calibration_factor"] for r in out} == {1.0}
    assert {r["calibration_level"] for r in out} == {"none"}
    out = apply_calibration(scored(spark), None).collect()
    assert {r["calibration_factor"] for r in out} == {1.0}
