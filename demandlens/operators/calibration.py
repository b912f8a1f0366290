"""Four-level calibration lookup, first hit wins:

(KEY, is_eoss, bin) -> (KEY, bin) -> (KEY) -> (bin) -> 1.0

The calibration table is long: (level, KEY, is_eoss, discount_bin, factor).
The three product levels are folded into ONE row per KEY (two small maps and
a scalar), so scored rows need a single equi-join on KEY - the column they
are already hash-partitioned by after the feature windows.  The bin level
has at most five rows (one per calibration bin) and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.functions.bins import calibration_bin
from demandlens.schema import CALIBRATION_BIN_LABELS


def _eoss_key(is_eoss, bin_col):
    return F.concat_ws("|", is_eoss.cast("double").cast("string"), bin_col)


def fold_calibration(cal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per-KEY factors, per-bin factors).  Types are set on entry (a flag of 1
    and 1.0 is one key).  Entries without a factor, or without a part of their
    level's key, cannot be looked up and are ignored; two factors for one key
    fail the job."""
    lvl = F.col("level")
    cal = cal.select("level", "KEY", F.col("is_eoss").cast("double").alias("is_eoss"),
                     F.col("discount_bin").cast("string").alias("discount_bin"),
                     F.col("factor").cast("double").alias("factor"))
    complete = ((lvl == "product_eoss") & F.col("is_eoss").isNotNull() & F.col("discount_bin").isNotNull()
                | (lvl == "product_discount") & F.col("discount_bin").isNotNull()
                | lvl.isin("product", "discount_bin"))
    # parts that do not belong to a level's key do not tell entries apart
    eoss = F.when(lvl == "product_eoss", F.col("is_eoss"))
    bin_ = F.when(lvl != "product", F.col("discount_bin"))
    key = F.when(lvl != "discount_bin", F.col("KEY"))
    twice = F.raise_error(F.lit("calibration has different factors for one key")).cast("double")
    dedup = (cal.filter(F.col("factor").isNotNull() & complete)
             .groupBy("level", key.alias("KEY"), eoss.alias("is_eoss"), bin_.alias("discount_bin"))
             .agg(F.when(F.min("factor") != F.max("factor"), twice).otherwise(F.max("factor")).alias("factor")))
    per_key = (dedup.filter(lvl.isin("product_eoss", "product_discount", "product") & F.col("KEY").isNotNull())
               .groupBy("KEY")
               .agg(F.map_from_entries(F.filter(F.collect_list(F.when(
                        lvl == "product_eoss",
                        F.struct(_eoss_key(F.col("is_eoss"), F.col("discount_bin")).alias("k"),
                                 F.col("factor").alias("v")))), lambda x: x.isNotNull())).alias("_f_eoss"),
                    F.map_from_entries(F.filter(F.collect_list(F.when(
                        lvl == "product_discount",
                        F.struct(F.col("discount_bin").alias("k"), F.col("factor").alias("v")))),
                        lambda x: x.isNotNull())).alias("_f_disc"),
                    F.max(F.when(lvl == "product", F.col("factor"))).alias("_f_prod")))
    per_bin = (dedup.filter((lvl == "discount_bin") & F.col("discount_bin").isin(*CALIBRATION_BIN_LABELS))
               .groupBy(F.col("discount_bin").alias("_cal_bin"))
               .agg(F.max("factor").alias("_f_bin")))
    return per_key, per_bin


def apply_calibration(scored: DataFrame, calibration: DataFrame | None, *,
                      discount_col: str = "DISCOUNT", eoss_col: str = "is_eoss") -> DataFrame:
    """Add ``_cal_bin``, ``calibration_factor`` and ``calibration_level``
    (the prediction is multiplied later).  ``calibration=None`` (or empty)
    is the identity."""
    d = F.col(discount_col)
    df = scored.withColumn("_cal_bin", calibration_bin(d))
    if calibration is None:
        return df.select("*", F.lit(1.0).alias("calibration_factor"),
                         F.lit("none").alias("calibration_level"))
    per_key, per_bin = fold_calibration(calibration)
    # per_bin has at most len(CALIBRATION_BIN_LABELS) rows: a proven size bound
    joined = (df.join(per_key, "KEY", "left")
                .join(F.broadcast(per_bin), "_cal_bin", "left"))
    eoss = F.col(eoss_col)
    f1 = F.when(eoss.isNotNull(), F.try_element_at("_f_eoss", _eoss_key(eoss, F.col("_cal_bin"))))
    f2 = F.try_element_at("_f_disc", F.col("_cal_bin"))
    f3 = F.col("_f_prod")
    f4 = F.col("_f_bin")
    level = (F.when(f1.isNotNull(), "product_eoss").when(f2.isNotNull(), "product_discount")
             .when(f3.isNotNull(), "product").when(f4.isNotNull(), "discount_bin").otherwise("none"))
    out = joined.select("*", F.coalesce(f1, f2, f3, f4, F.lit(1.0)).alias("calibration_factor"),
                        level.alias("calibration_level"))
    return out.drop("_f_eoss", "_f_disc", "_f_prod", "_f_bin")
