"""The sales panel and parameter tables, derived from the TPC-H-like tables.

The panel is lineitem joined to part, aggregated to (brand/type, ship week):
the join is left to Catalyst/AQE (part is broadcast only when its measured
size is under the broadcast threshold) and the aggregate combines map-side,
so a hot product costs one partial row per map task, not one task per
product.  The last nine weeks of every product are the test split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandlens.operators.features import BASE_FEATURES, NN_FEATURES
from demandlens.sources.local import local_frame
from demandlens.schema import is_discount_feature

TEST_WEEKS = 9
ABSENT_FEATURE = "promo_depth"          # named by the spec, produced by no profile
CATEGORICAL = {"month", "year", "quarter", "day_of_week", "day_of_year", "week_of_year",
                "is_eoss", "holiday_label", "seasonal_indicator"}


def panel(spark: SparkSession, sf_dir: str, *, dirty: bool = False) -> DataFrame:
    li = (spark.read.parquet(f"{sf_dir}/lineitem.parquet")
          .select("l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_shipdate"))
    pt = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_type")
    joined = li.join(pt, li["l_partkey"] == pt["p_partkey"])
    weekly = (joined.groupBy(F.concat("p_brand", F.lit("/"), "p_type").alias("KEY"),
                             F.date_trunc("week", "l_shipdate").cast("date").alias("DATE"))
              .agg(F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(F.lit(0.0)))
                   .alias("QUANTITY_SOLD"),
                   ((F.sum(F.round(F.col("l_discount") * 100).cast("int")) % 11).cast("double") / 20)
                   .alias("DISCOUNT")))
    month = F.month("DATE")
    # the order of the feature windows too, so that one sort serves both
    in_time = Window.partitionBy("KEY").orderBy(F.asc_nulls_last("DATE"))
    whole = in_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # same partition and order for both: one Window operator, one sort
    from_end = F.count(F.lit(1)).over(whole) - F.row_number().over(in_time) + 1
    disc = F.col("DISCOUNT")
    if dirty:
        day = F.dayofmonth("DATE")
        disc = F.when(day == 1, F.lit(None).cast("double")).when(day == 2, F.lit(1.2)).otherwise(disc)
    return weekly.select(
        "KEY", "DATE", "QUANTITY_SOLD", disc.alias("DISCOUNT"),
        month.isin(1, 7).cast("double").alias("is_eoss"),
        (month == 12).cast("double").alias("holiday_label"),
        F.when(from_end <= TEST_WEEKS, "test").otherwise("train").alias("split"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product keys, from ``part`` alone: parameter tables need no line items."""
    return (spark.read.parquet(f"{sf_dir}/part.parquet")
            .select(F.concat("p_brand", F.lit("/"), "p_type").alias("KEY")).distinct())


def train_test(panel_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    cols = [c for c in panel_df.columns if c != "split"]
    return (panel_df.filter(F.col("split") == "train").select(*cols),
            panel_df.filter(F.col("split") == "test").select(*cols))


def profile_features(profile: str) -> list[str]:
    return (BASE_FEATURES if profile == "base" else NN_FEATURES) + [ABSENT_FEATURE]


def feature_spec(spark: SparkSession, profile: str) -> DataFrame:
    rows = [(i, f, is_discount_feature(f), f in CATEGORICAL) for i, f in enumerate(profile_features(profile))]
    return local_frame(spark, rows, [("pos", "INT"), ("feature", "STRING"), ("is_discount", "BOOLEAN"),
                                     ("is_categorical", "BOOLEAN")])


MODEL_TERMS = {
    "a": (0.0, {"lag_1": 0.5, "rolling_mean_4": 0.5}),
    "b": (0.25, {"rolling_mean_12": 1.0}),
}


def linear_model(products_df: DataFrame, which: str, profile: str = "base") -> DataFrame:
    """One row per product KEY (every type but STANDARD): intercept and the
    coefficient array in feature-spec order."""
    intercept, terms = MODEL_TERMS[which]
    coef = [float(terms.get(f, 0.0)) for f in profile_features(profile)]
    keys = products_df.select("KEY").distinct().filter(~F.col("KEY").endswith("/STANDARD"))
    return keys.select("KEY", F.lit(intercept).alias("intercept"),
                       F.array(*[F.lit(c) for c in coef]).alias("coef"))


def scaler_table(spark: SparkSession, profile: str, *, split: bool) -> DataFrame:
    """standard: mean 8, scale 4; minmax: scale 2, min -0.5 (powers of two)."""
    rows = []
    for f in profile_features(profile):
        if split and is_discount_feature(f):
            rows.append((f, "minmax", 2.0, -0.5))
        else:
            rows.append((f, "standard", 8.0, 4.0))
    return local_frame(spark, rows, [("feature", "STRING"), ("kind", "STRING"), ("p1", "DOUBLE"), ("p2", "DOUBLE")])


def calibration_table(products_df: DataFrame) -> DataFrame:
    """One distinct over the product keys; the levels of a key are exploded."""
    ptype = F.substring_index(F.col("KEY"), "/", -1)
    null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")

    def entry(cond, is_eoss, bin_, factor, level):
        return F.when(cond, F.struct(F.lit(level).alias("level"), is_eoss.alias("is_eoss"),
                                     bin_.alias("discount_bin"), F.lit(factor).alias("factor")))

    spark = products_df.sparkSession
    entries = F.array_compact(F.array(
        entry(ptype == "PROMO", F.lit(1.0), F.lit("40%+"), 0.8, "product_eoss"),
        entry(ptype == "PROMO", F.lit(0.0), F.lit("0-10%"), 1.1, "product_eoss"),
        entry(ptype.isin("PROMO", "LARGE"), null_d, F.lit("10-20%"), 0.9, "product_discount"),
        entry(ptype.isin("LARGE", "MEDIUM"), null_d, null_s, 1.05, "product")))
    per_key = (products_df.select("KEY").distinct().select("KEY", F.explode(entries).alias("e"))
               .select("e.level", "KEY", "e.is_eoss", "e.discount_bin", "e.factor"))
    by_bin = local_frame(spark, [("discount_bin", None, None, "20-30%", 0.95), ("discount_bin", None, None, "40%+", 0.9)],
                         [("level", "STRING"), ("KEY", "STRING"), ("is_eoss", "DOUBLE"), ("discount_bin", "STRING"),
                          ("factor", "DOUBLE")])
    return per_key.unionByName(by_bin)
