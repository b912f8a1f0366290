"""Inputs that once gave wrong answers."""
import duckdb
import pytest
from pyspark.sql import functions as F

import oracle as O
import registered
from demandlens.operators.calibration import apply_calibration
from demandlens.operators.histogram import histogram
from demandlens.plans.linear import evaluate_linear, one_model_per_key
from demandlens.session import ensure_checkpoint_dir

XS = [1e10, -1e10, 1e13, -1e13, 1e17, -1e17, 1.23456789, -0.5, 0.0, float("inf"), float("-inf"), None]


@pytest.mark.parametrize("d", [3, 6])
def test_rounding_has_no_cap(spark, d):
    got = [r.r for r in spark.createDataFrame([(i, x) for i, x in enumerate(XS)], "i int, x double")
           .select("i", registered.stable_round("x", d).alias("r")).orderBy("i").collect()]
    rows = ", ".join(f"({i}, {'null' if x is None else repr(x) if abs(x) < 1e300 else chr(39) + str(x) + chr(39)}::double)"
                     for i, x in enumerate(XS))
    want = [r[0] for r in duckdb.sql(f"select {O.stable_round('x', d)} from (values {rows}) t(i, x) order by i").fetchall()]
    assert got == want
    assert got[0] == 1e10 and got[4] == 1e17


def series(spark, values):
    return spark.createDataFrame([("k", f"2024-01-{i + 1:02d}", v, 0.0, 0.0) for i, v in enumerate(values)],
                                 "KEY string, DATE string, QUANTITY_SOLD double, DISCOUNT double, is_eoss double")


def test_nan_history_is_skipped(spark):
    train = series(spark, [2.0, 2.0, 2.0, 2.0, 2.0, float("nan")])
    test = spark.createDataFrame([("k", "2024-02-01", 2.0, 0.0, 0.0)], train.schema)
    spec = spark.createDataFrame([(0, "rolling_mean_4", False, False)],
                                 "pos int, feature string, is_discount boolean, is_categorical boolean")
    models = spark.createDataFrame([("k", 0.0, [1.0])], "KEY string, intercept double, coef array<double>")
    assert [r.Raw_Prediction for r in evaluate_linear(train, test, models, spec).details.collect()] == [2.0]


def test_models(spark):
    schema = "KEY string, intercept double, coef array<double>"
    with pytest.raises(Exception, match="more than one model"):
        one_model_per_key(spark.createDataFrame([("k", 0.0, [1.0]), ("k", 1.0, [1.0])], schema)).collect()
    train, test = series(spark, [1.0] * 6), spark.createDataFrame([("k", "2024-02-01", 2.0, 0.0, 0.0)],
                                                                   series(spark, [1.0]).schema)
    spec = spark.createDataFrame([(0, "lag_1", False, False)],
                                 "pos int, feature string, is_discount boolean, is_categorical boolean")
    ev = evaluate_linear(train, test, spark.createDataFrame([("k", 0.0, None)], schema), spec)
    assert ev.details.count() == 0 and [r.reason for r in ev.skips.collect()] == ["incomplete_features"]


def test_calibration_flag_types_and_keys(spark):
    rows = spark.createDataFrame([("p", 0.5, 1.0)], "KEY string, DISCOUNT double, is_eoss double")
    for kind in ("int", "bigint", "double"):
        cal = spark.createDataFrame([("product_eoss", "p", "1", "40%+", 0.8), ("product_discount", "p", None, None, 0.1)],
                                    "level string, KEY string, is_eoss string, discount_bin string, factor double")
        cal = cal.withColumn("is_eoss", F.col("is_eoss").cast(kind))
        assert apply_calibration(rows, cal).first().calibration_factor == 0.8
    both = spark.createDataFrame([("product", "p", None, None, 0.8), ("product", "p", None, None, 0.9)],
                                 "level string, KEY string, is_eoss double, discount_bin string, factor double")
    with pytest.raises(Exception, match="different factors"):
        apply_calibration(rows, both).collect()


def test_histogram_needs_a_finite_range(spark):
    with pytest.raises(Exception, match="not finite"):
        histogram(spark.createDataFrame([(1.0,), (float("inf"),)], "x double"), "x", 2).collect()


def test_checkpoint_folder_is_required_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())


def test_queries_are_lazy_plans_over_the_tables(spark):
    df = registered.spark_query("panel")(spark, "/root/testdata/sf0.001")
    files = " ".join(df.inputFiles())
    assert "lineitem.parquet" in files and "part.parquet" in files
