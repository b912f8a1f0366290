"""End-to-end jobs on files written from the sf0.001 panel."""

import os
import tempfile

from pyspark.sql import functions as F

import registered
from demandlens.operators.scoring import MeanOfFeature
from demandlens.plans.jobs import run_comparison, run_linear_evaluation, run_sequence_evaluation
from demandlens.sources import fixtures as fx
from demandlens.sources.sinks import write_table
from tests.conftest import SF_SMALL


def test_linear_sequence_and_comparison_jobs(spark):
    base = tempfile.mkdtemp(prefix="dl-job-")
    p = registered.panel(spark, SF_SMALL)
    train, test = fx.train_test(p)
    paths = {n: os.path.join(base, n) for n in ("train", "test", "models", "spec", "spec_nn", "cal", "scaler")}
    write_table(train, paths["train"], "csv")
    write_table(test, paths["test"], "csv")
    write_table(fx.linear_model(p, "a"), paths["models"])
    write_table(fx.feature_spec(spark, "base"), paths["spec"])
    write_table(fx.feature_spec(spark, "nn"), paths["spec_nn"])
    write_table(fx.calibration_table(p), paths["cal"])
    write_table(fx.scaler_table(spark, "nn", split=True), paths["scaler"])
    lin = run_linear_evaluation(spark, models_path=paths["models"], feature_spec_path=paths["spec"],
                                train_path=paths["train"], test_path=paths["test"], input_format="csv",
                                calibration_path=paths["cal"], output_dir=os.path.join(base, "lin"))
    expected = registered.details_a(spark, SF_SMALL)
    assert lin.details.count() == expected.count()
    assert spark.read.parquet(os.path.join(base, "lin", "forecast_evaluation_details")).count() == expected.count()
    lines = spark.read.text(os.path.join(base, "lin", "metrics_summary")).count()
    assert lines == 9
    lag1 = fx.profile_features("nn").index("lag_1")
    nn = run_sequence_evaluation(spark, predictor=MeanOfFeature(lag1), feature_spec_path=paths["spec_nn"],
                                 train_path=paths["train"], test_path=paths["test"], input_format="csv",
                                 scaler_path=paths["scaler"], seq_len=4, output_dir=os.path.join(base, "nn"))
    assert nn.details.count() > 0
    assert nn.details.filter(F.col("Predicted_Sales") < 0).count() == 0
    cmp = run_comparison(spark, linear_path=os.path.join(base, "lin", "forecast_evaluation_details"),
                         neural_path=os.path.join(base, "nn", "forecast_evaluation_details"),
                         output_dir=os.path.join(base, "cmp"))
    assert cmp.count() > 0
    bins = spark.read.parquet(os.path.join(base, "cmp", "discount_bin_comparison"))
    assert bins.count() == 7


def test_cli_compare(spark):
    import datetime as dt
    from demandlens.__main__ import main
    from tests.test_reports import details
    base = tempfile.mkdtemp(prefix="dl-cli-")
    rows = [("a", dt.date(2021, 1, 4), 1.0, 2.0, .1, 0.0), ("b", dt.date(2021, 1, 4), 3.0, 2.0, .3, 1.0)]
    write_table(details(spark, rows), os.path.join(base, "l"))
    write_table(details(spark, rows), os.path.join(base, "n"))
    main(["compare", "--linear", os.path.join(base, "l"), "--neural", os.path.join(base, "n"),
          "--out", os.path.join(base, "out")])
    out = spark.read.parquet(os.path.join(base, "out", "model_comparison_details"))
    assert out.count() == 2 and {r[0] for r in out.select("Better_Model").collect()} == {"Equal"}


def test_python_workers_get_the_package_from_any_cwd():
    """The driver may run from anywhere; Python workers must still import the package."""
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
print("ROWS", len(E.queries()["sequence_scores"](spark, {SF_SMALL!r}).collect()))
spark.stop()
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(prefix="dl-cwd-"),
                         capture_output=True, text=True, timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
