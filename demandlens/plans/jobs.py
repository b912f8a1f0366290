"""Runnable jobs: read inputs, evaluate, write every output.

The details of an evaluation feed eight reports; they are materialized once
as Parquet in the session's shared checkpoint folder (lineage cut, survives
executor loss, keeps statistics) instead of being recomputed per report.

Outputs (directory layout under ``output_dir``):
  forecast_evaluation_details/   details (Parquet by default, or CSV)
  product_forecast_summary/      per product, ordered by percent error
  discount_bin_performance/      7 bins, single file
  metrics_summary/               'label: value' text, single file
  skips/                         products / rows left out, with the reason
  chart data: bin_mae, bin_means, eoss_mae, top_volume_products,
              error_histogram, scatter_limit
Comparison: model_comparison_details/, discount_bin_comparison/,
            comparison_summary/, bin_error_long/, error_histograms/
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demandlens.operators import compare as C
from demandlens.operators import reports as R
from demandlens.operators.histogram import histogram, histograms
from demandlens.plans.common import Evaluation
from demandlens.plans.comparison import compare_models
from demandlens.plans.linear import evaluate_linear
from demandlens.plans.sequence import evaluate_sequence
from demandlens.schema import COMPARE_HIST_BINS, HIST_BINS
from demandlens.session import materialize
from demandlens.sources.readers import read_results, read_sales, read_table
from demandlens.sources.sinks import write_metrics_text, write_table


def write_reports(details: DataFrame, output_dir: str, fmt: str = "parquet", *, median: str = "exact") -> DataFrame:
    """All reports of one evaluation; returns the materialized details."""
    details = materialize(details, "details")
    out = output_dir.rstrip("/")
    write_table(details, f"{out}/forecast_evaluation_details", fmt)
    write_table(R.product_summary(details), f"{out}/product_forecast_summary", fmt)
    write_table(R.bin_performance(details).orderBy("bin_ordinal"), f"{out}/discount_bin_performance", fmt,
                single_file=True)
    write_metrics_text(R.metrics_summary(details, median=median), f"{out}/metrics_summary")
    for name, df in (("bin_mae", R.bin_mae(details)), ("bin_means", R.bin_means(details)),
                     ("eoss_mae", R.eoss_mae(details)), ("top_volume_products", R.top_volume_products(details)),
                     ("top_volume_rows", R.top_volume_rows(details)),
                     ("top_error_products", R.top_error_products(details)),
                     ("error_histogram", histogram(details, "Absolute_Error", HIST_BINS)),
                     ("scatter_limit", R.scatter_limit(details))):
        write_table(df, f"{out}/charts/{name}", fmt, single_file=True)
    return details


def run_linear_evaluation(spark: SparkSession, *, models_path: str, feature_spec_path: str, train_path: str,
                          test_path: str, output_dir: str, scaler_path: str | None = None,
                          calibration_path: str | None = None, input_format: str = "parquet",
                          output_format: str = "parquet", min_history: int = 5,
                          leak_free: bool = False) -> Evaluation:
    train = read_sales(spark, train_path, input_format)
    test = read_sales(spark, test_path, input_format)
    ev = evaluate_linear(train, test, read_table(spark, models_path), read_table(spark, feature_spec_path),
                         scaler=read_table(spark, scaler_path) if scaler_path else None,
                         calibration=read_table(spark, calibration_path) if calibration_path else None,
                         min_history=min_history, leak_free=leak_free).stored()
    ev.details = write_reports(ev.details, output_dir, output_format)
    write_table(ev.skips, f"{output_dir.rstrip('/')}/skips", output_format)
    return ev


def run_sequence_evaluation(spark: SparkSession, *, predictor: Callable, feature_spec_path: str, train_path: str,
                            test_path: str, output_dir: str, scaler_path: str | None = None,
                            calibration_path: str | None = None, input_format: str = "parquet",
                            output_format: str = "parquet", seq_len: int = 52,
                            batch_size: int = 256) -> Evaluation:
    train = read_sales(spark, train_path, input_format)
    test = read_sales(spark, test_path, input_format)
    ev = evaluate_sequence(train, test, read_table(spark, feature_spec_path), predictor,
                           scaler=read_table(spark, scaler_path) if scaler_path else None,
                           calibration=read_table(spark, calibration_path) if calibration_path else None,
                           seq_len=seq_len, batch_size=batch_size)
    ev.details = write_reports(ev.details, output_dir, output_format)
    write_table(ev.skips, f"{output_dir.rstrip('/')}/skips", output_format)
    return ev


def run_comparison(spark: SparkSession, *, linear_path: str, neural_path: str, output_dir: str,
                   input_format: str = "parquet", output_format: str = "parquet"):
    cmp = compare_models(read_results(spark, linear_path, input_format),
                         read_results(spark, neural_path, input_format))
    details = materialize(cmp.details, "comparison")
    out = output_dir.rstrip("/")
    write_table(details, f"{out}/model_comparison_details", output_format)
    write_table(C.comparison_by_bin(details).orderBy("bin_ordinal"), f"{out}/discount_bin_comparison",
                output_format, single_file=True)
    write_table(C.comparison_summary(details), f"{out}/comparison_summary", output_format, single_file=True)
    write_table(C.bin_error_long(details), f"{out}/bin_error_long", output_format, single_file=True)
    hists = histograms(details, {"Linear": "Linear_Error", "Neural": "Neural_Error"}, COMPARE_HIST_BINS)
    write_table(hists, f"{out}/error_histograms", output_format, single_file=True)
    return details
