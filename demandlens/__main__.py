"""Command line: run an evaluation or a comparison with the active Spark
configuration (spark-submit / pyspark settings decide master and resources).

  python -m demandlens linear  --models M --feature-spec S --train T --test U --out O [--calibration C] [--scaler X]
  python -m demandlens sequence --predictor pkg.mod:factory --feature-spec S --train T --test U --out O [...]
  python -m demandlens compare --linear L --neural N --out O
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from demandlens.plans.jobs import run_comparison, run_linear_evaluation, run_sequence_evaluation
from demandlens.session import ensure_checkpoint_dir, prepare_session


def _load(path: str):
    module, _, attr = path.partition(":")
    return getattr(importlib.import_module(module), attr)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="demandlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("linear", "sequence"):
        p = sub.add_parser(name)
        p.add_argument("--feature-spec", required=True)
        p.add_argument("--train", required=True)
        p.add_argument("--test", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--scaler")
        p.add_argument("--calibration")
        p.add_argument("--input-format", default="parquet")
        p.add_argument("--output-format", default="parquet")
        if name == "linear":
            p.add_argument("--models", required=True)
            p.add_argument("--min-history", type=int, default=5)
            p.add_argument("--leak-free", action="store_true")
        else:
            p.add_argument("--predictor", required=True, help="module:factory returning a predict function")
            p.add_argument("--seq-len", type=int, default=52)
            p.add_argument("--batch-size", type=int, default=256)
    c = sub.add_parser("compare")
    c.add_argument("--linear", required=True)
    c.add_argument("--neural", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--input-format", default="parquet")
    c.add_argument("--output-format", default="parquet")
    a = ap.parse_args(argv)

    spark = SparkSession.builder.appName(f"demandlens-{a.cmd}").getOrCreate()
    prepare_session(spark)
    ensure_checkpoint_dir(spark)
    if a.cmd == "linear":
        run_linear_evaluation(spark, models_path=a.models, feature_spec_path=a.feature_spec, train_path=a.train,
                              test_path=a.test, output_dir=a.out, scaler_path=a.scaler,
                              calibration_path=a.calibration, input_format=a.input_format,
                              output_format=a.output_format, min_history=a.min_history, leak_free=a.leak_free)
    elif a.cmd == "sequence":
        run_sequence_evaluation(spark, predictor=_load(a.predictor), feature_spec_path=a.feature_spec,
                                train_path=a.train, test_path=a.test, output_dir=a.out, scaler_path=a.scaler,
                                calibration_path=a.calibration, input_format=a.input_format,
                                output_format=a.output_format, seq_len=a.seq_len, batch_size=a.batch_size)
    else:
        run_comparison(spark, linear_path=a.linear, neural_path=a.neural, output_dir=a.out,
                       input_format=a.input_format, output_format=a.output_format)


if __name__ == "__main__":
    main()
