"""Scoring: per-key linear models (native) and sequence predictors (Arrow).

Linear scoring is a higher-order SQL expression over the feature vector and
the model's coefficient array - no Python worker.  Sequence scoring is the
only Python boundary of the engine: ``mapInArrow`` hands Arrow batches of
test rows (each with its prior-row sequence) to a caller-supplied predictor,
built once per task by a factory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlens.functions.bins import report_bin
from demandlens.functions.numeric import clamp_non_negative, percent_error
from demandlens.schema import RESULT_COLUMNS
from demandlens.session import ship_package


def linear_predict(features: Column, intercept: Column, coef: Column) -> Column:
    """intercept + sum(coef_i * x_i) over an assembled feature array; NULL when
    the lengths disagree."""
    dot = F.aggregate(F.zip_with(coef, features, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(coef) == F.size(features), intercept + dot)


def linear_predict_columns(feature_cols: list[str], intercept: str, coef: str) -> Column:
    """The same prediction as a flat expression over the feature columns
    (coef[i] * x_i folded left from 0.0, then + intercept): no array is built
    and no higher-order function leaves whole-stage codegen."""
    dot = "0.0D" + "".join(f" + get(`{coef}`, {i}) * `{c}`" for i, c in enumerate(feature_cols))
    return F.expr(f"CASE WHEN size(`{coef}`) = {len(feature_cols)} THEN `{intercept}` + ({dot}) END")


def finalize_results(scored: DataFrame) -> DataFrame:
    """From (KEY, DATE, Actual_Sales, Raw_Prediction, DISCOUNT, is_eoss,
    calibration_factor) to the result schema plus ``Discount_Bin``."""
    pred = clamp_non_negative(F.col("Raw_Prediction") * F.col("calibration_factor"))
    staged = scored.select("*", pred.alias("Predicted_Sales"))
    abs_err = F.abs(F.col("Predicted_Sales") - F.col("Actual_Sales"))
    staged = staged.select("*", abs_err.alias("Absolute_Error"))
    staged = staged.select("*", percent_error(F.col("Absolute_Error"), F.col("Actual_Sales")).alias("Percent_Error"))
    return staged.select(*RESULT_COLUMNS, report_bin(F.col("DISCOUNT")).alias("Discount_Bin"),
                         "calibration_level")


# ---------------------------------------------------------------- sequences

PredictorFactory = Callable[[], Callable[[np.ndarray], np.ndarray]]


class MeanOfFeature:
    """Baseline predictor: the mean of one feature over the sequence steps.
    Picklable factory (call it to get the predict function)."""

    def __init__(self, index: int):
        self.index = index

    def __call__(self) -> Callable[[np.ndarray], np.ndarray]:
        idx = self.index
        return lambda x: x[:, :, idx].mean(axis=1)


def sequence_tensor(seq: pa.ListArray) -> np.ndarray:
    """(rows, steps, features) of a list<list<double>> column whose rows are of one
    shape: the flat values of the batch, reshaped without a copy (missing values are
    NaN, which takes one).  Rows of different shapes are an error."""
    if len(seq) == 0:
        return np.zeros((0, 0, 0))
    steps = seq.flatten()
    values = steps.flatten()
    shape = (len(seq), len(steps) // len(seq), len(values) // max(1, len(steps)))
    of_rows, of_steps = pa.compute.list_value_length(seq), pa.compute.list_value_length(steps)
    if seq.null_count or steps.null_count or set(of_rows.unique().to_pylist()) != {shape[1]} \
            or not set(of_steps.unique().to_pylist()) <= {shape[2]}:
        raise ValueError("sequences of different shapes")
    return values.to_numpy(zero_copy_only=False).reshape(shape)


def score_sequences(df: DataFrame, factory: PredictorFactory, *, seq_col: str = "sequence",
                    out_col: str = "Raw_Prediction", batch_size: int = 256) -> DataFrame:
    """Append ``out_col`` = predictor(sequence batch).  The predictor gets a
    float64 array (batch, steps, features) and returns (batch,) or (batch, 1).
    NaN/inf predictions become NULL.  The sequence column is dropped."""
    ship_package(df.sparkSession)     # workers unpickle ``run`` and the factory from this package
    out_schema = T.StructType([f for f in df.schema.fields if f.name != seq_col] + [T.StructField(out_col, T.DoubleType())])
    names = out_schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = factory()
        for batch in batches:
            x = sequence_tensor(batch.column(seq_col))
            y = [np.asarray(predict(x[at:at + batch_size]), dtype=np.float64).reshape(len(x[at:at + batch_size]), -1)[:, 0]
                 for at in range(0, len(x), batch_size)]
            y = np.concatenate(y) if y else np.zeros(0)
            scores = pa.array(y, pa.float64(), mask=~np.isfinite(y))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [scores], names=names + [out_col])

    return df.mapInArrow(run, out_schema)
