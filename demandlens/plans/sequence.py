"""Sequence-model evaluation.

Same plan as the linear job (one tagged history, one shuffle on KEY, one sort), then the
``steps`` rows before every test row are gathered by a window frame, the
filter to test rows runs directly above that window, and only test rows
cross into Python (Arrow batches) to meet the caller's predictor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.operators.calibration import apply_calibration
from demandlens.operators.features import assemble, build_features, feature_list, feature_vector
from demandlens.operators.scaling import split_scale
from demandlens.operators.scoring import PredictorFactory, finalize_results, score_sequences
from demandlens.operators.sequences import prior_sequence
from demandlens.plans.common import TEST, Evaluation, judge, result_inputs, union_history
from demandlens.schema import SEQUENCE_LENGTH
from demandlens.session import prepare_session
from demandlens.sources.readers import normalize

_KEEP = ["KEY", "DATE", "split", "_n_train", "_test_no", "_dup", "Actual_Sales", "DISCOUNT_IN", "EOSS_IN"]


def sequence_rows(history: DataFrame, feature_spec: DataFrame, *, scaler: DataFrame | None = None,
                  seq_len: int = SEQUENCE_LENGTH, min_history: int | None = None) -> DataFrame:
    """Every test row of a tagged history with its ``sequence`` of prior rows and,
    where it cannot be scored, the reason."""
    prepare_session(history.sparkSession)
    min_history = seq_len if min_history is None else min_history
    features = feature_list(feature_spec)
    cols = [f for f, _, _ in features]
    feats = build_features(normalize(history), "nn")
    inputs = result_inputs(feats)
    staged = feats.select("*", inputs[2], inputs[3].alias("DISCOUNT_IN"), inputs[4].alias("EOSS_IN"))
    assembled = assemble(staged, cols, keep=_KEEP)
    if scaler is not None:
        assembled = split_scale(assembled, features, scaler)
    is_test = (F.col("split") == TEST) & F.col("DATE").isNotNull()
    with_seq = prior_sequence(assembled, feature_vector(cols), seq_len, is_target=is_test)
    tests = with_seq.filter(F.col("split") == TEST)
    steps = F.coalesce(F.size("sequence"), F.lit(0))
    return tests.select("KEY", "DATE", "Actual_Sales", F.col("DISCOUNT_IN").alias("DISCOUNT"), F.col("EOSS_IN").alias("is_eoss"),
                        "sequence", "_n_train", (F.col("_test_no") == 1).alias("_first"), F.col("_dup").alias("_repeated"),
                        judge([("insufficient_history", F.col("_n_train") < min_history), ("missing_date", F.col("DATE").isNull()),
                               ("incomplete_features", steps < seq_len)]))


def sequence_inputs(train: DataFrame, test: DataFrame, feature_spec: DataFrame, *,
                    scaler: DataFrame | None = None, seq_len: int = SEQUENCE_LENGTH,
                    min_history: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(test rows with a complete ``sequence``, all judged test rows) of separate
    train and test tables."""
    tests = sequence_rows(union_history(normalize(train), normalize(test)), feature_spec, scaler=scaler, seq_len=seq_len,
                          min_history=min_history)
    return tests.filter("reason is null"), tests


def evaluate_sequence_history(history: DataFrame, feature_spec: DataFrame, predictor: PredictorFactory, *,
                              scaler: DataFrame | None = None, calibration: DataFrame | None = None,
                              seq_len: int = SEQUENCE_LENGTH, min_history: int | None = None,
                              batch_size: int = 256) -> Evaluation:
    """Score every test row with at least ``seq_len`` earlier rows, of every
    product with at least ``min_history`` (default ``seq_len``) train rows."""
    tests = sequence_rows(history, feature_spec, scaler=scaler, seq_len=seq_len, min_history=min_history)

    def finish(rows: DataFrame) -> DataFrame:
        slim = rows.filter("reason is null").select("KEY", "DATE", "Actual_Sales", "DISCOUNT", "is_eoss", "sequence")
        # the factor depends on KEY, discount and flag only: look it up while the
        # rows are still partitioned by KEY, before the Python stage drops that
        return finalize_results(score_sequences(apply_calibration(slim, calibration), predictor, batch_size=batch_size))

    return Evaluation(tests, finish)


def evaluate_sequence(train: DataFrame, test: DataFrame, feature_spec: DataFrame,
                      predictor: PredictorFactory, *, scaler: DataFrame | None = None,
                      calibration: DataFrame | None = None, seq_len: int = SEQUENCE_LENGTH,
                      min_history: int | None = None, batch_size: int = 256) -> Evaluation:
    """``evaluate_sequence_history`` of separate train and test tables."""
    return evaluate_sequence_history(union_history(normalize(train), normalize(test)), feature_spec, predictor, scaler=scaler,
                                     calibration=calibration, seq_len=seq_len, min_history=min_history, batch_size=batch_size)
