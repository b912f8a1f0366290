"""Two-model comparison job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from demandlens.operators.compare import comparison_by_bin, comparison_summary, pair_results
from demandlens.session import prepare_session
from demandlens.sources.readers import normalize


@dataclass
class Comparison:
    details: DataFrame
    summary: DataFrame
    by_bin: DataFrame


def compare_models(linear: DataFrame, neural: DataFrame) -> Comparison:
    """Pair two result tables by (KEY, DATE); an empty pairing gives empty
    outputs with the full schema."""
    prepare_session(linear.sparkSession)
    details = pair_results(normalize(linear), normalize(neural))
    return Comparison(details=details, summary=comparison_summary(details),
                      by_bin=comparison_by_bin(details))
