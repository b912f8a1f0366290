"""The sequence of the ``steps`` rows strictly before each test row.

``collect_list`` over the frame ROWS BETWEEN steps PRECEDING AND 1 PRECEDING
keeps time order.  To avoid building arrays for history far from any test
row, a row contributes its vector only if a test row follows within
``steps`` rows; every row inside a test row's frame satisfies that, so test
sequences are complete while the rest stay empty.  The filter to test rows
sits directly above the window, before any exchange, so arrays never shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.operators.windows import in_time


def prior_sequence(df: DataFrame, vector: Column, steps: int, *, is_target: Column,
                   out_col: str = "sequence") -> DataFrame:
    """Add ``out_col`` (array of the previous ``steps`` vectors, oldest first)
    for rows where ``is_target``; other rows get NULL.  The vector itself is
    only built for rows some later target row needs."""
    needed = F.max(is_target.cast("int")).over(in_time().rowsBetween(1, steps))
    staged = df.select("*", needed.alias("_needed"))
    staged = staged.select("*", F.when(F.col("_needed") == 1, vector).alias("_vec"))
    seq = F.collect_list(F.col("_vec")).over(in_time().rowsBetween(-steps, -1))
    out = staged.select("*", F.when(is_target, seq).alias(out_col))
    return out.drop("_vec", "_needed")


def gather_steps(seq: Column, indices: Sequence[int]) -> Column:
    """Pick the given feature positions from every step of a sequence
    (array<array<double>> -> array<array<double>>)."""
    idx = F.array(*[F.lit(int(i)) for i in indices])
    return F.transform(seq, lambda step: F.transform(idx, lambda i: F.get(step, i)))
