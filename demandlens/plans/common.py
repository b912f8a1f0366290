"""Pieces shared by the two evaluation jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.session import materialize

TEST, TRAIN = "test", "train"


class Evaluation:
    """Outputs of an evaluation job (lazy DataFrames), both from one stream of
    judged rows: every test row with what it needs for its result and the reason
    it has none, decided where the row is scored.

    details: one row per scored test row (result schema + Discount_Bin and
             calibration_level).
    skips:   (KEY, DATE, reason) for every product or row left out.
    """

    def __init__(self, judged: DataFrame, finish: Callable[[DataFrame], DataFrame]):
        self.judged = judged
        self._finish = finish
        self.details = finish(judged)

    @property
    def skips(self) -> DataFrame:
        return audit(self.judged)

    def stored(self) -> "Evaluation":
        """The same evaluation with the judged rows written once, so that details
        and skips are both read from them."""
        return Evaluation(materialize(self.judged, "judged"), self._finish)


def union_history(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test rows of every product in one frame, tagged by ``split``."""
    tagged_train = train.withColumn("split", F.lit(TRAIN))
    tagged_test = test.withColumn("split", F.lit(TEST))
    return tagged_train.unionByName(tagged_test, allowMissingColumns=True)


def result_inputs(df: DataFrame) -> list[Column]:
    """KEY, DATE, Actual_Sales, DISCOUNT (the raw test value, 0 when the panel
    has no discount) and is_eoss (0 when absent) of a scored row."""
    eoss = F.col("is_eoss") if "is_eoss" in df.columns else F.lit(0.0)
    return [F.col("KEY"), F.col("DATE"), F.col("QUANTITY_SOLD").cast("double").alias("Actual_Sales"),
            F.col("DISCOUNT_RAW").cast("double").alias("DISCOUNT"), eoss.cast("double").alias("is_eoss")]


PRODUCT_REASONS = ("no_model", "insufficient_history")


def judge(reasons: list[tuple[str, Column]]) -> Column:
    """``reason``: the first of (name, condition) that holds, null when none does."""
    out = None
    for name, cond in reasons:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.alias("reason")


def audit(judged: DataFrame) -> DataFrame:
    """(KEY, DATE, reason) of judged rows.  A reason of the whole product is told
    once, at its first test row, without a date; a repeated date is told besides."""
    reason = F.col("reason")
    whole = reason.isin(*PRODUCT_REASONS)
    main = F.when(whole & F.col("_first"), F.struct(F.lit(None).cast("date").alias("DATE"), reason.alias("reason"))) \
        .when(reason.isNotNull() & ~whole, F.struct("DATE", "reason"))
    repeated = F.when(F.col("_repeated"), F.struct("DATE", F.lit("duplicate_key_date").alias("reason")))
    told = F.array_compact(F.array(main, repeated))
    return judged.select("KEY", F.explode(told).alias("_t")).select("KEY", "_t.DATE", "_t.reason")
