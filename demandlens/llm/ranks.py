"""Places in a sorted order without a window over a whole group.

A window that numbers the rows of a group puts the group into one task.  Here
the table is range-partitioned by (group, order), so a group that holds a third
of all rows lies in many tasks; every task sorts and numbers its own rows, and
only one row for each (task, group) is summed up to turn task places into group
places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandlens.llm.common import cut

ROW_BITS = 33          # monotonically_increasing_id keeps the row of a task in its low 33 bits


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df``, written down with a number ``row_no`` for every row."""
    return cut(df.withColumn("row_no", F.monotonically_increasing_id()), name)


def ranked(rows: DataFrame, group: str, order: Sequence[str], name: str, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` of ``numbered`` rows, ``group`` (without nulls) and four
    columns more: ``n`` rows of the group, ``pos`` of the row in it from 0 in
    ascending ``order`` (nulls first), ``group_pos`` of the group among the groups
    and ``groups``, their number.

    Rows that agree in all of ``order`` stand by ``row_no``, so a much repeated row
    is no hot key.  That number and the places are written down before they are
    used: a task that runs again cannot change them.  Columns that only the order
    needs (long texts) go through one exchange and no further.
    """
    keys = [group, *order, "row_no"]
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                 .select(*dict.fromkeys([group, *keep]), F.monotonically_increasing_id().alias("_seq")), f"{name}-sorted")
    placed = placed.withColumn("_part", F.shiftright("_seq", ROW_BITS))

    runs = cut(placed.groupBy("_part", group).agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n")),
               f"{name}-runs")
    over_parts = Window.partitionBy(group).orderBy("_part")
    whole = over_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = over_parts.rowsBetween(Window.unboundedPreceding, -1)
    in_part = Window.partitionBy("_part").orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.select("*", F.sum("_n").over(whole).alias("n"),
                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                       (F.row_number().over(over_parts) == 1).cast("long").alias("_starts"))
    # one row for each task: the only window without a partition
    parts = runs.groupBy("_part").agg(F.sum("_starts").alias("_starts"))
    every = Window.partitionBy().orderBy("_part")
    parts = parts.select(
        "_part", F.coalesce(F.sum("_starts").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_groups_before"),
        F.sum("_starts").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("groups"))
    runs = runs.join(parts, "_part").select(
        "_part", group, "_first", "_before", "n", "groups",
        (F.col("_groups_before") + F.sum("_starts").over(in_part) - 1).alias("group_pos"))
    return (placed.join(runs, ["_part", group])
            .withColumn("pos", F.col("_seq") - F.col("_first") + F.col("_before"))
            .drop("_part", "_seq", "_first", "_before"))
