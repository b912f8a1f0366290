"""Equal-width histograms with the conventions of a numpy/matplotlib ``hist``:
range [min, max] (min-0.5 .. max+0.5 when all values are equal, 0..1 when
there are none), bins left-closed except the last, edges
``first + i * (last - first) / n`` and the same off-by-one corrections at
the edges.

Lazy: no job runs before the result is asked for.  All series of a frame are
tallied together by value (equal values are one row, map-side); the ranges, one
row a series, are broadcast to the tally, and both read one shuffle of it, so the
plan behind the frame runs once.  All ``bins`` bins of every series are emitted; an
infinite value fails the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _raw(x: Column, first: Column, last: Column, bins: int) -> Column:
    raw = F.floor((x - first) * (F.lit(float(bins)) / (last - first))).cast("int")
    return F.when(raw >= bins, F.lit(bins - 1)).otherwise(raw)


def _edge(i: Column, first: Column, last: Column, bins: int) -> Column:
    return F.when(i >= bins, last).otherwise(i.cast("double") * ((last - first) / F.lit(float(bins))) + first)


def histograms(df: DataFrame, series: dict[str, str], bins: int) -> DataFrame:
    """(series, bin, bin_start, bin_end, count) of the columns ``series`` (name -> column)."""
    tagged = [F.struct(F.lit(name).alias("series"), F.col(c).cast("double").alias("x")) for name, c in series.items()]
    tally = (df.select(F.explode(F.array(*tagged)).alias("v")).select("v.series", "v.x")
             .filter(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("series", "x").agg(F.count(F.lit(1)).alias("n")))
    lo, hi = F.col("lo"), F.col("hi")
    bad = F.raise_error(F.concat(F.lit("histogram of "), F.col("series"), F.lit(": the range of the values is not finite")))
    endless = (lo == F.lit(float("-inf"))) | (hi == F.lit(float("inf")))
    ranges = (tally.groupBy("series").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("total"))
              .filter("total > 0")
              .select("series", F.when(endless, bad.cast("double")).when(lo < hi, lo).otherwise(lo - 0.5).alias("first"),
                      F.when(lo < hi, hi).otherwise(hi + 0.5).alias("last")))
    # one row a series: a proven size bound
    ranges = F.broadcast(ranges)
    x, i, first, last = F.col("x"), F.col("i"), F.col("first"), F.col("last")
    placed = tally.join(ranges, "series").select("series", "x", "n", "first", "last", _raw(x, first, last, bins).alias("i"))
    placed = placed.select("series", "x", "n", "first", "last", F.when(x < _edge(i, first, last, bins), i - 1).otherwise(i).alias("i"))
    fixed = F.when((x >= _edge(i + 1, first, last, bins)) & (i != bins - 1), i + 1).otherwise(i)
    counts = placed.select("series", "n", fixed.alias("bin")).groupBy("series", "bin").agg(F.sum("n").alias("count"))
    frame = (df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"),
                                                F.explode(F.array(*[F.lit(s) for s in series])).alias("series")))
    framed = frame.join(ranges, "series", "left").select(
        "series", "bin", F.coalesce(first, F.lit(0.0)).alias("first"), F.coalesce(last, F.lit(1.0)).alias("last"))
    b = F.col("bin")
    return framed.join(counts, ["series", "bin"], "left").select(
        "series", "bin", _edge(b, first, last, bins).alias("bin_start"), _edge(b + 1, first, last, bins).alias("bin_end"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    return histograms(df, {col: col}, bins).drop("series")
