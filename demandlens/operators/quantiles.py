"""Exact medians by distributed radix selection.

Spark's exact ``percentile`` buffers every distinct value of the column in the
single final reducer of a global aggregate.  ``exact_medians`` instead maps each
double to a 64-bit integer of the same order (its bits, with those of negative
numbers turned round) and finds the integer of the middle rank digit by digit: a
pass counts the values with the digits found so far by their next ``BITS`` bits,
map-side, and the bucket that holds the rank gives the next digit.  After
64 / BITS passes every bit is known.

A pass shuffles and returns at most 2^BITS rows for each rank that is looked for,
whatever the data: nothing is ordered, no task holds more than one table of buckets,
and there is no bracket to guess.  The integers are written once, so the plan behind
the column runs once.  For an even count the two middle values are averaged as
(a + b) / 2.  Nulls and NaN take no part.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.session import materialize

BITS = 16
_MAX = (1 << 63) - 1


def order_key(c: Column) -> Column:
    """A long in the order of the doubles of ``c`` (-0.0 as 0.0); null for null and NaN."""
    x = c.cast("double") + F.lit(0.0)
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x).cast("long")
    key = F.when(bits < 0, bits.bitwiseXOR(F.lit(_MAX))).otherwise(bits)
    return F.when(x.isNotNull() & ~F.isnan(x), key)


def value_of(key: int) -> float:
    """The double of an ``order_key``."""
    return struct.unpack(">d", struct.pack(">q", key if key >= 0 else key ^ _MAX))[0]


def _buckets(keys: DataFrame, n: int, shift: int, prefixes: dict[int, set[int]] | None) -> dict[tuple[int, int], int]:
    """(column, leading bits above ``shift``) -> values, of the columns k0..k{n-1},
    for the wanted leading bits one digit earlier."""
    tagged = []
    for i in range(n):
        k = F.col(f"k{i}")
        wanted = k.isNotNull() if prefixes is None else F.shiftright(k, shift + BITS).isin(*prefixes.get(i, {None}))
        tagged.append(F.when(wanted, F.struct(F.lit(i).alias("i"), F.shiftright(k, shift).alias("lead"))))
    rows = keys.select(F.explode(F.array_compact(F.array(*tagged))).alias("t")).select("t.i", "t.lead")
    counted = rows.groupBy("i", "lead").agg(F.count(F.lit(1)).alias("c")).toPandas()
    return {(int(i), int(lead)): int(c) for i, lead, c in zip(counted["i"], counted["lead"], counted["c"])}


def select_ranks(keys: DataFrame, n: int) -> list[list[int]]:
    """The keys of the middle ranks (one or two, none without values) of the
    columns k0..k{n-1}."""
    shift = 64 - BITS
    buckets = _buckets(keys, n, shift, None)
    targets = []                                       # (column, rank among the values with the leading bits, leading bits)
    for i in range(n):
        total = sum(c for (j, _), c in buckets.items() if j == i)
        targets += [(i, r, None) for r in ({(total - 1) // 2, total // 2} if total else ())]
    while True:
        found = []
        for i, rank, lead in targets:
            for (j, b), c in sorted(buckets.items()):
                if j == i and (lead is None or b >> BITS == lead):
                    if rank < c:
                        found.append((i, rank, b))
                        break
                    rank -= c
        targets = found
        if shift == 0 or not targets:
            return [sorted(b for j, _, b in targets if j == i) for i in range(n)]
        shift -= BITS
        prefixes: dict[int, set[int]] = {}
        for i, _, b in targets:
            prefixes.setdefault(i, set()).add(b)
        buckets = _buckets(keys, n, shift, prefixes)


def medians_of_keys(keys: DataFrame, n: int) -> list[float | None]:
    """Medians of the doubles behind the order keys k0..k{n-1} of a stored table."""
    out: list[float | None] = []
    for found in select_ranks(keys, n):
        values = [value_of(k) for k in found]
        out.append(None if not values else values[0] if len(values) == 1 else (values[0] + values[1]) / 2)
    return out


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    cols = list(dict.fromkeys(cols))
    keys = materialize(df.select(*[order_key(F.col(c)).alias(f"k{i}") for i, c in enumerate(cols)]), "median-keys")
    return dict(zip(cols, medians_of_keys(keys, len(cols))))


def exact_median(df: DataFrame, col: str) -> float | None:
    return exact_medians(df, [col])[col]


def quick_medians(mapping: dict[str, str], method: str) -> dict[str, Column]:
    """name -> aggregate Column: ``percentile_approx`` ('approx') or Spark's
    single-reducer ``percentile`` ('percentile', small inputs only)."""
    if method == "approx":
        return {name: F.percentile_approx(src, 0.5, 10_000).cast("double") for src, name in mapping.items()}
    if method == "percentile":
        return {name: F.percentile(src, 0.5) for src, name in mapping.items()}
    raise ValueError(f"unknown median method {method!r}")
