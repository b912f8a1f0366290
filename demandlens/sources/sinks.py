"""Writers for the evaluation outputs.  Parquet by default, CSV on request.
Small reports (bins, metrics) are coalesced to one file; large ones are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.schema import METRIC_LABELS


def write_table(df: DataFrame, path: str, fmt: str = "parquet", *, single_file: bool = False,
                partition_by: list[str] | None = None) -> None:
    if single_file:
        df = df.coalesce(1)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def write_bucketed(df: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> None:
    """A Parquet table at ``path``, registered as ``table``, in one sorted file for
    each of ``buckets`` hash buckets of ``keys``.  Tables of one bucketing join on
    these keys without an exchange (``readers.read_bucketed``); the write is the one
    shuffle that all later joins save."""
    (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))


def shortest_text(x: Column) -> Column:
    """A double as Python prints it: the shortest digits that read back as the
    same double, in fixed notation for decimal exponents -4..15 and as
    ``d.ddde+XX`` otherwise; 'inf', '-inf', 'nan' (also for NULL)."""
    x = x.cast("double")
    cands = [F.format_string(f"%.{p}e", x) for p in range(17)]
    sci = F.coalesce(*[F.when(c.cast("double") == x, c) for c in cands], cands[-1])
    parts = r"^(-?)(\d)(?:\.(\d+))?e([+-]\d+)$"
    sign = F.regexp_extract(sci, parts, 1)
    frac = F.regexp_replace(F.regexp_extract(sci, parts, 3), "0+$", "")
    digits = F.concat(F.regexp_extract(sci, parts, 2), frac)
    e = F.regexp_extract(sci, parts, 4).cast("int")
    n = F.length(digits)
    p = e + 1                                   # digits before the decimal point
    fixed = (F.when(p <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -p), digits))
             .when(p >= n, F.concat(digits, F.repeat(F.lit("0"), p - n), F.lit(".0")))
             .otherwise(F.concat(F.substring(digits, 1, p), F.lit("."), F.substring(digits, p + 1, n))))
    mant = F.when(n > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 17))) \
        .otherwise(digits)
    exp = F.concat(F.when(e < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(e).cast("string"), 2, "0"))
    body = F.when((e >= -4) & (e < 16), fixed).otherwise(F.concat(mant, F.lit("e"), exp))
    return (F.when(x.isNull() | F.isnan(x), F.lit("nan"))
            .when(x == F.lit(float("inf")), F.lit("inf")).when(x == F.lit(float("-inf")), F.lit("-inf"))
            .when(x == 0, F.when(F.format_string("%s", x).startswith("-"), F.lit("-0.0")).otherwise(F.lit("0.0")))
            .otherwise(F.concat(sign, body)))


def metrics_text(summary: DataFrame) -> DataFrame:
    """One ``label: value`` line per metric, in the fixed order (one row in,
    nine rows out), formatted as the original text report: counts as
    integers, everything else as ``shortest_text``."""
    lines = []
    for pos, (col, label) in enumerate(METRIC_LABELS):
        c = F.col(col)
        text = c.cast("string") if col in ("total_products", "total_predictions") else shortest_text(c)
        lines.append(F.struct(F.lit(pos).alias("pos"), F.concat(F.lit(f"{label}: "), text).alias("value")))
    return (summary.select(F.explode(F.array(*lines)).alias("l"))
            .select("l.pos", "l.value"))


def write_metrics_text(summary: DataFrame, path: str) -> None:
    metrics_text(summary).coalesce(1).sortWithinPartitions("pos").select("value") \
        .write.mode("overwrite").text(path)
