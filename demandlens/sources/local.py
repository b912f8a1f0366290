"""Small fixed tables as local relations.

A ``VALUES`` list is planned as a ``LocalRelation``: Catalyst folds
projections into it and collecting it launches no job, unlike a Python list
or pandas frame, which become distributed RDD scans.  Only for tables whose
size is fixed by the code (bins, feature specs, scaler rows)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"{v!r}D"
    text = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def local_frame(spark: SparkSession, rows: Sequence[Sequence], columns: Sequence[tuple[str, str]]) -> DataFrame:
    """``columns``: (name, Spark SQL type) pairs; ``rows``: tuples in that order."""
    names = [n for n, _ in columns]
    typed = ", ".join(f"CAST(c{i} AS {t}) AS `{n}`" for i, (n, t) in enumerate(columns))
    aliases = ", ".join(f"c{i}" for i in range(len(columns)))
    if not rows:
        empty = ", ".join(f"CAST(NULL AS {t}) AS `{n}`" for n, t in columns)
        return spark.sql(f"SELECT {empty}").limit(0).select(*names)
    values = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT {typed} FROM VALUES {values} AS t({aliases})")
