"""Readers with fixed schemas (no inference) and NaN/inf -> NULL at the door."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandlens.functions.numeric import nan_to_null
from demandlens.schema import PANEL_SCHEMA, RESULT_SCHEMA


def normalize(df: DataFrame) -> DataFrame:
    """DATE -> date (a failed parse raises under ANSI), doubles NaN/inf -> NULL."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name == "DATE" and not isinstance(f.dataType, T.DateType):
            c = F.to_date(c) if isinstance(f.dataType, T.StringType) else c.cast("date")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = nan_to_null(c.cast("double"))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV columns are matched to ``schema`` by header name (any order; absent
    optional columns stay absent; unknown columns are kept as text).  All
    fields are read as text and cast, so nothing is inferred and a value that
    does not parse fails the job under ANSI casts."""
    raw = spark.read.option("header", True).csv(path)
    types = {f.name: f.dataType for f in schema.fields}
    cols = []
    for c in raw.columns:
        t = types.get(c)
        if t is None or isinstance(t, T.StringType):
            cols.append(F.col(c))
        elif isinstance(t, T.DateType):
            cols.append(F.to_date(F.col(c)).alias(c))
        else:
            cols.append(F.col(c).cast(t).alias(c))
    return raw.select(*cols)


def read_sales(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | None = None) -> DataFrame:
    """A sales panel (KEY, DATE, QUANTITY_SOLD, optional DISCOUNT, is_eoss,
    holiday_label, ...).  CSV columns are typed by name from ``schema``
    (default: the panel schema)."""
    if fmt == "csv":
        return normalize(_typed_csv(spark, path, schema or PANEL_SCHEMA))
    return normalize(spark.read.format(fmt).load(path))


def read_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """An evaluation-result table (the comparison's input)."""
    if fmt == "csv":
        return normalize(_typed_csv(spark, path, RESULT_SCHEMA))
    return normalize(spark.read.format(fmt).load(path))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: T.StructType | None = None) -> DataFrame:
    """Parameter tables: models, feature spec, scaler, calibration (Parquet,
    JSON or any Spark format; CSV needs a schema for typed columns)."""
    if fmt == "csv" and schema is not None:
        return _typed_csv(spark, path, schema)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """A table of ``sinks.write_bucketed``.  Its values were normalized before they
    were written and its columns are read as they are, so the scan keeps its buckets."""
    return spark.table(table)
