"""Sinks: round trip of written outputs and the metrics text format."""

import os
import tempfile

from pyspark.sql import functions as F

import registered
from demandlens.operators import reports as R
from demandlens.sources.readers import read_results
from demandlens.sources.sinks import metrics_text, write_metrics_text, write_table
from tests.conftest import SF_SMALL


def test_details_roundtrip_csv_and_parquet(spark):
    d = registered.details_a(spark, SF_SMALL).drop("calibration_level")
    base = tempfile.mkdtemp(prefix="dl-sink-")
    for fmt in ("parquet", "csv"):
        path = os.path.join(base, fmt)
        write_table(d, path, fmt)
        back = read_results(spark, path, fmt).select(*d.columns)
        assert back.exceptAll(d).count() == 0 and d.exceptAll(back).count() == 0


def test_metrics_text_lines(spark):
    d = registered.details_a(spark, SF_SMALL)
    s = R.metrics_summary(d)
    lines = [r["value"] for r in metrics_text(s).orderBy("pos").collect()]
    assert lines[0].startswith("Total Products: ") and lines[-1].startswith("Overall Error: ")
    assert len(lines) == 9 and lines[1] == f"Total Predictions: {d.count()}"
    path = os.path.join(tempfile.mkdtemp(prefix="dl-txt-"), "metrics")
    write_metrics_text(s, path)
    assert [r[0] for r in spark.read.text(path).collect()] == lines


def test_small_report_single_file(spark):
    d = registered.details_a(spark, SF_SMALL)
    path = os.path.join(tempfile.mkdtemp(prefix="dl-bins-"), "bins")
    write_table(R.bin_performance(d), path, "csv", single_file=True)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 1


def test_csv_columns_matched_by_name(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="dl-csv-"), "p")
    rows = [("2021-01-04", "k", "3.0", "extra"), ("2021-01-11", "k", "", "x")]
    spark.createDataFrame(rows, "DATE string, KEY string, QUANTITY_SOLD string, note string") \
        .write.option("header", True).csv(path)
    from demandlens.sources.readers import read_sales
    df = read_sales(spark, path, "csv")
    assert "DISCOUNT" not in df.columns and df.schema["QUANTITY_SOLD"].dataType.simpleString() == "double"
    got = sorted((str(r["DATE"]), r["KEY"], r["QUANTITY_SOLD"]) for r in df.collect())
    assert got == [("2021-01-04", "k", 3.0), ("2021-01-11", "k", None)]


def test_shortest_text_matches_python_repr(spark):
    import random
    from demandlens.sources.sinks import shortest_text
    rnd = random.Random(2)
    vals = [28347.0, 1.281298329939779, 1.509903313490213e-14, 21003095.60462404, 196773.5906662986, 1e-5,
            0.0001, 1e16, 1234567890123456.0, 0.1, 2.5, 100.0, 1.5e-4, 123456789.0, -4.25, -1e-7, 0.0, 1e22,
            float("inf"), float("-inf")]
    vals += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-9, 18) for _ in range(400)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(shortest_text(F.col("v"))).collect()]
    assert got == [repr(v) for v in vals]
    assert spark.createDataFrame([(None,)], "v double").select(shortest_text(F.col("v"))).first()[0] == "nan"
