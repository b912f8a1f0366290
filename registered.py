"""Registered queries: Spark callables and their DuckDB twins.

Every query reads ``lineitem`` and ``part`` of the given scale through the
sales panel, as one lazy plan, so its work grows with the tables.  ``SPEC[name] = (spark_fn, oracle_sql or None, float_cols)``;
float columns are rounded to 6 decimals on both sides before hashing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle as O
from demandlens.functions.bins import (
    calibration_bin, discount_bin, fine_discount_bin, report_bin, report_bin_ordinal,
)
from demandlens.operators import compare as C
from demandlens.operators import reports as R
from demandlens.operators.features import assemble, build_features, feature_list
from demandlens.operators.histogram import histogram, histograms
from demandlens.operators.quality import duplicate_keys, panel_profile
from demandlens.operators.scaling import split_scale, standard_scale
from demandlens.operators.scoring import MeanOfFeature
from demandlens.operators.sequences import gather_steps
from demandlens.plans.comparison import compare_models
from demandlens.plans.linear import evaluate_history
from demandlens.plans.sequence import evaluate_sequence_history, sequence_rows
from demandlens.schema import METRIC_LABELS
from demandlens.session import ensure_checkpoint_dir, prepare_session
from demandlens.sources import fixtures as fx
from demandlens.sources.readers import read_bucketed, read_results, read_sales, read_table
from demandlens.sources.sinks import metrics_text, write_bucketed, write_table

def panel(spark: SparkSession, sf: str) -> DataFrame:
    """The sales panel of ``sf``: a lazy plan over ``lineitem`` and ``part``."""
    prepare_session(spark)
    return fx.panel(spark, sf)


def dirty(p: DataFrame) -> DataFrame:
    day = F.dayofmonth("DATE")
    d = F.when(day == 1, F.lit(None).cast("double")).when(day == 2, F.lit(1.2)).otherwise(F.col("DISCOUNT"))
    return p.select("KEY", "DATE", "QUANTITY_SOLD", d.alias("DISCOUNT"), "is_eoss", "holiday_label", "split")


# means of percent errors reach ~1e8 (zero actuals over 1e-5): summation-order
# noise there is ~1e-5, so they are compared at 3 decimals
PCT_MEANS = {"Percent_Error_mean", "mean_percent_error", "Linear_Pct_Error", "Neural_Pct_Error",
             "linear_mape", "neural_mape"}


ROW_QUERIES = {"compare_details", "compare_common_rows", "compare_colocated", "comparison_file"}


def digits_of(col: str, name: str) -> int:
    pct_mean = col in PCT_MEANS and not (name in ROW_QUERIES and col.endswith("Pct_Error"))
    return 3 if pct_mean else 6


WHOLE = 9e15


def stable_round(col: str, d: int):
    """Round half up to ``d`` decimals in two explicit IEEE steps that DuckDB
    repeats bit for bit (``oracle.stable_round``): first snap to d+3 decimals,
    which absorbs last-ulp noise from summation order, then round.  Engine
    ``round`` functions disagree on exact halves; this does not.  A value of
    9e15 snapped units or more has no digits left to absorb noise with (and
    BIGINT floors would overflow further up): it is rounded to three decimals
    fewer, down to whole numbers; larger ones, +-inf, NaN and NULL pass
    through; -0.0 comes out as 0.0."""
    x = f"CAST(`{col}` AS DOUBLE)"
    steps = "".join(
        f" WHEN abs({x} * 1e{k + 3}D) < {WHOLE!r}D THEN "
        f"CAST(floor(CAST(floor({x} * 1e{k + 3}D + 0.5D) AS DOUBLE) / 1e3D + 0.5D) AS DOUBLE) / 1e{k}D" for k in range(d, -1, -3))
    return F.expr(f"CASE WHEN isnan({x}) THEN {x}{steps} ELSE {x} END")


def rnd(df: DataFrame, cols, name: str = "") -> DataFrame:
    cols = set(cols)
    return df.select(*[stable_round(c, digits_of(c, name)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def linear_eval(spark, sf, model="a", *, calibrated=True, min_history=5, drop_type=None, src=None,
                leak_free=False):
    p, keys = panel(spark, sf) if src is None else src, fx.products(spark, sf)
    ev = evaluate_history(p, fx.linear_model(keys, model), fx.feature_spec(spark, "base"),
                          calibration=fx.calibration_table(keys) if calibrated else None,
                          min_history=min_history, leak_free=leak_free)
    if drop_type:
        ev.details = ev.details.filter(~F.col("KEY").endswith("/" + drop_type))
    return ev


def details_a(spark, sf):
    return linear_eval(spark, sf, "a").details


DETAIL_FLOATS = ["Actual_Sales", "Predicted_Sales", "Raw_Prediction", "Absolute_Error", "Percent_Error",
                 "DISCOUNT", "is_eoss"]
DETAIL_COLS = ("KEY, DATE, Actual_Sales, Predicted_Sales, Raw_Prediction, Absolute_Error, Percent_Error, "
               "DISCOUNT, is_eoss, Discount_Bin, calibration_level")

# ------------------------------------------------------------------ bins


def q_bin_performance(spark, sf):
    return R.bin_performance(details_a(spark, sf))


BINPERF_FLOATS = ["Actual_Sales_sum", "Actual_Sales_mean", "Predicted_Sales_sum", "Predicted_Sales_mean",
                  "Absolute_Error_mean", "Percent_Error_mean", "Total_Error", "Error_Percent"]
SQL_BIN_PERFORMANCE = O.with_(O.details_ctes("a") + ",\n" + O.BINS_TABLE + """,
g AS (select Discount_Bin, sum(Actual_Sales) s_a, avg(Actual_Sales) m_a, count(Actual_Sales) c_a,
             sum(Predicted_Sales) s_p, avg(Predicted_Sales) m_p, avg(Absolute_Error) mae, avg(Percent_Error) mpe
      from details where Discount_Bin is not null group by Discount_Bin),
j AS (select b.bin_ordinal, b.Discount_Bin, coalesce(s_a, 0.0) as Actual_Sales_sum, m_a as Actual_Sales_mean,
             coalesce(c_a, 0) as Actual_Sales_count, coalesce(s_p, 0.0) as Predicted_Sales_sum,
             m_p as Predicted_Sales_mean, mae as Absolute_Error_mean, mpe as Percent_Error_mean
      from bins b left join g on b.Discount_Bin = g.Discount_Bin)""",
    "select *, Predicted_Sales_sum - Actual_Sales_sum as Total_Error, "
    + O.inf_ratio("(Predicted_Sales_sum - Actual_Sales_sum)", "Actual_Sales_sum") + " as Error_Percent from j")


def q_bin_mae(spark, sf):
    return R.bin_mae(details_a(spark, sf))


def q_bin_means(spark, sf):
    return R.bin_means(details_a(spark, sf))


def _bin_sql(aggs: str, cols: str) -> str:
    return O.with_(O.details_ctes("a") + ",\n" + O.BINS_TABLE + f""",
g AS (select Discount_Bin, {aggs} from details where Discount_Bin is not null group by Discount_Bin)""",
                   f"select b.Discount_Bin, b.bin_ordinal, {cols} from bins b left join g on b.Discount_Bin = g.Discount_Bin")


SQL_BIN_MAE = _bin_sql("avg(Absolute_Error) as Absolute_Error", "Absolute_Error")
SQL_BIN_MEANS = _bin_sql("avg(Actual_Sales) as Actual_Sales, avg(Predicted_Sales) as Predicted_Sales",
                         "Actual_Sales, Predicted_Sales")


def q_eoss_mae(spark, sf):
    return R.eoss_mae(details_a(spark, sf))


SQL_EOSS_MAE = O.with_(O.details_ctes("a") + """,
g AS (select is_eoss, avg(Absolute_Error) as Absolute_Error from details where is_eoss is not null group by is_eoss)""",
                       "select is_eoss, Absolute_Error, case when is_eoss = 0.0 then 'Non-EOSS' when is_eoss = 1.0 "
                       "then 'EOSS' end as EOSS_Status from g where (select count(*) from g) > 1")

# ------------------------------------------------------------------ panel, quality


def q_panel(spark, sf):
    return panel(spark, sf)


SQL_PANEL = O.with_("\nx AS (select 1)", "select * from panel")


def q_panel_profile(spark, sf):
    return panel_profile(panel(spark, sf))


SQL_PANEL_PROFILE = O.with_("\nx AS (select 1)",
                            "select split, count(*) as rows, count(distinct KEY) as products from panel group by split "
                            "union all select 'all', count(*), count(distinct KEY) from panel")


def q_duplicates(spark, sf):
    p = panel(spark, sf)
    doubled = p.unionByName(p.filter(F.col("KEY").endswith("/PROMO") & (F.col("split") == "test")))
    return duplicate_keys(doubled)


SQL_DUPLICATES = O.with_("""
u AS (select * from panel union all select * from panel where KEY like '%/PROMO' and split = 'test')""",
                         "select KEY, DATE, count(*) as rows from u group by KEY, DATE having count(*) > 1")


def q_csv_roundtrip(spark, sf):
    p = panel(spark, sf).drop("split")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-roundtrip-{uuid.uuid4().hex}"
    write_table(p, path, "csv")
    return read_sales(spark, path, "csv")


SQL_CSV_ROUNDTRIP = O.with_("\nx AS (select 1)",
                            "select KEY, DATE, QUANTITY_SOLD, DISCOUNT, is_eoss, holiday_label from panel")

# ------------------------------------------------------------------ features

BASE_FLOATS = O.BASE_FEATURES
NN_FLOATS = O.NN_FEATURES


def q_base_features(spark, sf, leak_free=False):
    f = build_features(dirty(panel(spark, sf)), "base", leak_free=leak_free)
    return assemble(f, fx.profile_features("base"), keep=["KEY", "DATE", "split"])


def q_leak_free_features(spark, sf):
    return q_base_features(spark, sf, leak_free=True)


def _base_features_sql(leak_free=False):
    return O.with_(O.base_feature_ctes("panel_dirty", leak_free=leak_free),
                   f"select KEY, DATE, split, {O.cleaned(O.BASE_FEATURES, O.BASE_HAVE)} from bf")


def q_nn_features(spark, sf):
    f = build_features(dirty(panel(spark, sf)), "nn")
    return assemble(f, fx.profile_features("nn"), keep=["KEY", "DATE", "split"])


SQL_NN_FEATURES = O.with_(O.nn_feature_ctes("panel_dirty"),
                          f"select KEY, DATE, split, {O.cleaned(O.NN_FEATURES, O.NN_HAVE)} from nf")


def q_discount_bins(spark, sf):
    d = F.col("DISCOUNT")
    return (dirty(panel(spark, sf)).select("DISCOUNT").distinct()
            .select("DISCOUNT", discount_bin(d).alias("DISCOUNT_BIN"), fine_discount_bin(d).alias("DISCOUNT_FINE_BIN"),
                    report_bin(d).alias("Report_Bin"), report_bin_ordinal(d).alias("Report_Ordinal"),
                    calibration_bin(d).alias("Calibration_Bin")))


SQL_DISCOUNT_BINS = O.with_("\nx AS (select distinct DISCOUNT from panel_dirty)",
                            f"select DISCOUNT, {O.DBIN('DISCOUNT')} as DISCOUNT_BIN, {O.FBIN('DISCOUNT')} as DISCOUNT_FINE_BIN, "
                            f"{O.RBIN('DISCOUNT')} as Report_Bin, {O.RORD('DISCOUNT')} as Report_Ordinal, "
                            f"{O.CBIN('DISCOUNT')} as Calibration_Bin from x")


def q_standard_scaled(spark, sf):
    f = build_features(panel(spark, sf), "base").filter(F.col("split") == "test")
    cols = fx.profile_features("base")
    return standard_scale(assemble(f, cols, keep=["KEY", "DATE"]), cols, fx.scaler_table(spark, "base", split=False))


SQL_STANDARD_SCALED = O.with_(O.base_feature_ctes("panel"),
                              "select KEY, DATE, " + ", ".join(
                                  f"({O.clean(c) if c in O.BASE_HAVE else '0.0'} - 8.0) / 4.0 as {c}"
                                  for c in O.BASE_FEATURES) + " from bf where split = 'test'")


def q_split_scaled(spark, sf):
    f = build_features(panel(spark, sf), "nn").filter(F.col("split") == "test")
    spec = feature_list(fx.feature_spec(spark, "nn"))
    cols = [c for c, _, _ in spec]
    return split_scale(assemble(f, cols, keep=["KEY", "DATE"]), spec, fx.scaler_table(spark, "nn", split=True))


def _split_expr(c):
    v = O.clean(c) if c in O.NN_HAVE else "0.0"
    if "discount" in c.lower():
        return f"{v} * 2.0 + -0.5 as {c}"
    if c in fx.CATEGORICAL:
        return f"{v} as {c}"
    return f"({v} - 8.0) / 4.0 as {c}"


SQL_SPLIT_SCALED = O.with_(O.nn_feature_ctes("panel"),
                           "select KEY, DATE, " + ", ".join(_split_expr(c) for c in O.NN_FEATURES)
                           + " from nf where split = 'test'")

# ------------------------------------------------------------------ linear evaluation


def q_linear_details(spark, sf):
    return details_a(spark, sf)


def q_linear_details_b(spark, sf):
    return linear_eval(spark, sf, "b", calibrated=False).details


def q_linear_details_leak_free(spark, sf):
    return linear_eval(spark, sf, "a", leak_free=True).details


def q_min_history_gate(spark, sf):
    return linear_eval(spark, sf, "a", min_history=200).details


def q_optional_columns(spark, sf):
    p = panel(spark, sf).select("KEY", "DATE", "QUANTITY_SOLD", "split")
    return linear_eval(spark, sf, "a", calibrated=False, src=p).details


SQL_LINEAR_DETAILS = O.with_(O.details_ctes("a"), f"select {DETAIL_COLS} from details")
SQL_LINEAR_DETAILS_B = O.with_(O.details_ctes("b", calibrated=False), f"select {DETAIL_COLS} from details")
SQL_LINEAR_DETAILS_LEAK_FREE = O.with_(O.details_ctes("a", leak_free=True), f"select {DETAIL_COLS} from details")
SQL_MIN_HISTORY_GATE = O.with_(O.details_ctes("a", min_history=200), f"select {DETAIL_COLS} from details")
SQL_OPTIONAL_COLUMNS = O.with_(
    "\nbare AS (select KEY, DATE, QUANTITY_SOLD, 0.0 as DISCOUNT, 0.0 as is_eoss, 0.0 as holiday_label, split from panel),"
    + O.details_ctes("a", calibrated=False, src="bare")[1:],
    f"select {DETAIL_COLS} from details")


def q_skip_audit(spark, sf):
    return linear_eval(spark, sf, "a", min_history=200).skips


SQL_SKIP_AUDIT = O.with_("""
k AS (select KEY, count(case when split = 'train' then 1 end) as n_train from panel group by KEY)""",
                         "select KEY, cast(NULL as date) as DATE, 'no_model' as reason from k where KEY like '%/STANDARD' "
                         "union all select KEY, cast(NULL as date), 'insufficient_history' from k "
                         "where KEY not like '%/STANDARD' and n_train < 200")

# ------------------------------------------------------------------ metrics and reports

METRIC_FLOATS = ["mean_absolute_error", "median_absolute_error", "mean_percent_error", "median_percent_error",
                 "total_actual_sales", "total_predicted_sales", "overall_error"]


def q_metrics_summary(spark, sf):
    return R.metrics_summary(details_a(spark, sf))


SQL_METRICS_INNER = O.with_(O.details_ctes("a") + """,
m AS (select count(distinct KEY) as total_products, count(*) as total_predictions,
             avg(Absolute_Error) as mean_absolute_error, median(Absolute_Error) as median_absolute_error,
             avg(Percent_Error) as mean_percent_error, median(Percent_Error) as median_percent_error,
             coalesce(sum(Actual_Sales), 0.0) as total_actual_sales,
             coalesce(sum(Predicted_Sales), 0.0) as total_predicted_sales from details)""",
                            "select *, " + O.inf_ratio("(total_predicted_sales - total_actual_sales)", "total_actual_sales")
                            + " as overall_error from m")
SQL_METRICS_SUMMARY = SQL_METRICS_INNER


def q_metrics_long(spark, sf):
    return R.metrics_long(R.metrics_summary(details_a(spark, sf)))


SQL_METRICS_LONG = ("select * from (" + " union all ".join(
    f"select cast({i} as integer) as pos, '{label}' as metric, cast({col} as double) as value from ({SQL_METRICS_INNER}) t{i}"
    for i, (col, label) in enumerate(METRIC_LABELS)) + ") u")


def q_metrics_text(spark, sf):
    """The text report of the (hash-rounded) summary: 'Label: value' lines."""
    return metrics_text(rnd(R.metrics_summary(details_a(spark, sf)), METRIC_FLOATS, "metrics_text"))


def _metrics_text_sql() -> str:
    lines = []
    for i, (col, label) in enumerate(METRIC_LABELS):
        if col in METRIC_FLOATS:
            v = f"coalesce(cast({O.stable_round(col, digits_of(col, 'metrics_text'))} as varchar), 'nan')"
        else:
            v = f"cast({col} as varchar)"
        lines.append(f"select cast({i} as integer) as pos, concat('{label}: ', {v}) as value from m")
    return f"with m AS ({SQL_METRICS_INNER}) " + " union all ".join(lines)


def q_product_summary(spark, sf):
    return R.product_summary(details_a(spark, sf))


PRODUCT_FLOATS = ["Actual_Sales", "Predicted_Sales", "Absolute_Error", "DISCOUNT", "Total_Error", "Percent_Error"]
_PRODUCT_CTE = O.details_ctes("a") + """,
ps AS (select KEY, coalesce(sum(Actual_Sales), 0.0) as Actual_Sales, coalesce(sum(Predicted_Sales), 0.0) as Predicted_Sales,
              avg(Absolute_Error) as Absolute_Error, avg(DISCOUNT) as DISCOUNT from details group by KEY),
ps2 AS (select *, Predicted_Sales - Actual_Sales as Total_Error, """ + O.inf_ratio(
    "(Predicted_Sales - Actual_Sales)", "Actual_Sales") + " as Percent_Error from ps)"
SQL_PRODUCT_SUMMARY = O.with_(_PRODUCT_CTE, "select * from ps2")


def q_top_error_products(spark, sf):
    return R.top_error_products(details_a(spark, sf))


SQL_TOP_ERROR_PRODUCTS = O.with_(_PRODUCT_CTE, "select KEY, Actual_Sales, Predicted_Sales, Percent_Error, DISCOUNT "
                                               "from ps2 order by Percent_Error desc nulls last, KEY limit 10")


def q_top_volume_products(spark, sf):
    return R.top_volume_products(details_a(spark, sf))


SQL_TOP_VOLUME_PRODUCTS = O.with_(O.details_ctes("a") + """,
v AS (select KEY, coalesce(sum(Actual_Sales), 0.0) as Actual_Sales, coalesce(sum(Predicted_Sales), 0.0) as Predicted_Sales
      from details group by KEY order by Actual_Sales desc, KEY limit 10)""",
                                  "select KEY, concat(substring(KEY, 1, 10), '...') as Label, Actual_Sales, Predicted_Sales from v")


def q_top_volume_rows(spark, sf):
    return R.top_volume_rows(details_a(spark, sf))


SQL_TOP_VOLUME_ROWS = O.with_(O.details_ctes("a") + """,
v AS (select KEY from details group by KEY order by coalesce(sum(Actual_Sales), 0.0) desc, KEY limit 10)""",
                              f"select {DETAIL_COLS} from details where KEY in (select KEY from v)")


def q_error_histogram(spark, sf):
    return histogram(details_a(spark, sf), "Absolute_Error", 50)


def hist_sql(source_cte: str, col: str, bins: int, series: str | None = None) -> str:
    """numpy-style equal-width histogram in SQL (same edge rules)."""
    s = f"'{series}' as series, " if series else ""
    return f"""
(with v AS (select cast({col} as double) as x from {source_cte} where {col} is not null and not isnan({col})),
r AS (select case when min(x) < max(x) then min(x) else min(x) - 0.5 end as lo,
             case when min(x) < max(x) then max(x) else max(x) + 0.5 end as hi from v),
i0 AS (select x, least(cast(floor((x - lo) * ({bins}.0 / (hi - lo))) as integer), {bins - 1}) as i, lo, hi from v, r),
i1 AS (select x, lo, hi, case when x < (case when i >= {bins} then hi else i * ((hi - lo) / {bins}.0) + lo end)
                        then i - 1 else i end as i from i0),
i2 AS (select case when x >= (case when i + 1 >= {bins} then hi else (i + 1) * ((hi - lo) / {bins}.0) + lo end)
                    and i <> {bins - 1} then i + 1 else i end as bin from i1),
c AS (select bin, count(*) as cnt from i2 group by bin),
f AS (select cast(generate_series as integer) as bin from generate_series(0, {bins - 1}))
select {s}f.bin, case when f.bin >= {bins} then hi else f.bin * ((hi - lo) / {bins}.0) + lo end as bin_start,
       case when f.bin + 1 >= {bins} then hi else (f.bin + 1) * ((hi - lo) / {bins}.0) + lo end as bin_end,
       coalesce(cnt, 0) as count
from f cross join r left join c on f.bin = c.bin)"""


SQL_ERROR_HISTOGRAM = O.with_(O.details_ctes("a"), "select * from " + hist_sql("details", "Absolute_Error", 50))


def q_scatter_limit(spark, sf):
    return R.scatter_limit(details_a(spark, sf))


SQL_SCATTER_LIMIT = O.with_(O.details_ctes("a"),
                            "select greatest(max(Actual_Sales), max(Predicted_Sales)) * 1.1 as max_val from details")


def q_discount_loss(spark, sf):
    return R.discount_sensitive_loss(details_a(spark, sf), group_by=["Discount_Bin"])


SQL_DISCOUNT_LOSS = O.with_(O.details_ctes("a") + """,
e AS (select Discount_Bin, Actual_Sales - greatest(Predicted_Sales, 1e-7) as e from details)""",
                            "select Discount_Bin, avg((case when e > 0 then 1.5 else 1.0 end) * "
                            "least(greatest(e, -1e6), 1e6) * least(greatest(e, -1e6), 1e6)) as loss, count(*) as n "
                            "from e group by Discount_Bin")

# ------------------------------------------------------------------ sequences

NN_COLS = fx.profile_features("nn")
LAG1 = NN_COLS.index("lag_1")
RM4 = NN_COLS.index("rolling_mean_4")
DISC_IDX = [i for i, c in enumerate(NN_COLS) if "discount" in c.lower()]
SEQ_W = "partition by KEY order by DATE rows between 52 preceding and 1 preceding"


def _seq(spark, sf):
    return sequence_rows(panel(spark, sf), fx.feature_spec(spark, "nn")).filter("reason is null")


def q_sequence_window(spark, sf):
    s = F.col("sequence")
    return _seq(spark, sf).select(
        "KEY", "DATE", F.size(s).alias("steps"),
        F.get(F.get(s, 0), LAG1).alias("first_lag_1"), F.get(F.get(s, 51), LAG1).alias("last_lag_1"),
        F.aggregate(s, F.lit(0.0), lambda acc, step: acc + F.get(step, RM4)).alias("sum_rolling_mean_4"))


_NN_CLEAN = O.nn_feature_ctes("panel") + f""",
nc AS (select KEY, DATE, split, n_train, {O.cleaned(O.NN_FEATURES, O.NN_HAVE)} from nf)"""
SQL_SEQUENCE_WINDOW = O.with_(_NN_CLEAN + f""",
sw AS (select KEY, DATE, split, n_train, count(*) over ({SEQ_W}) as steps,
              lag(lag_1, 52) over (partition by KEY order by DATE) as first_lag_1,
              lag(lag_1, 1) over (partition by KEY order by DATE) as last_lag_1,
              sum(rolling_mean_4) over ({SEQ_W}) as sum_rolling_mean_4 from nc)""",
                              "select KEY, DATE, cast(steps as integer) as steps, first_lag_1, last_lag_1, sum_rolling_mean_4 "
                              "from sw where split = 'test' and n_train >= 52 and steps = 52")


def q_sequence_gather(spark, sf):
    g = gather_steps(F.col("sequence"), DISC_IDX)
    flat_sum = F.aggregate(g, F.lit(0.0), lambda acc, step: acc + F.aggregate(step, F.lit(0.0), lambda a, v: a + v))
    return _seq(spark, sf).select("KEY", "DATE", F.size(g).alias("steps"), F.size(F.get(g, 0)).alias("width"),
                                  flat_sum.alias("discount_total"))


SQL_SEQUENCE_GATHER = O.with_(_NN_CLEAN + f""",
sg AS (select KEY, DATE, split, n_train, count(*) over ({SEQ_W}) as steps,
              sum({' + '.join(NN_COLS[i] for i in DISC_IDX)}) over ({SEQ_W}) as discount_total from nc)""",
                              f"select KEY, DATE, cast(steps as integer) as steps, cast({len(DISC_IDX)} as integer) as width, "
                              "discount_total from sg where split = 'test' and n_train >= 52 and steps = 52")


def q_sequence_scores(spark, sf):
    ev = evaluate_sequence_history(panel(spark, sf), fx.feature_spec(spark, "nn"), MeanOfFeature(LAG1),
                                   calibration=fx.calibration_table(fx.products(spark, sf)))
    return ev.details


_F_CAL, _LV_CAL = O.calibration_case()
SQL_SEQUENCE_SCORES = O.with_(_NN_CLEAN.replace("select KEY, DATE, split, n_train,",
                                                "select KEY, DATE, split, n_train, QUANTITY_SOLD, DISCOUNT_RAW, is_eoss as is_eoss_raw,") + f""",
sq AS (select KEY, DATE, split, n_train, QUANTITY_SOLD as Actual_Sales, DISCOUNT_RAW as DISCOUNT, is_eoss_raw as is_eoss,
              count(*) over ({SEQ_W}) as steps, avg(lag_1) over ({SEQ_W}) as Raw_Prediction,
              {O.CBIN('DISCOUNT_RAW')} as cal_bin from nc),
cal AS (select *, {_F_CAL} as calibration_factor, {_LV_CAL} as calibration_level from sq
        where split = 'test' and n_train >= 52 and steps = 52),
pred AS (select *, case when Raw_Prediction * calibration_factor > 0 then Raw_Prediction * calibration_factor else 0.0 end
         as Predicted_Sales from cal),
err AS (select *, abs(Predicted_Sales - Actual_Sales) as Absolute_Error from pred)""",
                              "select KEY, DATE, Actual_Sales, Predicted_Sales, Raw_Prediction, Absolute_Error, "
                              "Absolute_Error / (Actual_Sales + 1e-5) * 100 as Percent_Error, DISCOUNT, is_eoss, "
                              f"{O.RBIN('DISCOUNT')} as Discount_Bin, calibration_level from err")

# ------------------------------------------------------------------ comparison


def results_ab(spark, sf):
    """The results of both models, all rows."""
    return linear_eval(spark, sf, "a").details, linear_eval(spark, sf, "b").details


def partial_results_ab(spark, sf):
    """Results that differ in their rows, so that pairing has something to leave out."""
    return (linear_eval(spark, sf, "a", drop_type="PROMO").details,
            linear_eval(spark, sf, "b", drop_type="LARGE").details)


def q_compare_details(spark, sf):
    a, b = results_ab(spark, sf)
    return compare_models(a, b).details


def q_compare_summary(spark, sf):
    a, b = results_ab(spark, sf)
    return compare_models(a, b).summary


def q_compare_by_bin(spark, sf):
    a, b = results_ab(spark, sf)
    return compare_models(a, b).by_bin


def q_compare_bin_error_long(spark, sf):
    a, b = results_ab(spark, sf)
    return C.bin_error_long(compare_models(a, b).details)


def q_compare_histogram(spark, sf):
    a, b = results_ab(spark, sf)
    return histograms(compare_models(a, b).details, {"Linear": "Linear_Error", "Neural": "Neural_Error"}, 30)


def q_common_pairs(spark, sf):
    a, b = partial_results_ab(spark, sf)
    return C.common_pairs(a, b)


def q_compare_common_rows(spark, sf):
    """Pairs of results that differ in their rows."""
    a, b = partial_results_ab(spark, sf)
    return compare_models(a, b).details


def q_restricted_rows(spark, sf):
    """The rows of one result that the other has too, labelled and in label order."""
    a, b = partial_results_ab(spark, sf)
    kept = C.display_key(C.restrict_to(a, C.common_pairs(a, b)))
    return kept.select("KEY_DATE", "KEY", "DATE", "Predicted_Sales", "Absolute_Error").orderBy("KEY_DATE")


def q_compare_colocated(spark, sf):
    """The comparison of two stored results that share their buckets: no exchange."""
    base, run = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables", uuid.uuid4().hex
    tables = []
    for side, details in zip("ab", results_ab(spark, sf)):
        tables.append(f"results_{side}_{run}")
        write_bucketed(details, tables[-1], f"{base}/{tables[-1]}", C.PAIR, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return C.pair_results(*[read_bucketed(spark, t) for t in tables])


def written(spark, df, fmt="csv", **kw):
    """``df`` written as a report and read back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    write_table(df, path, fmt, **kw)
    return read_table(spark, path, fmt, df.schema)


def q_product_summary_file(spark, sf):
    return written(spark, R.product_summary(details_a(spark, sf)))


def q_bin_performance_file(spark, sf):
    return written(spark, R.bin_performance(details_a(spark, sf)), single_file=True)


def comparison_of_files(spark, sf):
    """The comparison job's input: both results written as CSV, read by name and type."""
    sides = []
    for details in results_ab(spark, sf):
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
        write_table(details, path, "csv")
        sides.append(read_results(spark, path, "csv"))
    return compare_models(*sides)


def q_comparison_file(spark, sf):
    return written(spark, comparison_of_files(spark, sf).details)


def q_comparison_bins_file(spark, sf):
    return written(spark, comparison_of_files(spark, sf).by_bin, single_file=True)


def _ab_ctes(whole=True):
    drop_a, drop_b = (None, None) if whole else ("PROMO", "LARGE")
    return O.details_ctes("a", drop_type=drop_a) + "," + O.details_ctes("b", drop_type=drop_b, sfx="_b")


_CMP_TAIL = """,
cmp0 AS (select l.KEY, l.DATE, l.Actual_Sales, l.Predicted_Sales as Linear_Predicted, n.Predicted_Sales as Neural_Predicted,
                l.Absolute_Error as Linear_Error, n.Absolute_Error as Neural_Error,
                l.Percent_Error as Linear_Pct_Error, n.Percent_Error as Neural_Pct_Error, l.DISCOUNT, l.is_eoss
         from details l join details_b n on l.KEY = n.KEY and l.DATE = n.DATE),
cmp AS (select *, case when Linear_Error < Neural_Error then 'Linear' when Neural_Error < Linear_Error then 'Neural'
                  else 'Equal' end as Better_Model, """ + O.RBIN("DISCOUNT") + """ as Discount_Bin from cmp0)"""
_CMP = _ab_ctes() + _CMP_TAIL
CMP_FLOATS = ["Actual_Sales", "Linear_Predicted", "Neural_Predicted", "Linear_Error", "Neural_Error",
              "Linear_Pct_Error", "Neural_Pct_Error", "DISCOUNT", "is_eoss"]
SQL_COMPARE_DETAILS = O.with_(_CMP, "select * from cmp")
SQL_COMPARE_SUMMARY = O.with_(_CMP, """select count(*) as common_predictions,
  avg(Linear_Error) as linear_mae, avg(Neural_Error) as neural_mae, avg(Linear_Pct_Error) as linear_mape,
  avg(Neural_Pct_Error) as neural_mape,
  avg(case when Better_Model = 'Linear' then 1.0 else 0.0 end) * 100 as linear_win_rate,
  avg(case when Better_Model = 'Neural' then 1.0 else 0.0 end) * 100 as neural_win_rate,
  avg(case when Better_Model = 'Equal' then 1.0 else 0.0 end) * 100 as equal_rate from cmp""")
_CMP_BIN = _CMP + ",\n" + O.BINS_TABLE + """,
g AS (select Discount_Bin, sum(Actual_Sales) as a, sum(Linear_Predicted) as lp, sum(Neural_Predicted) as np,
             avg(Linear_Error) as le, avg(Neural_Error) as ne, avg(Linear_Pct_Error) as lpe, avg(Neural_Pct_Error) as npe,
             avg(case when Better_Model = 'Linear' then 1.0 else 0.0 end) * 100 as lw
      from cmp where Discount_Bin is not null group by Discount_Bin),
cb AS (select b.bin_ordinal, b.Discount_Bin, coalesce(a, 0.0) as Actual_Sales, coalesce(lp, 0.0) as Linear_Predicted,
              coalesce(np, 0.0) as Neural_Predicted, le as Linear_Error, ne as Neural_Error, lpe as Linear_Pct_Error,
              npe as Neural_Pct_Error, lw as Linear_Win_Rate, 100.0 - lw as Neural_Win_Rate
       from bins b left join g on b.Discount_Bin = g.Discount_Bin)"""
SQL_COMPARE_BY_BIN = O.with_(_CMP_BIN, "select * from cb")
SQL_COMPARE_BIN_ERROR_LONG = O.with_(_CMP_BIN, "select bin_ordinal, Discount_Bin, 'Linear' as Model, Linear_Error as Error from cb "
                                               "union all select bin_ordinal, Discount_Bin, 'Neural', Neural_Error from cb")
SQL_COMPARE_HISTOGRAM = O.with_(_CMP, "select * from " + hist_sql("cmp", "Linear_Error", 30, "Linear")
                                + " union all select * from " + hist_sql("cmp", "Neural_Error", 30, "Neural"))
SQL_COMPARE_COMMON_ROWS = O.with_(_ab_ctes(whole=False) + _CMP_TAIL, "select * from cmp")
SQL_RESTRICTED_ROWS = O.with_(_ab_ctes(whole=False), "select concat(KEY, '_', cast(DATE as varchar)) as KEY_DATE, KEY, DATE, "
                              "Predicted_Sales, Absolute_Error from details d "
                              "where exists (select 1 from details_b b where b.KEY = d.KEY and b.DATE = d.DATE)")
SQL_COMMON_PAIRS = O.with_(_ab_ctes(whole=False), "select KEY, DATE from details intersect select KEY, DATE from details_b")


# ------------------------------------------------------------------ dirty discounts (C5, C8, C9, C16)


def dirty_details(spark, sf):
    p = panel(spark, sf)
    return linear_eval(spark, sf, "a", src=dirty(p)).details


def q_dirty_details(spark, sf):
    return dirty_details(spark, sf)


def q_dirty_bin_performance(spark, sf):
    return R.bin_performance(dirty_details(spark, sf))


def q_dirty_metrics(spark, sf):
    return R.metrics_summary(dirty_details(spark, sf))


SQL_DIRTY_DETAILS = O.with_(O.details_ctes("a", src="panel_dirty"), f"select {DETAIL_COLS} from details")
SQL_DIRTY_BIN_PERFORMANCE = SQL_BIN_PERFORMANCE.replace(O.details_ctes("a"), O.details_ctes("a", src="panel_dirty"))
SQL_DIRTY_METRICS = SQL_METRICS_INNER.replace(O.details_ctes("a"), O.details_ctes("a", src="panel_dirty"))


def q_sequence_scores_scaled(spark, sf):
    """Split-scaled features (discount min-max, others standard) on the dirty
    panel; the predictor averages the scaled lag_1 over the 52 prior rows."""
    ev = evaluate_sequence_history(dirty(panel(spark, sf)), fx.feature_spec(spark, "nn"), MeanOfFeature(LAG1),
                                   scaler=fx.scaler_table(spark, "nn", split=True),
                                   calibration=fx.calibration_table(fx.products(spark, sf)))
    return ev.details


SQL_SEQUENCE_SCORES_SCALED = (SQL_SEQUENCE_SCORES
                              .replace('from panel where KEY is not null', 'from panel_dirty where KEY is not null')
                              .replace("avg(lag_1) over", "avg((lag_1 - 8.0) / 4.0) over"))

CMPBIN_FLOATS = ["Actual_Sales", "Linear_Predicted", "Neural_Predicted", "Linear_Error", "Neural_Error",
                 "Linear_Pct_Error", "Neural_Pct_Error", "Linear_Win_Rate", "Neural_Win_Rate"]
HIST_FLOATS = ["bin_start", "bin_end"]

SPEC = {
    "discount_bin_performance": (q_bin_performance, SQL_BIN_PERFORMANCE, BINPERF_FLOATS),
    "panel": (q_panel, SQL_PANEL, []),
    "panel_profile": (q_panel_profile, SQL_PANEL_PROFILE, []),
    "duplicate_keys": (q_duplicates, SQL_DUPLICATES, []),
    "csv_roundtrip": (q_csv_roundtrip, SQL_CSV_ROUNDTRIP, []),
    "base_features": (q_base_features, _base_features_sql(), BASE_FLOATS),
    "leak_free_features": (q_leak_free_features, _base_features_sql(True), BASE_FLOATS),
    "nn_features": (q_nn_features, SQL_NN_FEATURES, NN_FLOATS),
    "discount_bins": (q_discount_bins, SQL_DISCOUNT_BINS, []),
    "standard_scaled": (q_standard_scaled, SQL_STANDARD_SCALED, BASE_FLOATS),
    "split_scaled": (q_split_scaled, SQL_SPLIT_SCALED, NN_FLOATS),
    "linear_details": (q_linear_details, SQL_LINEAR_DETAILS, DETAIL_FLOATS),
    "linear_details_uncalibrated": (q_linear_details_b, SQL_LINEAR_DETAILS_B, DETAIL_FLOATS),
    "linear_details_leak_free": (q_linear_details_leak_free, SQL_LINEAR_DETAILS_LEAK_FREE, DETAIL_FLOATS),
    "min_history_gate": (q_min_history_gate, SQL_MIN_HISTORY_GATE, DETAIL_FLOATS),
    "optional_columns": (q_optional_columns, SQL_OPTIONAL_COLUMNS, DETAIL_FLOATS),
    "skip_audit": (q_skip_audit, SQL_SKIP_AUDIT, []),
    "metrics_summary": (q_metrics_summary, SQL_METRICS_SUMMARY, METRIC_FLOATS),
    "metrics_long": (q_metrics_long, SQL_METRICS_LONG, ["value"]),
    "metrics_text": (q_metrics_text, "__METRICS_TEXT__", []),
    "bin_mae": (q_bin_mae, SQL_BIN_MAE, ["Absolute_Error"]),
    "bin_means": (q_bin_means, SQL_BIN_MEANS, ["Actual_Sales", "Predicted_Sales"]),
    "eoss_mae": (q_eoss_mae, SQL_EOSS_MAE, ["Absolute_Error"]),
    "product_summary": (q_product_summary, SQL_PRODUCT_SUMMARY, PRODUCT_FLOATS),
    "top_error_products": (q_top_error_products, SQL_TOP_ERROR_PRODUCTS,
                           ["Actual_Sales", "Predicted_Sales", "Percent_Error", "DISCOUNT"]),
    "top_volume_products": (q_top_volume_products, SQL_TOP_VOLUME_PRODUCTS, ["Actual_Sales", "Predicted_Sales"]),
    "top_volume_rows": (q_top_volume_rows, SQL_TOP_VOLUME_ROWS, DETAIL_FLOATS),
    "error_histogram": (q_error_histogram, SQL_ERROR_HISTOGRAM, HIST_FLOATS),
    "scatter_limit": (q_scatter_limit, SQL_SCATTER_LIMIT, ["max_val"]),
    "discount_loss": (q_discount_loss, SQL_DISCOUNT_LOSS, ["loss"]),
    "sequence_window": (q_sequence_window, SQL_SEQUENCE_WINDOW,
                        ["first_lag_1", "last_lag_1", "sum_rolling_mean_4"]),
    "sequence_gather": (q_sequence_gather, SQL_SEQUENCE_GATHER, ["discount_total"]),
    "sequence_scores": (q_sequence_scores, SQL_SEQUENCE_SCORES, DETAIL_FLOATS),
    "compare_details": (q_compare_details, SQL_COMPARE_DETAILS, CMP_FLOATS),
    "compare_summary": (q_compare_summary, SQL_COMPARE_SUMMARY,
                        ["linear_mae", "neural_mae", "linear_mape", "neural_mape", "linear_win_rate",
                         "neural_win_rate", "equal_rate"]),
    "compare_by_bin": (q_compare_by_bin, SQL_COMPARE_BY_BIN, CMPBIN_FLOATS),
    "compare_bin_error_long": (q_compare_bin_error_long, SQL_COMPARE_BIN_ERROR_LONG, ["Error"]),
    "compare_histogram": (q_compare_histogram, SQL_COMPARE_HISTOGRAM, HIST_FLOATS),
    "common_pairs": (q_common_pairs, SQL_COMMON_PAIRS, []),
    "compare_colocated": (q_compare_colocated, SQL_COMPARE_DETAILS, CMP_FLOATS),
    "product_summary_file": (q_product_summary_file, SQL_PRODUCT_SUMMARY, PRODUCT_FLOATS),
    "bin_performance_file": (q_bin_performance_file, SQL_BIN_PERFORMANCE, BINPERF_FLOATS),
    "comparison_file": (q_comparison_file, SQL_COMPARE_DETAILS, CMP_FLOATS),
    "comparison_bins_file": (q_comparison_bins_file, SQL_COMPARE_BY_BIN, CMPBIN_FLOATS),
    "compare_common_rows": (q_compare_common_rows, SQL_COMPARE_COMMON_ROWS, CMP_FLOATS),
    "restricted_rows": (q_restricted_rows, SQL_RESTRICTED_ROWS, ["Predicted_Sales", "Absolute_Error"]),
    "dirty_details": (q_dirty_details, SQL_DIRTY_DETAILS, DETAIL_FLOATS),
    "dirty_bin_performance": (q_dirty_bin_performance, SQL_DIRTY_BIN_PERFORMANCE, BINPERF_FLOATS),
    "dirty_metrics": (q_dirty_metrics, SQL_DIRTY_METRICS, METRIC_FLOATS),
    "sequence_scores_scaled": (q_sequence_scores_scaled, SQL_SEQUENCE_SCORES_SCALED, DETAIL_FLOATS),
}


def spark_query(name: str):
    fn, _, floats = SPEC[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rnd(fn(spark, sf_dir), floats, name)
    run.__name__ = f"q_{name}"
    return run


def oracle_query(name: str) -> str | None:
    _, sql, floats = SPEC[name]
    if sql is None:
        return None
    if sql == "__METRICS_TEXT__":
        return _metrics_text_sql()
    return O.rounded(sql, [(c, digits_of(c, name)) for c in floats])
