"""DuckDB twins of the registered Spark queries (the correctness oracle).

Each builder returns one SQL statement over the raw tables ``lineitem`` and
``part``.  The SQL is written independently of the Spark code, straight
from the semantics: window frames, CASE ladders, explicit inf/NULL rules.
Floating columns are rounded to 6 decimals on both sides (see ``ROUND``).
"""

from __future__ import annotations


# Fixed values (same as demandlens.schema; restated so the oracle stands alone)
LAGS = (1, 2, 3, 4, 8, 12, 26, 52)
DLAGS = (1, 2, 4)
ROLL = (4, 8, 12)

PANEL = """
p AS (
  select concat(p_brand, '/', p_type) as KEY,
         cast(date_trunc('week', l_shipdate) as date) as DATE,
         sum(case when l_returnflag = 'N' then l_quantity else 0.0 end) as QUANTITY_SOLD,
         cast(sum(cast(round(l_discount * 100) as int)) % 11 as double) / 20 as DISCOUNT
  from lineitem join part on l_partkey = p_partkey
  group by 1, 2),
s AS (
  select *,
         cast(case when month(DATE) in (1, 7) then 1 else 0 end as double) as is_eoss,
         cast(case when month(DATE) = 12 then 1 else 0 end as double) as holiday_label,
         row_number() over (partition by KEY order by DATE desc) as rd
  from p),
panel AS (
  select KEY, DATE, QUANTITY_SOLD, DISCOUNT, is_eoss, holiday_label,
         case when rd <= 9 then 'test' else 'train' end as split
  from s),
panel_dirty AS (
  select KEY, DATE, QUANTITY_SOLD,
         case when day(DATE) = 1 then NULL when day(DATE) = 2 then 1.2 else DISCOUNT end as DISCOUNT,
         is_eoss, holiday_label, split
  from panel)"""


def ladder(x: str, edges, labels, quote=False) -> str:
    parts = []
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        v = f"'{lab}'" if quote else lab
        parts.append(f"when {x} > {lo!r} and {x} <= {hi!r} then {v}")
    return "case " + " ".join(parts) + " end"


DBIN = lambda x: ladder(x, (-0.001, 0.05, 0.15, 0.25, 0.35, 1.0), [f"cast({i} as double)" for i in range(5)])
FBIN = lambda x: ladder(x, (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.75, 1.0), [f"cast({i} as double)" for i in range(10)])
RBIN_LABELS = ("0-5%", "5-10%", "10-15%", "15-20%", "20-30%", "30-40%", "40%+")
RBIN_EDGES = (-0.001, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 1.0)
RBIN = lambda x: ladder(x, RBIN_EDGES, RBIN_LABELS, quote=True)
RORD = lambda x: ladder(x, RBIN_EDGES, [str(i) for i in range(7)])
CBIN = lambda x: (f"case when {x} <= 0.1 then '0-10%' when {x} <= 0.2 then '10-20%' "
                  f"when {x} <= 0.3 then '20-30%' when {x} <= 0.4 then '30-40%' else '40%+' end")
BINS_TABLE = ("bins AS (select cast(i as integer) as bin_ordinal, lab as Discount_Bin from (values "
              + ", ".join(f"({i}, '{lab}')" for i, lab in enumerate(RBIN_LABELS)) + ") t(i, lab))")
TWO_PI = "(2 * pi())"

BASE_FEATURES = (["month", "year", "quarter", "day_of_week", "day_of_year", "week_of_year",
                  "month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos", "week_sin", "week_cos",
                  "DISCOUNT", "DISCOUNT_SQUARED", "DISCOUNT_BIN", "DISCOUNT_EOSS", "is_eoss"]
                 + [f"lag_{k}" for k in LAGS] + [f"rolling_mean_{w}" for w in ROLL]
                 + ["trend", "trend_diff", "seasonal_indicator", "promo_depth"])
NN_FEATURES = (["month", "quarter", "day_of_week", "week_of_year",
                "month_sin", "month_cos", "day_of_week_sin", "day_of_week_cos", "week_sin", "week_cos",
                "DISCOUNT", "DISCOUNT_MONTH", "DISCOUNT_HOLIDAY", "DISCOUNT_EOSS",
                "discount_tier_high", "discount_tier_med", "discount_tier_low",
                "EOSS_HIGH_DISCOUNT", "EOSS_MED_DISCOUNT", "EOSS_LOW_DISCOUNT",
                "DISCOUNT_SQUARED", "DISCOUNT_CUBE", "DISCOUNT_SQRT", "DISCOUNT_LOG", "DISCOUNT_EXP",
                "DISCOUNT_BIN", "DISCOUNT_FINE_BIN", "is_eoss", "holiday_label"]
               + [f"lag_{k}" for k in LAGS] + [f"discount_lag_{k}" for k in DLAGS]
               + ["discount_change", "discount_acceleration", "days_since_discount_change",
                  "DISCOUNT_PREV_SALES"]
               + [f"rolling_mean_{w}" for w in ROLL] + ["trend", "trend_diff", "seasonal_indicator",
                                                         "promo_depth"])
W = "partition by KEY order by DATE"


def cyc(name, x, period):
    return (f"sin({TWO_PI} * {x} / {period}.0) as {name}_sin, "
            f"cos({TWO_PI} * {x} / {period}.0) as {name}_cos")


def window_cols(q="QUANTITY_SOLD", leak_free=False):
    cols = [f"row_number() over ({W}) as rn", "count(*) over (partition by KEY) as n",
            "count(case when split = 'train' then 1 end) over (partition by KEY) as n_train"]
    cols += [f"coalesce(lag({q}, {k}) over ({W}), 0.0) as lag_{k}" for k in LAGS]
    for w in ROLL:
        frame = f"rows between {w} preceding and 1 preceding" if leak_free else f"rows between {w - 1} preceding and current row"
        cols.append(f"coalesce(avg({q}) over ({W} {frame}), 0.0) as rolling_mean_{w}")
    if leak_free:
        cols.append(f"lag({q}, 1) over ({W}) - lag({q}, 2) over ({W}) as dq")
    else:
        cols.append(f"{q} - lag({q}, 1) over ({W}) as dq")
    return cols


TREND = ("case when n > 1 then (rn - 1) / n else 0.5 end as trend, "
         "case when n > 1 then coalesce(dq, 0.0) else 0.0 end as trend_diff, "
         "case when n > 1 then (case when month in (12, 1, 6, 7) then 1.0 else 0.0 end) else 0.0 end "
         "as seasonal_indicator")


def base_feature_ctes(src: str, keys_filter: str = "true", leak_free=False, sfx: str = "") -> str:
    """CTE chain ending in ``bf{sfx}`` (base profile, unclean)."""
    return f"""
b1{sfx} AS (
  select KEY, DATE, QUANTITY_SOLD, DISCOUNT, DISCOUNT as DISCOUNT_RAW, is_eoss, holiday_label, split,
         month(DATE) as month, year(DATE) as year, quarter(DATE) as quarter,
         isodow(DATE) - 1 as day_of_week, dayofyear(DATE) as day_of_year, weekofyear(DATE) as week_of_year
  from {src} where KEY is not null and ({keys_filter})),
b2{sfx} AS (
  select *, {cyc('month', 'month', 12)}, {cyc('day_of_week', 'day_of_week', 7)}, {cyc('week', 'week_of_year', 52)},
         DISCOUNT * DISCOUNT as DISCOUNT_SQUARED, {DBIN('DISCOUNT')} as DISCOUNT_BIN,
         DISCOUNT * is_eoss as DISCOUNT_EOSS
  from b1{sfx}),
b3{sfx} AS (select *, {', '.join(window_cols(leak_free=leak_free))} from b2{sfx}),
bf{sfx} AS (select *, {TREND} from b3{sfx})"""


def clean(c: str) -> str:
    return f"coalesce(case when isnan({c}) or isinf({c}) then NULL else cast({c} as double) end, 0.0)"


def cleaned(features, have) -> str:
    return ", ".join(f"{clean(f)} as {f}" if f in have else f"0.0 as {f}" for f in features)


BASE_HAVE = set(BASE_FEATURES) - {"promo_depth"}
NN_HAVE = set(NN_FEATURES) - {"promo_depth"}


def nn_feature_ctes(src: str, keys_filter: str = "true") -> str:
    """CTE chain ending in ``nf`` (nn profile, unclean)."""
    lagd = ", ".join(f"coalesce(lag(DC, {k}) over ({W}), 0.0) as discount_lag_{k}" for k in DLAGS)
    return f"""
n1 AS (
  select KEY, DATE, QUANTITY_SOLD, DISCOUNT as DISCOUNT_RAW, is_eoss, holiday_label, split,
         cast(month(DATE) as double) as month, cast(quarter(DATE) as double) as quarter,
         cast(isodow(DATE) - 1 as double) as day_of_week, cast(weekofyear(DATE) as double) as week_of_year
  from {src} where KEY is not null and ({keys_filter})),
n2 AS (
  select *, {cyc('month', 'month', 12)}, {cyc('day_of_week', 'day_of_week', 7)}, {cyc('week', 'week_of_year', 52)},
         least(greatest(coalesce(case when isnan(DISCOUNT_RAW) or isinf(DISCOUNT_RAW) then NULL else DISCOUNT_RAW end, 0.0), 0.0), 1.0) as DC
  from n1),
n3 AS (
  select *, DISCOUNT_RAW * month_sin as DISCOUNT_MONTH, DISCOUNT_RAW * holiday_label as DISCOUNT_HOLIDAY,
         DISCOUNT_RAW * is_eoss as DISCOUNT_EOSS,
         coalesce(cast(DISCOUNT_RAW >= 0.4 as double), 0.0) as discount_tier_high,
         coalesce(cast(DISCOUNT_RAW >= 0.2 and DISCOUNT_RAW < 0.4 as double), 0.0) as discount_tier_med,
         coalesce(cast(DISCOUNT_RAW < 0.2 as double), 0.0) as discount_tier_low,
         DC as DISCOUNT, DC * DC as DISCOUNT_SQUARED, pow(DC, 3.0) as DISCOUNT_CUBE, sqrt(DC) as DISCOUNT_SQRT,
         ln(1 + DC * 10.0) as DISCOUNT_LOG, exp(least(greatest(DC, 0.0), 0.3)) - 1.0 as DISCOUNT_EXP,
         {DBIN('DC')} as DISCOUNT_BIN, {FBIN('DC')} as DISCOUNT_FINE_BIN
  from n2),
n4 AS (
  select *, is_eoss * discount_tier_high as EOSS_HIGH_DISCOUNT, is_eoss * discount_tier_med as EOSS_MED_DISCOUNT,
         is_eoss * discount_tier_low as EOSS_LOW_DISCOUNT,
         {', '.join(window_cols())}, {lagd},
         DC - lag(DC, 1) over ({W}) as chg,
         (DC - lag(DC, 1) over ({W})) - (lag(DC, 1) over ({W}) - lag(DC, 2) over ({W})) as acc
  from n3),
nf AS (
  select *, {TREND},
         coalesce(chg, 0.0) as discount_change, coalesce(acc, 0.0) as discount_acceleration,
         cast(rn - coalesce(max(case when abs(chg) >= 0.05 then rn end)
              over ({W} rows between unbounded preceding and current row), 0) as double) as days_since_discount_change,
         DC * lag_1 / (avg(lag_1) over (partition by KEY) + 1e-5) as DISCOUNT_PREV_SALES
  from n4)"""


MODELS = {"a": "0.0 + (0.5 * lag_1 + 0.5 * rolling_mean_4)", "b": "0.25 + rolling_mean_12"}
NOT_STANDARD = "KEY not like '%/STANDARD'"
PTYPE = "split_part(KEY, '/', 2)"


def calibration_case(prefix=""):
    t, e, b = PTYPE, "is_eoss", "cal_bin"
    rules = [(f"{t} = 'PROMO' and {e} = 1.0 and {b} = '40%+'", "0.8", "product_eoss"),
             (f"{t} = 'PROMO' and {e} = 0.0 and {b} = '0-10%'", "1.1", "product_eoss"),
             (f"{t} in ('PROMO', 'LARGE') and {b} = '10-20%'", "0.9", "product_discount"),
             (f"{t} in ('LARGE', 'MEDIUM')", "1.05", "product"),
             (f"{b} = '20-30%'", "0.95", "discount_bin"),
             (f"{b} = '40%+'", "0.9", "discount_bin")]
    f = "case " + " ".join(f"when {c} then {v}" for c, v, _ in rules) + " else 1.0 end"
    lv = "case " + " ".join(f"when {c} then '{l}'" for c, _, l in rules) + " else 'none' end"
    return f, lv


def details_ctes(model: str, *, calibrated=True, min_history=5, src="panel", drop_type=None,
                 leak_free=False, sfx: str = "") -> str:
    """CTE chain ending in ``details{sfx}`` for the linear evaluation."""
    f, lv = calibration_case()
    factor = f if calibrated else "1.0"
    level = lv if calibrated else "'none'"
    keep = f" and {PTYPE} <> '{drop_type}'" if drop_type else ""
    return base_feature_ctes(src, NOT_STANDARD, leak_free, sfx) + f""",
scored{sfx} AS (
  select KEY, DATE, QUANTITY_SOLD as Actual_Sales, DISCOUNT_RAW as DISCOUNT, is_eoss,
         {MODELS[model].replace('lag_1', clean('lag_1')).replace('rolling_mean_4', clean('rolling_mean_4')).replace('rolling_mean_12', clean('rolling_mean_12'))} as Raw_Prediction,
         {CBIN('DISCOUNT_RAW')} as cal_bin
  from bf{sfx} where split = 'test' and n_train >= {min_history} and DATE is not null{keep}),
cal{sfx} AS (select *, {factor} as calibration_factor, {level} as calibration_level from scored{sfx}),
pred{sfx} AS (select *, case when Raw_Prediction * calibration_factor > 0 then Raw_Prediction * calibration_factor else 0.0 end as Predicted_Sales from cal{sfx}),
err{sfx} AS (select *, abs(Predicted_Sales - Actual_Sales) as Absolute_Error from pred{sfx}),
details{sfx} AS (
  select KEY, DATE, Actual_Sales, Predicted_Sales, Raw_Prediction, Absolute_Error,
         Absolute_Error / (Actual_Sales + 1e-5) * 100 as Percent_Error, DISCOUNT, is_eoss,
         {RBIN('DISCOUNT')} as Discount_Bin, calibration_level
  from err{sfx})"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {PANEL},{ctes}\n{select}"


def stable_round(x: str, d: int) -> str:
    """Same two-step half-up rounding as the Spark side, operation for operation."""
    x = f"cast({x} as double)"
    cases = "".join(f"when abs({x} * 1e{k + 3}) < 9e15 then floor(floor({x} * 1e{k + 3} + 0.5e0) / 1e3 + 0.5e0) / 1e{k} "
                    for k in range(d, -1, -3))
    return f"case when isnan({x}) then {x} {cases}else {x} end"


def rounded(sql: str, cols) -> str:
    """Round (column, digits) pairs of a statement's result."""
    if not cols:
        return sql
    rep = ", ".join(f"{stable_round(c, d)} as {c}" for c, d in cols)
    return f"select * replace ({rep}) from ({sql}) q"


def inf_ratio(num: str, den: str) -> str:
    return (f"case when {den} <> 0 then {num} / {den} * 100 when {num} > 0 then 'inf'::double "
            f"when {num} < 0 then '-inf'::double end")
