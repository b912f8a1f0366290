"""Our own short pandas version of lags, rolling means, trend and the change
counter on a random panel, against the Spark window features."""

import numpy as np
import pandas as pd

from demandlens.operators.features import build_features


def pandas_twin(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, g in pdf.sort_values(["KEY", "DATE"]).groupby("KEY", sort=False):
        g = g.copy()
        q = g["QUANTITY_SOLD"]
        for k in (1, 2, 4, 52):
            g[f"lag_{k}"] = q.shift(k).fillna(0.0)
        for w in (4, 12):
            g[f"rolling_mean_{w}"] = q.rolling(w, min_periods=1).mean().fillna(0.0)
        n = len(g)
        g["trend"] = np.arange(n) / n if n > 1 else 0.5
        g["trend_diff"] = q.diff().fillna(0.0) if n > 1 else 0.0
        dc = g["DISCOUNT"].fillna(0.0).clip(0, 1)
        chg = dc.diff()
        # rows since the last change point; the row before the first one stands for it
        at = np.arange(n)
        g["days_since_discount_change"] = at - np.maximum.accumulate(np.where(chg.abs() >= 0.05, at, -1))
        g["discount_acceleration"] = chg.diff().fillna(0.0)
        lag1 = g["lag_1"]
        g["DISCOUNT_PREV_SALES"] = dc * lag1 / (lag1.mean() + 1e-5)
        out.append(g)
    return pd.concat(out)


COLS = ["lag_1", "lag_2", "lag_4", "lag_52", "rolling_mean_4", "rolling_mean_12", "trend", "trend_diff",
        "days_since_discount_change", "discount_acceleration", "DISCOUNT_PREV_SALES"]


def test_window_features_match_pandas(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(12):
        n = int(rng.integers(1, 80))
        dates = pd.date_range("2020-01-06", periods=n, freq="7D")
        for d in dates:
            q = float(rng.integers(0, 30)) if rng.random() > 0.1 else None
            disc = float(rng.choice([0.0, 0.05, 0.1, 0.15, 0.2, 0.4])) if rng.random() > 0.05 else None
            rows.append((f"k{k}", d.date(), q, disc, 0.0, 0.0))
    pdf = pd.DataFrame(rows, columns=["KEY", "DATE", "QUANTITY_SOLD", "DISCOUNT", "is_eoss", "holiday_label"])
    sdf = spark.createDataFrame(rows, "KEY string, DATE date, QUANTITY_SOLD double, DISCOUNT double, "
                                      "is_eoss double, holiday_label double")
    got = build_features(sdf, "nn").select("KEY", "DATE", *COLS).toPandas().sort_values(["KEY", "DATE"])
    want = pandas_twin(pdf)[["KEY", "DATE"] + COLS].sort_values(["KEY", "DATE"])
    for c in COLS:
        g = got[c].astype(float).to_numpy()
        w = want[c].astype(float).to_numpy()
        assert np.allclose(np.nan_to_num(g, nan=-7.0), np.nan_to_num(w, nan=-7.0), atol=1e-9), c


def test_sequences_match_history_slices(spark):
    """Each test row's sequence equals the last ``steps`` rows strictly before
    its date (pandas slicing), for every product that passes the gates."""
    import registered
    from demandlens.plans.sequence import sequence_inputs
    from demandlens.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    steps = 4
    p = registered.panel(spark, SF_SMALL)
    train, test = fx.train_test(p)
    spec = fx.feature_spec(spark, "nn")
    gated, _ = sequence_inputs(train, test, spec, seq_len=steps)
    got = {(r["KEY"], r["DATE"]): [list(v) for v in r["sequence"]] for r in gated.collect()}
    cols = fx.profile_features("nn")
    from demandlens.operators.features import assemble
    feats = assemble(build_features(p, "nn"), cols, keep=["KEY", "DATE", "split", "_n_train"]).toPandas()
    want = {}
    for key, g in feats.sort_values("DATE").groupby("KEY"):
        for _, row in g[g["split"] == "test"].iterrows():
            hist = g[g["DATE"] < row["DATE"]]
            if row["_n_train"] >= steps and len(hist) >= steps:
                want[(key, row["DATE"])] = hist.iloc[-steps:][cols].to_numpy().tolist()
    assert set(got) == set(want) and len(got) > 0
    for k in want:
        assert np.allclose(np.array(got[k]), np.array(want[k]), atol=1e-12)
