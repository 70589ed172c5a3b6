"""Causal cleaning, features, states and balances against pandas and formulas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotwise.operators.balance import Roles, gas_features, use_per_load
from slotwise.operators.blocks import asof_last, carry_last, running_total, with_halo
from slotwise.operators.clean import CleanRule, OutlierRule, clean, constant_runs, drop_empty_fields, flag_outliers, missing_and_fill
from slotwise.operators.features import ewma, lag_features, rolling_features
from slotwise.operators.states import add_regime, add_states, regime_from_flags
from slotwise.plans.causality import moved_rows, require_causal, shifted_mean_gap
from slotwise.plans.contracts import ContractError


def gappy(n, seed=3, share=0.15, hole=(60, 120)):
    rng = np.random.default_rng(seed)
    x = 50 + np.cumsum(rng.normal(size=n))
    x[rng.random(n) < share] = np.nan
    x[hole[0]:hole[1]] = np.nan
    return x


def as_series(got, n, first=1000):
    return pd.Series([np.nan if got[first + i] is None else got[first + i] for i in range(n)], dtype=float)


@pytest.mark.parametrize("block", [16, 50, 4096])
def test_missing_run_and_fill_equal_pandas(long_grid, pick, block):
    x = gappy(200)
    x[:3] = np.nan
    s = pd.Series(x)
    out = missing_and_fill(long_grid({"x": x}), limit=8, block=block).cache()
    missing = s.isna()
    want_run = missing.astype(int).groupby((~missing).cumsum()).cumsum()
    assert [pick(out, "missing_run")[1000 + i] for i in range(200)] == list(want_run)
    pd.testing.assert_series_equal(as_series(pick(out, "filled"), 200), s.ffill(limit=8), check_names=False)
    unlimited = missing_and_fill(long_grid({"x": x}), block=block)
    pd.testing.assert_series_equal(as_series(pick(unlimited, "filled"), 200), s.ffill(), check_names=False)


def test_only_causal_fills(long_grid):
    with pytest.raises(ValueError):
        missing_and_fill(long_grid({"x": [1]}), method="bfill")
    out = missing_and_fill(long_grid({"x": [1, None]}), method="none").orderBy("pos").collect()
    assert out[1]["filled"] is None


@pytest.mark.parametrize("method", ["iqr", "hampel"])
@pytest.mark.parametrize("block", [40, 4096])
def test_outlier_flags_equal_pandas(long_grid, pick, method, block):
    x = gappy(260, hole=(100, 104))
    x[150] *= 4
    s = pd.Series(x)
    history = s.shift(1)
    roll = history.rolling(24, min_periods=12)
    median = roll.median()
    if method == "hampel":
        scale = 1.4826 * (history - median).abs().rolling(24, min_periods=12).median()
        mask = (scale > 0) & ((s < median - 3 * scale) | (s > median + 3 * scale))
    else:
        q1, q3 = roll.quantile(0.25), roll.quantile(0.75)
        mask = (q3 - q1 > 0) & ((s < q1 - 3 * (q3 - q1)) | (s > q3 + 3 * (q3 - q1)))
    out = flag_outliers(long_grid({"x": x}), OutlierRule(method, 24, 12, 3.0), block=block)
    got = pick(out, "outlier")
    assert [got[1000 + i] for i in range(260)] == list(mask.astype(int)) and got[1150] == 1
    want = s.where(~mask, median)
    pd.testing.assert_series_equal(as_series(pick(out, "robust"), 260), want, check_names=False)


def test_clean_keeps_raw_values_and_drops_empty_fields(long_grid, pick):
    x = [100 + np.sin(i) for i in range(80)]
    x[60] = 900.0
    x[30] = None
    out = clean(long_grid({"x": x, "void": [None] * 80}), CleanRule(OutlierRule("iqr", 24, 12, 3.0), limit=4))
    kept = drop_empty_fields(out)
    assert {r["field"] for r in kept.select("field").distinct().collect()} == {"x"}
    value, robust, flag = pick(kept, "value"), pick(kept, "robust"), pick(kept, "outlier")
    assert value[1060] == 900.0 and flag[1060] == 1 and robust[1060] < 200
    # a hole gets the filled value only after the flags are known
    assert value[1030] is None and robust[1030] == pytest.approx(x[29])


def test_disabled_rule_flags_nothing(long_grid):
    rows = flag_outliers(long_grid({"x": [1, 500, 2]}), OutlierRule(enabled=False)).collect()
    assert all(r["outlier"] == 0 and r["robust"] == r["value"] for r in rows)


@pytest.mark.parametrize("block", [64, 4096])
def test_rolling_statistics_equal_pandas(long_grid, pick, block):
    x = gappy(180, hole=(90, 96))
    s = pd.Series(x)
    names = ("mean", "std", "min", "max", "q10", "q90", "slope")
    out = rolling_features(long_grid({"x": x}), (4, 8), names, block=block).cache()
    shifted = s.shift(1)

    def slope(v):
        ok = np.isfinite(v)
        return np.polyfit(np.arange(len(v))[ok], v[ok], 1)[0] if ok.sum() > 1 else np.nan

    for w in (4, 8):
        r = shifted.rolling(w, min_periods=max(2, w // 2))
        want = {"mean": r.mean(), "std": r.std(ddof=0), "min": r.min(), "max": r.max(), "q10": r.quantile(0.1), "q90": r.quantile(0.9),
                "slope": r.apply(slope, raw=True)}
        for name in names:
            pd.testing.assert_series_equal(as_series(pick(out, f"roll_{w}_{name}"), 180), want[name], check_names=False, atol=1e-8)


def test_rolling_window_excludes_the_current_slot(long_grid, pick):
    out = rolling_features(long_grid({"production": [100 + i for i in range(40)]}), (4,), ("mean",))
    assert pick(out, "roll_4_mean")[1020] == pytest.approx(np.mean([116, 117, 118, 119]))
    lags = lag_features(long_grid({"x": [i * i for i in range(20)]}), (1, 4))
    assert pick(lags, "accel")[1010] == 2.0 and pick(lags, "diff_4")[1010] == 100 - 36 and pick(lags, "lag_4")[1003] is None


@pytest.mark.parametrize("block", [1, 37, 5000])
@pytest.mark.parametrize("span", [8, 1000, 10000])
def test_ewma_equals_pandas_over_long_gaps(long_grid, pick, block, span):
    x = gappy(1600, hole=(300, 1100))
    x[0] = np.nan
    want = pd.Series(x).ewm(span=span, adjust=False, min_periods=2).mean()
    got = as_series(pick(ewma(long_grid({"x": x}), span=span, block=block), "ewma"), 1600)
    pd.testing.assert_series_equal(got, want, check_names=False, rtol=1e-11)


def test_halo_blocks_return_every_row_once(long_grid):
    grid = long_grid({"x": range(500), "y": range(500)})
    plain = with_halo(grid, ["series_id", "field"], lambda r, w: r.withColumn("s", F.sum("value").over(w.rowsBetween(-30, 20))), 30, 20, block=100_000)
    cut = with_halo(grid, ["series_id", "field"], lambda r, w: r.withColumn("s", F.sum("value").over(w.rowsBetween(-30, 20))), 30, 20, block=37)
    assert cut.count() == 1000 and cut.exceptAll(plain).count() == 0


def test_running_total_and_asof(long_grid, spark):
    grid = long_grid({"x": [1, None, 3, 4]})
    totals = running_total(grid, ["series_id"], F.coalesce("value", F.lit(0.0)), "t", block=2).orderBy("pos").collect()
    assert [r["t"] for r in totals] == [1, 1, 4, 8]
    probes = spark.createDataFrame([("plant", 1001, "a"), ("plant", 1001, "b"), ("plant", 999, "c"), ("plant", 5000, "d")], "series_id string, pos long, tag string")
    got = {r["tag"]: r["v"] for r in asof_last(grid, probes, ["series_id"], "value", "v", block=2).collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": None, "d": 4.0}
    before = carry_last(grid, ["series_id"], F.col("value"), "prev", include_current=False, block=2).orderBy("pos").collect()
    assert [r["prev"] for r in before] == [None, 1.0, 1.0, 3.0]


def test_features_do_not_see_the_future(long_grid, spark):
    grid = long_grid({"x": gappy(200)})
    cut = spark.createDataFrame([("plant", 1130)], "series_id string, cut long")
    build = lambda g: rolling_features(clean(g, CleanRule(OutlierRule("iqr", 24, 12))), (8,), ("mean", "slope"), "robust").drop("value")
    require_causal(build, grid, cut)
    # a centred window is caught
    leaky = lambda g: with_halo(g, ["series_id", "field"], lambda r, w: r.withColumn("m", F.avg("value").over(w.rowsBetween(-2, 2))), 2, 2).drop("value")
    assert moved_rows(leaky, grid, cut).count() > 0
    with pytest.raises(ContractError):
        require_causal(leaky, grid, cut)
    assert shifted_mean_gap(rolling_features(grid, (8,), ("mean",)), grid, 8, "roll_8_mean").count() == 0


def test_states_and_regime_precedence(long_grid, pick):
    x = [0, 10, 10.5, 20, 5, 0.2, None, 30]
    out = add_states(long_grid({"x": x}), step_minutes=15).cache()
    assert [pick(out, "startup")[1000 + i] for i in range(8)] == [0, 1, 0, 0, 0, 0, 0, 1]
    assert [pick(out, "shutdown")[1000 + i] for i in range(8)] == [0, 0, 0, 0, 0, 1, 0, 0]
    assert [pick(out, "stable")[1000 + i] for i in range(8)] == [0, 0, 1, 0, 0, 0, 0, 0]
    assert pick(out, "ramp_rate")[1003] == pytest.approx(9.5 / 15)
    regimes = pick(add_regime(long_grid({"x": x})), "regime")
    assert [regimes[1000 + i] for i in range(8)] == ["stable", "startup", "stable", "ramp_up", "ramp_down", "shutdown", "stable", "startup"]
    assert pick(out.withColumn("regime", regime_from_flags()), "regime") == regimes


@pytest.fixture
def plant(spark):
    i = np.arange(160)
    pdf = pd.DataFrame({
        "series_id": "p", "pos": 1000 + i, "generator_1": 20.0 + i, "generator_all": 40.0 + 2 * i, "production": 100.0 + i,
        "demand": 70 + 0.5 * i, "process": 5 + 0.1 * i, "holder": 90000 + 100 * np.sin(i / 8), "use": 50000.0 + 80 * i})
    roles = Roles({"gas": ["production"]}, {"gas": ["demand"]}, {"gas": ["process"]}, {"gas": ["use"]}, {"gas": "holder"}, ("generator_1",))
    return pdf, spark.createDataFrame(pdf), roles


def test_gas_features_follow_their_formulas(plant, pick):
    pdf, wide, roles = plant
    out = gas_features(wide, roles, 15, capacity=200000.0, block=40).cache()
    at = lambda c, k=1020: pick(out, c)[k]
    p = pdf.set_index("pos")
    balance = p["production"] - p["demand"] - p["process"]
    assert at("feat_gas_balance_gas") == pytest.approx(balance[1019])
    assert at("feat_holder_change_rate_gas") == pytest.approx((p["holder"][1019] - p["holder"][1018]) / 15)
    assert at("feat_holder_change_rate_gas_4") == pytest.approx((p["holder"][1019] - p["holder"][1015]) / 60)
    assert at("feat_holder_level_fraction_gas") == pytest.approx(p["holder"][1019] / 200000)
    low, high = p["holder"][1019] / 200000 - 0.15, 0.9 - p["holder"][1019] / 200000
    assert at("feat_holder_safe_margin_gas") == pytest.approx(min(low, high))
    assert at("feat_gas_available_gas") == pytest.approx(balance[1019] - p["holder"].diff()[1019])
    assert at("feat_gas_balance_gas_8_mean") == pytest.approx(balance.shift(1).rolling(8, min_periods=4).mean()[1020])
    assert at("feat_gas_total_balance") == pytest.approx(balance[1019])
    with pytest.raises(ValueError):
        gas_features(wide, roles, capacity=-1.0)


def test_use_per_load_gap(plant, pick):
    pdf, wide, roles = plant
    out = use_per_load(wide, roles, (4,))
    p = pdf.set_index("pos")
    ratio = p["use"].shift(1) / p["generator_1"]
    want = ratio[1020] / ratio.loc[1016:1019].median() - 1
    assert pick(out, "feat_gas_load_gas_use_per_mw_generator_1_4_relative_gap")[1020] == pytest.approx(want)


def test_constant_runs(long_grid, pick):
    out = constant_runs(long_grid({"x": [5, 5, 5.01, 7, None, 7, 7]}), 0.05, block=3)
    assert [pick(out, "run")[1000 + i] for i in range(7)] == [0, 0, 0, 1, 1, 1, 1]
