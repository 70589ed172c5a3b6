"""Correlations by transforms and sliding order statistics against direct computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotwise.operators.correlate import lag_moments, shifted_sums
from slotwise.operators.features import rolling_features
from slotwise.operators.order_stats import weighted_median_without
from slotwise.operators.order_windows import RankIndex


def test_shifted_sums_equal_direct_sums():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 130)), rng.normal(size=(3, 130))
    x[0, ::7], y[1, 5:40] = np.nan, np.nan
    place = np.delete(np.arange(-15, 115), [3, 60])
    x, y = x[:, place + 15], y[:, place + 15]
    for low, high in ((-15, 15), (1, 9), (-9, -2), (0, 0)):
        got = shifted_sums(x, y, place, 100, low, high)
        at = {p: i for i, p in enumerate(place.tolist())}
        for k, offset in enumerate(range(low, high + 1)):
            pairs = [(at[p], at[p + offset]) for p in place.tolist() if 0 <= p < 100 and p + offset in at]
            for i in range(2):
                for j in range(3):
                    both = [(x[i, a], y[j, b]) for a, b in pairs if np.isfinite(x[i, a]) and np.isfinite(y[j, b])]
                    a, b = np.array(both).T
                    want = [len(pairs), len(both), a.sum(), b.sum(), (a * a).sum(), (b * b).sum(), (a * b).sum()]
                    assert got[i, j, :, k] == pytest.approx(want, abs=1e-9)


def test_lag_moments_at_wide_reach(spark):
    rng = np.random.default_rng(4)
    n = 700
    t = 1e6 + np.cumsum(rng.normal(size=n))
    pdf = pd.DataFrame({"series_id": "p", "pos": np.arange(n), "t": t, "ahead": np.roll(t, -96) * 3 - 1, "flat": 5.0,
                        "rare": np.where(np.arange(n) % 90 == 0, t, np.nan)})
    pdf.loc[n - 96:, "ahead"] = np.nan
    wide = spark.createDataFrame(pdf.drop(index=[77, 300])).withColumn("rare", F.when(~F.isnan("rare"), F.col("rare"))).withColumn(
        "ahead", F.when(~F.isnan("ahead"), F.col("ahead")))
    got = {(r.field, r.offset): r for r in lag_moments(wide, ["ahead", "flat", "rare", "t"], ["t"], -96, 96, block=128).collect()}
    full = pdf.drop(index=[77, 300]).set_index("pos").reindex(range(n))
    for field in ("ahead", "t"):
        for k in (-96, -95, -1, 0, 1, 50, 96):
            both = pd.DataFrame({"x": full[field], "y": full["t"].shift(-k)}).dropna()
            r = got[field, k]
            assert r.pairs == len(both) and r.correlation == pytest.approx(both.x.corr(both.y), abs=1e-9)
            slope, intercept = np.polyfit(both.x - 1e6, both.y - 1e6, 1)
            assert r.coefficient == pytest.approx(slope, rel=1e-6)
            assert r.intercept == pytest.approx(intercept + 1e6 - slope * 1e6, rel=1e-5, abs=10.0)
    assert got["ahead", 96].correlation == pytest.approx(1.0) and got["ahead", 96].coefficient == pytest.approx(1 / 3)
    assert got["flat", 0].correlation is None and got["flat", 0].pairs == n - 2
    assert got["rare", 0].pairs == 8 and got["rare", 0].correlation is None  # fewer than the least number of pairs
    assert len(got) == 4 * 193


@pytest.mark.parametrize("kind", ["ties", "missing", "empty"])
def test_ranges_of_a_rank_index_equal_sorting(kind):
    rng = np.random.default_rng(6)
    values = rng.integers(0, 5, 300).astype(float) if kind == "ties" else rng.normal(size=300)
    if kind != "ties":
        values[rng.random(300) < (0.3 if kind == "missing" else 2)] = np.nan
    index = RankIndex(values)
    begin = rng.integers(0, 301, 200)
    end = np.maximum(begin, rng.integers(0, 301, 200))
    for share in (0.0, 0.1, 0.25, 0.5, 0.9, 1.0):
        got = index.percentile(begin, end, share)
        for g, b, e in zip(got, begin, end):
            held = values[b:e][np.isfinite(values[b:e])]
            assert np.isnan(g) if not len(held) else g == pytest.approx(np.quantile(held, share))


def test_long_windows_equal_pandas(spark, long_grid):
    rng = np.random.default_rng(7)
    x = np.where(rng.random(1500) < 0.1, np.nan, np.round(rng.normal(size=1500), 2))
    grid = long_grid({"a": x.tolist(), "b": [None] * 1500})
    out = rolling_features(grid, (96, 672), ("mean", "q10", "median", "q90"), block=200)
    assert out.columns[-8:] == [f"roll_{w}_{s}" for w in (96, 672) for s in ("mean", "q10", "median", "q90")]
    rows = out.where("field = 'a'").orderBy("pos").toPandas()
    for w in (96, 672):
        past = pd.Series(x).shift(1).rolling(w, min_periods=w // 2)
        for name, share in (("q10", 0.1), ("median", 0.5), ("q90", 0.9)):
            want = past.quantile(share).to_numpy()
            want[: w // 2] = [np.nan if np.isfinite(x[:i]).sum() < w // 2 else np.nanquantile(x[:i], share) for i in range(w // 2)]
            assert np.allclose(rows[f"roll_{w}_{name}"].to_numpy(float), want, equal_nan=True)
    assert out.where("field = 'b' and roll_96_median is not null").count() == 0


def test_medians_without_a_part_come_from_one_ranking(spark):
    rng = np.random.default_rng(8)
    rows = [("k" if i % 3 else "j", f"f{rng.integers(0, 4)}", float(rng.integers(0, 30)), float(rng.integers(1, 9))) for i in range(400)]
    rows += [("only", "f0", 1.0, 2.0), ("only", "f0", 5.0, 9.0), ("k", None, 1e9, 1e9), ("k", "f1", None, 3.0)]
    df = spark.createDataFrame(rows, "g string, fold string, x double, w double")
    parts = ["f0", "f1", "f2", "f3"]
    found = weighted_median_without(df, ["g"], "fold", parts, F.col("x"), F.col("w"), "middle")
    assert "Generate explode" not in found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1]  # one copy of the rows
    got = {(r.g, r.held): (r.samples, r.middle) for r in found.collect()}
    for g in ("k", "j", "only"):
        for held in parts:
            rest = sorted((x, w) for a, f, x, w in rows if a == g and f not in (held, None) and x is not None)
            total, run, middle = sum(w for _, w in rest), 0.0, None
            for x, w in rest:
                run += w
                if middle is None and run >= 0.5 * total:
                    middle = x
            assert got[g, held] == (len(rest), middle)
    assert weighted_median_without(df.limit(0), ["g"], "fold", [None], F.col("x"), F.col("w"), "middle").count() == 0
