"""Forecasts, folds, metrics, gates, fusion, calibration against direct computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotwise.plans.causality import require_causal_forecast
from slotwise.plans.contracts import ContractError, check_request, forecast_frame_rules, plan_frame_rules
from slotwise.plans.forecast import Model, forecast, model, pivot_forecast, unpivot_forecast, weighted_blend
from slotwise.plans.fusion import apply_weights, calibrate, cross_fit_calibration, fuse, gram, hard_winner, hour_factors, oof_weights, simplex_fit, used_models
from slotwise.plans.gates import candidate_gate, column_gate, residual_gate
from slotwise.plans.metrics import largest_errors, score, summarize
from slotwise.plans.postprocess import adjustment_counts, apply_limits
from slotwise.plans.selection import fold_coverage, fold_subset, join_candidates
from slotwise.plans.splits import MonthStart, Recent, Rolling, add_folds, fold_table, split_integrity, splitter
from slotwise.plans.validate import rolling_validation
from slotwise.functions.names import forecast_columns, split_forecast_column
from slotwise.sources.tables import tag_source

MODELS = [
    Model("last", "last_value"), Model("mean", "window_mean", window=4), Model("median", "window_median", window=5),
    Model("trend", "linear_trend", window=6), Model("damped", "damped_trend", window=5, damping=0.85),
    Model("flat_damp", "damped_trend", window=5, damping=1.0), Model("day", "seasonal_naive", period=24),
    Model("days", "seasonal_median", period=24, seasons=3),
    model({"name": "mix", "type": "weighted_ensemble", "clip_min": 0.0, "members": [
        {"name": "last", "type": "last_value", "weight": 3}, {"name": "day", "type": "seasonal_naive", "period_steps": 24, "weight": 1}]}),
]


def direct(s, origin, h):
    """The definitions, one origin at a time."""
    hist = s.loc[:origin].dropna()
    if hist.empty:
        return None
    last = hist.iloc[-1]
    out = {"last": last, "mean": hist.iloc[-4:].mean(), "median": hist.iloc[-5:].median()}
    for name, w in (("trend", 6), ("damped", 5), ("flat_damp", 5)):
        v = hist.iloc[-w:].to_numpy()
        if len(v) < 2:
            out[name] = v[-1]
            continue
        b, a = np.polyfit(np.arange(len(v)), v, 1)
        out[name] = {"trend": a + b * (len(v) - 1 + h), "damped": last + b * (1 - 0.85**h) / 0.15, "flat_damp": last + b * h}[name]
    back = s.get(origin + h - 24, np.nan) if origin + h - 24 <= origin else np.nan
    out["day"] = last if pd.isna(back) else back
    seasons = [s.get(origin + h - 24 * k, np.nan) for k in (1, 2, 3) if origin + h - 24 * k <= origin]
    seasons = [v for v in seasons if not pd.isna(v)]
    out["days"] = np.median(seasons) if seasons else last
    out["mix"] = max(0.75 * last + 0.25 * out["day"], 0)
    return out


@pytest.mark.parametrize("block", [80, 8192])
def test_baselines_equal_their_definitions(long_grid, block):
    rng = np.random.default_rng(1)
    x = 50 + 10 * np.sin(np.arange(200) / 4) + rng.normal(size=200)
    x[rng.random(200) < 0.2] = np.nan
    x[:2] = np.nan
    x[100:140] = np.nan
    s = pd.Series(x, index=range(1000, 1200))
    got = forecast(long_grid({"x": x}), MODELS, (1, 8, 30), block=block).toPandas().set_index(["pos", "horizon"])
    assert len(got) == 3 * (200 - s.first_valid_index() + 1000)
    for (pos, h), row in got.iterrows():
        want = direct(s, pos, h)
        for name, v in want.items():
            assert row[name] == pytest.approx(v, rel=1e-9, abs=1e-9), (pos, h, name)


def test_constant_and_ramp(long_grid):
    grid = long_grid({"flat": [50] * 40, "ramp": [20 + i for i in range(40)]}).withColumn("label", F.col("value"))
    tidy = forecast(grid, [MODELS[0], MODELS[3]], (1, 4), label="label").where("y_true is not null and pos >= 1010")
    m = {(r["field"]): r for r in tidy.groupBy("field").agg(
        F.max(F.abs(F.col("last") - F.col("y_true"))).alias("l"), F.max(F.abs(F.col("trend") - F.col("y_true"))).alias("t")).collect()}
    assert m["flat"]["l"] == 0 and m["ramp"]["t"] < 1e-9


def test_forecasts_do_not_see_the_future(long_grid, spark):
    grid = long_grid({"x": np.sin(np.arange(120))})
    cut = spark.createDataFrame([("plant", 1080)], "series_id string, cut long")
    require_causal_forecast(lambda g: forecast(g, MODELS, (1, 8)), grid, cut)


def test_specs_and_requests_are_checked(long_grid, spark):
    for bad in ({"type": "magic"}, {"type": "linear_trend", "window": 1}, {"type": "weighted_ensemble"}, {"type": "seasonal_naive", "period_steps": 0}):
        with pytest.raises(ValueError):
            model(bad)
    grid = long_grid({"x": [1, 2], "void": [None, None]})
    here = grid.select("series_id", "pos").distinct()
    check_request(grid, here, ["x"], [1])
    for origins, targets, horizons in ((here, ["void"], [1]), (here, ["x"], [0]), (spark.createDataFrame([("plant", 7)], "series_id string, pos long"), ["x"], [1])):
        with pytest.raises(ContractError):
            check_request(grid, origins, targets, horizons)


def test_splitters(long_grid):
    grid = long_grid({"x": range(400)})
    rows = fold_table(grid, Rolling(2, 200, 20, 40), 8).orderBy("fold").collect()
    assert [(r["train_start"], r["train_end"], r["valid_start"], r["valid_end"]) for r in rows] == [(1000, 1199, 1200, 1219), (1000, 1239, 1240, 1259)]
    rolling = fold_table(grid, splitter({"kind": "rolling", "folds": 2, "initial": 200, "validation": 20, "step": 40, "train": 100}), 8).orderBy("fold").collect()
    assert [r["train_start"] for r in rolling] == [1100, 1140]
    recent = fold_table(grid, Recent(2, 50, 50), 8).orderBy("fold").collect()
    assert [(r["valid_start"], r["valid_end"]) for r in recent] == [(1292, 1341), (1342, 1391)]
    with pytest.raises(Exception, match="too short"):
        fold_table(grid, Rolling(9, 200, 20, 40), 8).collect()
    with pytest.raises(Exception, match="too short"):
        fold_table(grid, MonthStart(["2030-01"], 4), 2).collect()
    overlap = split_integrity(fold_table(grid, Rolling(2, 200, 50, 40), 8)).first()
    assert (overlap["overlapping_origins"], overlap["status"]) == (10, "failed")
    doubled = add_folds(grid, Rolling(2, 200, 50, 40), fold_table(grid, Rolling(2, 200, 50, 40), 8))
    assert doubled.count() == 100


def test_validation_uses_raw_labels_and_refuses_scoring(long_grid):
    x = [100.0] * 260
    grid = long_grid({"x": x}).withColumn("label", F.when(F.col("pos") == 1225, 50.0).otherwise(F.col("value")))
    tidy = rolling_validation(grid, [MODELS[0]], Rolling(1, 200, 40, 40), (1, 2))
    hit = tidy.where("target_pos = 1225").collect()
    assert len(hit) == 2 and all(r["y_true"] == 50 and r["last"] == 100 for r in hit)
    with pytest.raises(Exception, match="scoring rows"):
        rolling_validation(tag_source(grid, "scoring"), [MODELS[0]], Rolling(1, 200, 40, 40), (1,)).collect()


def test_metrics_keep_infinity(spark):
    tidy = spark.createDataFrame([("a", 1, 0.0, 1.0), ("a", 1, 2.0, 1.0), ("b", 2, 4.0, 5.0), ("b", 1, None, 5.0)], "field string, horizon int, y_true double, y_pred double")
    rows = {(r["scope"], r["field"], r["horizon_steps"]): r for r in summarize(tidy).collect()}
    assert rows["target", "a", -1]["mape"] == float("inf") and rows["target", "a", -1]["zero_count"] == 1
    assert rows["overall", "__all__", -1]["excluded_non_finite_pairs"] == 1 and rows["overall", "__all__", -1]["sample_count"] == 3
    assert ("target_horizon", "b", 1) not in rows and rows["target_horizon", "b", 2]["horizon_minutes"] == 30
    undefined = spark.createDataFrame([(0.0, 0.0), (2.0, 1.0), (0.0, 3.0)], "y_true double, y_pred double")
    assert [r["absolute_error"] for r in largest_errors(undefined, 3).collect()] == [3.0, 1.0, 0.0]


def test_score_weights(spark):
    tidy = spark.createDataFrame([("a", 1, 100.0, 99.0), ("b", 1, 200.0, 198.0)], "field string, horizon int, y_true double, y_pred double")
    assert score(tidy).first()["final_score"] == pytest.approx(0.99)
    assert score(tidy, percent=True).first()["final_score"] == pytest.approx(99.0)
    with pytest.raises(ValueError):
        score(tidy, mix=(0.5, 0.5))


def fold_rows(spark, candidate):
    rows = [(f, "a", 1, f * 10 + i, 100.0, 110.0, candidate(f)) for f in range(8) for i in range(4)]
    return spark.createDataFrame(rows, "fold int, field string, horizon int, pos int, y_true double, last_value double, c double")


def test_column_gate(spark):
    wide = fold_rows(spark, lambda f: 106.0 if f < 6 else 111.0)
    r = column_gate(wide, ["c"], maximum_worst_degradation=0.02).first()
    assert r["passed"] and r["non_degraded_folds"] == 6
    # the mean gain must exceed its minimum, equal is not enough
    same = column_gate(fold_rows(spark, lambda f: 110.0), ["c"]).first()
    assert same["reasons"] == ["mean not improved"]
    # more folds are asked for than there are
    few = column_gate(wide.where("fold < 2"), ["c"], minimum_non_degraded_folds=5).first()
    assert few["passed"]


def test_candidate_gate_by_window(spark):
    rows = spark.createDataFrame([("recent_0", "a", 1, 100.0, 90.0, 95.0), ("cross_month_0", "a", 1, 100.0, 95.0, 85.0)],
                                 "fold string, field string, horizon int, y_true double, b double, c double")
    out = {r["w"]: r for r in candidate_gate(
        rows.withColumn("w", F.split("fold", "_")[0]).withColumnRenamed("b", "y_pred"),
        rows.withColumn("w", F.split("fold", "_")[0]).withColumnRenamed("c", "y_pred"), by=["w"]).collect()}
    assert out["recent"]["passed"] and not out["cross"]["passed"] and "a target degraded" in out["cross"]["reasons"]
    gains = spark.createDataFrame([(0.1,), (0.2,), (-0.1,)], "gain double")
    assert not residual_gate(gains).first()["allowed"] and residual_gate(gains, require_all=False).first()["allowed"]


def test_simplex_fit_equals_a_fine_search():
    rng = np.random.default_rng(5)
    p, y = rng.normal(size=(60, 3)) + 5, rng.normal(size=60) + 5
    w = simplex_fit(p.T @ p, p.T @ y, np.ones(3, bool))
    grid = [(a, b, 1 - a - b) for a in np.linspace(0, 1, 201) for b in np.linspace(0, 1 - a, 201)]
    best = min(((p @ np.array(g) - y) ** 2).sum() for g in grid)
    assert w.min() >= 0 and w.sum() == pytest.approx(1) and ((p @ w - y) ** 2).sum() <= best + 1e-9
    assert simplex_fit(p.T @ p, p.T @ y, np.array([True, False, False])).tolist() == [1.0, 0.0, 0.0]


@pytest.fixture
def oof(spark):
    rng = np.random.default_rng(0)
    rows = []
    for f in ["recent_0", "recent_1", "cross_month_0", "cross_month_1"]:
        for i in range(40):
            y = 100 + rng.normal()
            rows.append((f, "a", 1, i, "up" if i % 2 else "down", y, y + 10, y + (0.5 if i % 2 else 8), y + (0.5 if i % 2 == 0 else 8)))
    return spark.createDataFrame(rows, "fold string, field string, horizon int, pos int, regime string, y_true double, last_value double, m1 double, m2 double")


def test_leave_one_fold_weights_equal_a_refit(oof):
    models = ["last_value", "m1", "m2"]
    out = {r["held"]: r["weights"] for r in oof_weights(gram(oof, models), models).collect()}
    pdf = oof.toPandas()
    for held in [None, *sorted(pdf["fold"].unique())]:
        t = pdf if held is None else pdf[pdf["fold"] != held]
        d = np.maximum(t["y_true"].abs(), 1e-6).to_numpy()[:, None]
        p, y = t[models].to_numpy() / d, (t["y_true"].to_numpy() / d[:, 0])
        assert np.allclose(out[held], simplex_fit(p.T @ p, p.T @ y, np.ones(3, bool)), atol=1e-7)


def test_regimes_and_winners_use_other_folds_only(oof):
    models = ["last_value", "m1", "m2"]
    w = oof_weights(gram(oof, models, ("field", "horizon", "fold", "regime")), models, regime="regime", minimum_samples=10, shrinkage=1.0)
    up = [r for r in w.collect() if r["regime"] == "up" and r["held"] is None][0]
    assert up["weights"][1] > 0.9 and up["samples"] == 80
    blended = apply_weights(oof, w, models, "b", regime="regime")
    assert blended.agg(F.max(F.abs(F.col("b") - F.col("y_true")))).first()[0] < 1.5
    # changing the labels of a held fold must not change its winner
    spoiled = oof.withColumn("y_true", F.when(F.col("fold") == "recent_0", F.col("y_true") * 50).otherwise(F.col("y_true")))
    pick = lambda df: [(r["winner"], r["selection_mape"]) for r in hard_winner(df, models).where("held = 'recent_0'").collect()]
    assert pick(oof) == pick(spoiled)


def test_fuse_falls_back_to_the_baseline(oof):
    rows, summary = fuse(oof, ["last_value", "m1", "m2"], regime="regime", minimum_folds=4, minimum_samples=10, shrinkage=1.0)
    assert summary.first()["source"] in ("regime_blend", "blend", "hard_router")
    assert used_models(summary, ["last_value", "m1", "m2"]).first()["accepted_columns"] == 1
    worse = oof.withColumns({"m1": F.col("last_value") + 5, "m2": F.col("last_value") + 9})
    rows, summary = fuse(worse, ["last_value", "m1", "m2"], minimum_folds=4)
    assert summary.first()["source"] == "last_value" and rows.where("fused <> last_value").count() == 0


def test_hour_calibration_recovers_its_factor(spark):
    rows = [(f, "a", 4, pd.Timestamp(2025, 1, 1 + f, 2 * i), 105.0, 100.0) for f in range(6) for i in range(12)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["fold", "field", "horizon", "target_ts", "y_true", "y_pred"]))
    factors = hour_factors(df, minimum_samples=4, shrinkage=0.0)
    assert {round(r["factor"], 9) for r in factors.collect()} == {1.05} and factors.count() == 6
    assert calibrate(df, factors).agg(F.min("calibrated"), F.max("calibrated")).first() == pytest.approx((105.0, 105.0))
    # held-out labels do not reach their own fold
    odd = df.withColumn("y_true", F.when(F.col("fold") == 0, 1.0).otherwise(F.col("y_true")))
    out = cross_fit_calibration(odd, minimum_samples=4, shrinkage=0.0)
    assert out.where("fold = 0").agg(F.min("calibrated")).first()[0] == pytest.approx(105.0)


def test_fold_subset_and_coverage(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(10)], "fold int, y_true double")
    kept = fold_subset(df, "recent", 4)
    assert sorted(r["fold"] for r in kept.collect()) == ["recent_0", "recent_3", "recent_6", "recent_9"]
    problems = {(r["fold"], r["problem"]) for r in fold_coverage(kept, 2, 0).collect()}
    assert problems == {("recent_1", "missing"), ("recent_3", "unexpected"), ("recent_6", "unexpected"), ("recent_9", "unexpected")}


def test_candidates_must_cover_the_same_keys(spark):
    a = spark.createDataFrame([(1, 5.0, 4.0), (2, 6.0, 5.0)], "pos int, y_true double, y_pred double")
    assert join_candidates({"a": a, "b": a}, ["pos"]).count() == 2
    for other in (a.where("pos = 1"), a.union(a), a.withColumn("y_true", F.col("y_true") + 1)):
        with pytest.raises(Exception, match="same keys"):
            join_candidates({"a": a, "b": other}, ["pos"]).collect()


def test_limits_clamp_to_the_clamped_step(spark):
    rows = [("p", 1, "one", h, v, 10.0) for h, v in ((1, 30.0), (2, 31.0), (3, -5.0))] + [("p", 1, "all", h, 14.0, 14.0) for h in (1, 2, 3)]
    tidy = spark.createDataFrame(rows, "series_id string, pos int, field string, horizon int, y_pred double, current double")
    out = apply_limits(tidy, {"one": 25.0}, ramp=3.0, part="one", total="all")
    got = {(r["field"], r["horizon"]): r["y_limited"] for r in out.collect()}
    assert [got["one", h] for h in (1, 2, 3)] == [13.0, 14.0, 13.0]
    counts = adjustment_counts(out).first()
    assert (counts["non_negative"], counts["capacity"], counts["consistency"]) == (1, 2, 1)


def test_wide_names_and_contracts(spark, long_grid):
    assert forecast_columns(["a", "b"], [1, 2]) == ["a_t+15_pred", "a_t+30_pred", "b_t+15_pred", "b_t+30_pred"]
    assert split_forecast_column("x_t+1_t+45_pred") == ("x_t+1", 3)
    for bad in ("a_t+7_pred", "a_15_pred", "a_t+0_pred"):
        with pytest.raises(ValueError):
            split_forecast_column(bad)
    tidy = forecast(long_grid({"a": [1, 2, 3], "b": [200, 100, 50]}), [MODELS[0]], (1, 2)).withColumnRenamed("last", "y_pred")
    wide = pivot_forecast(tidy, ["a", "b"], [1, 2])
    back = unpivot_forecast(wide)
    assert back.exceptAll(tidy.select(*back.columns)).count() == 0 and back.count() == 12
    frame = wide.select("series_id", F.lit("2025-01-01 00:00:00").alias("datetime"), *[F.col(f"`{c}`") for c in wide.columns[2:]])
    report = {r["check"]: r["broken"] for r in forecast_frame_rules(frame, ["a", "b"], [1, 2], capacities={"a": 2.0}, part="b", total="a").collect()}
    assert report["capacity_a"] == 1 and report["part_over_total"] == 3 and report["unique_origin"] == 1 and report["non_finite"] == 0
    with pytest.raises(ContractError):
        forecast_frame_rules(frame, ["b", "a"], [1, 2])
    with pytest.raises(ContractError):
        plan_frame_rules(spark.createDataFrame([("t", 1.0)], "datetime string, gas double"))


def test_blend_weights_are_checked(spark):
    long = spark.createDataFrame([(1, "a", 10.0), (1, "b", 20.0)], "pos int, model string, y_pred double")
    w = lambda a, b: spark.createDataFrame([("a", a), ("b", b)], "model string, weight double")
    assert weighted_blend(long, w(3.0, 1.0), ["pos"]).first()["y_pred"] == 12.5
    assert weighted_blend(long, w(1.5, -0.5), ["pos"], signed=True).first()["y_pred"] == 5.0
    with pytest.raises(Exception, match="negative"):
        weighted_blend(long, w(2.0, -1.0), ["pos"]).collect()
    with pytest.raises(Exception, match="add up to one"):
        weighted_blend(long, w(2.0, 1.0), ["pos"], signed=True).collect()


def test_coverage_gives_zero_for_conditions_that_never_occur(spark, tmp_path):
    from slotwise.queries import REGISTRY

    # a steady reading of every field in every hour: no gap, no ramp
    spark.range(600 * 5).selectExpr(
        "id as event_id", "timestamp_seconds(1704070800 + 3600 * (id div 5) - 60) as ts", "0L as user_id",
        "element_at(array('click', 'error', 'purchase', 'signup', 'view'), cast(id % 5 as int) + 1) as event_type",
        "30.0D as value").write.parquet(f"{tmp_path}/events.parquet")
    row = REGISTRY["coverage"].run(spark, str(tmp_path)).first()
    assert row["rows"] > 0 and (row["high_missing"], row["ramp_up"]) == (0, 0)
