"""Input-matrix quality, audit, relations, dispatch, compensation, analogs, learned models, streams."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slotwise.operators.availability import FieldRule, FieldUse, judge, registry_table, rules_from, select_allowed, usage_table
from slotwise.operators.correlate import lag_moments, least_squares, least_squares_direct
from slotwise.plans.analog import analog_forecast, nearest, trajectory_patterns
from slotwise.plans.audit import Relation, combinations, copies, delay_pairs, linear_relation, multivariate_fit, segment_statistics, setpoints, suspicious_names
from slotwise.plans.compensation import Setting, compensate, setting_grid
from slotwise.plans.dispatch import Unit, audit_plan, input_rules, plan_figures, shortage_verdict
from slotwise.plans.learned import feature_frame, fit, fit_load_map, mixup, nonnegative_fit, ridge, training_set
from slotwise.plans.quality import duplicate_columns, outlier_counts, profile, prune_features, quality_report, repair_scoring, winsorise, with_history, reread_input
from slotwise.plans.routing import pick_least, softmax_blend
from slotwise.operators.clean import CleanRule, OutlierRule


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    pdf = pd.DataFrame({"series_id": "p", "pos": range(n), **columns})
    return spark.createDataFrame(pdf)


def test_pruning_names_every_reason(spark):
    m = frame(spark, keep=[float(i) for i in range(8)], twin=[float(i) for i in range(8)], flat=[1.0] * 8, empty=[float("nan")] * 8)
    out = prune_features(m, ["keep", "twin", "flat", "empty"])
    assert (out.kept, out.duplicate, out.constant, out.all_nonfinite) == (["keep"], ["twin"], ["flat"], ["empty"])
    assert duplicate_columns(m, ["twin", "keep"]) == [("keep", "twin")]


def test_profile_and_outliers_equal_pandas(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=99), [50.0]])
    m = frame(spark, v=v, w=np.where(np.arange(100) % 9 == 0, np.nan, v))
    p = {r["column"]: r for r in profile(m, ["v", "w"]).collect()}
    assert p["v"]["std"] == pytest.approx(v.std()) and p["w"]["nonfinite"] == 12 and p["v"]["q3"] == pytest.approx(np.quantile(v, 0.75))
    got = outlier_counts(m, ["v"]).first()
    union = np.zeros(100, bool)
    for rule in ("linear", "lower", "higher", "midpoint", "nearest"):
        a, b = np.quantile(v, 0.25, method=rule), np.quantile(v, 0.75, method=rule)
        mask = (v < a - 1.5 * (b - a)) | (v > b + 1.5 * (b - a))
        union |= mask
        assert got[f"iqr_{rule}"] == mask.sum()
    assert got["iqr_any"] == union.sum() and got["zscore"] == (np.abs(v - v.mean()) > 3 * v.std()).sum()


def test_winsorise_mends_or_drops(spark):
    keep = [float(i) for i in range(11)] + [100.0]
    m = frame(spark, keep=keep, twin=keep, flat=[5.0] * 12, rare=[0.0] * 11 + [1.0])
    out, log = winsorise(m, ["keep", "twin", "flat", "rare"])
    actions = {(r["column"], r["action"]) for r in log.collect()}
    assert out.columns == ["series_id", "pos", "keep"]
    assert {("flat", "constant"), ("twin", "duplicate"), ("keep", "winsorised"), ("rare", "constant")} <= actions
    final = quality_report(out, ["keep"]).first()
    assert final["iqr_any"] == 0 and final["zscore"] == 0 and not final["constant"] and final["duplicate_of"] is None
    with pytest.raises(ValueError):
        winsorise(frame(spark, a=[1.0, float("nan")]), ["a"])


def test_repair_uses_the_training_tail(spark):
    mk = lambda f, ps, v: [("p", f, p, x) for p, x in zip(ps, v)]
    schema = "series_id string, field string, pos long, value double"
    training = spark.createDataFrame(mk("valid", range(120), [10 + i % 11 * 1.0 for i in range(120)]) + mk("void", range(120), [None] * 120), schema)
    scoring = spark.createDataFrame(mk("valid", range(120, 128), [None, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0, 17.0]) + mk("void", range(120, 128), [1.0] * 8), schema)
    repaired, counts = repair_scoring(training, scoring, scoring.select("series_id", "pos"), CleanRule(OutlierRule("iqr", 24, 12, 3.0)), 50)
    rows = {(r["field"], r["pos"]): r["value"] for r in repaired.collect()}
    assert {f for f, _ in rows} == {"valid"} and rows["valid", 120] == 10.0 + 119 % 11
    assert counts.first()["missing_repairs"] == 1
    shared = spark.createDataFrame(mk("valid", [120], [99.0]), schema)
    joined = with_history(training.union(shared), scoring, 5).where("field = 'valid'")
    assert joined.where("pos = 120").count() == 1 and joined.where("pos = 120").first()["value"] is None
    with pytest.raises(Exception, match="after the scoring start"):
        with_history(training.union(spark.createDataFrame(mk("valid", [124], [9.0]), schema)), scoring).collect()


def test_availability_verdicts(spark):
    rules = [FieldRule("a", "f", True, 1, allow_long=True), FieldRule("p", "f", True, 0, allow_long=True, known_ahead_steps=4),
             FieldRule("late", "f", True, 0, allow_long=True, collection_delay_steps=3)]
    uses = [FieldUse("a0", "a", 0), FieldUse("a1", "a", -1), FieldUse("x", "unknown", -9), FieldUse("p4", "p", 0), FieldUse("l2", "late", -2), FieldUse("l3", "late", -3),
            FieldUse("s", "a", -1, "short")]
    out = {r["feature"]: r["objection"] for r in judge(usage_table(spark, uses), registry_table(spark, rules)).collect()}
    assert out == {"a0": "lag too short", "a1": None, "x": "not allowed in scope", "p4": None, "l2": "not yet available at origin", "l3": None, "s": "not allowed in scope"}
    m = frame(spark, a0=[1.0], a1=[1.0], x=[1.0])
    assert select_allowed(m, uses, rules).columns == ["series_id", "pos", "a1"]
    assert rules_from({"q": {"min_lag_steps": 2, "event_time": "ignored"}})[0].min_lag_steps == 2


@pytest.fixture(scope="module")
def leaky(spark):
    rng = np.random.default_rng(4)
    y = 100 + np.cumsum(rng.normal(size=400))
    return frame(spark, target=y, leak=2 * np.roll(y, -2) + 3, noise=rng.normal(size=400), a=rng.normal(size=400)).withColumn("sum", F.col("a") + 2 * F.col("noise"))


def test_leaks_are_found_at_their_offset(leaky):
    m = lag_moments(leaky.where("pos < 398"), ["leak", "noise"], ["target"], -4, 4, block=50)
    found = copies(m, ["target"]).collect()
    assert [(r["field"], r["offset"], r["risk"]) for r in found] == [("leak", 2, "red")]
    assert found[0]["coefficient"] == pytest.approx(0.5) and found[0]["intercept"] == pytest.approx(-1.5)
    one = {r["offset"]: r for r in m.where("field = 'noise'").collect()}
    pdf = leaky.where("pos < 398").orderBy("pos").toPandas()
    for k in (-4, 0, 3):
        assert one[k]["correlation"] == pytest.approx(pdf["noise"].corr(pdf["target"].shift(-k)))
    pairs = delay_pairs(leaky.where("pos < 398").select("series_id", "pos", "target", "leak"), {"target": "x", "leak": "y"}, 4).first()
    assert (pairs["right_offset"], pairs["risk"]) == (-2, "review")


def test_relations_and_multivariate_copies(leaky):
    fit_ = least_squares(leaky, ["series_id"], ["a", "noise"], "sum").first()
    assert fit_["coefficients"] == pytest.approx([1.0, 2.0]) and fit_["intercept"] == pytest.approx(0.0, abs=1e-12)
    out = multivariate_fit(leaky, ["a", "noise"], "sum").first()
    assert out["r2"] == pytest.approx(1.0) and out["test_rows"] == 120
    summary, monthly, worst = linear_relation(leaky, Relation("s", "sum", ["a", "noise"]))
    assert summary.first()["candidate"] and worst.count() == 5 and monthly.count() == 1
    # two equal regressors: the minimum-norm fit shares the weight
    twin = leaky.withColumn("b", F.col("a"))
    assert least_squares(twin, ["series_id"], ["a", "b"], "sum").first()["coefficients"] == pytest.approx(
        [least_squares(twin, ["series_id"], ["a"], "sum").first()["coefficients"][0] / 2] * 2)


def test_quality_report_makes_the_cells_once(spark):
    # keys and values pass an accumulator each time the matrix is read
    seen = spark.sparkContext.accumulator(0)
    rows = [(i, float(i % 7)) for i in range(200)]

    def mark(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    matrix = spark.createDataFrame(rows, "pos long, a double").mapInArrow(mark, "pos long, a double").withColumns(
        {"b": F.col("a") + 0, "flat": F.lit(2.0)})
    out = {r["column"]: r for r in quality_report(matrix, ["a", "b", "flat"], keys=["pos"]).collect()}
    a = np.array([v for _, v in rows])
    assert out["a"]["mean"] == pytest.approx(a.mean()) and out["a"]["std"] == pytest.approx(a.std()) and out["a"]["rows"] == 200
    assert out["b"]["duplicate_of"] == "a" and out["flat"]["constant"] and out["a"]["iqr_any"] == out["flat"]["zscore"] == 0
    assert seen.value <= 3 * 200  # tallies, fingerprints, and the comparison of equal ones


def test_multivariate_split_is_exact(spark):
    # 90 * 0.7 is 62.99999999999999 in doubles; the exact share trains on 63 rows and judges 27
    a = np.random.default_rng(4).normal(size=(90, 2))
    out = multivariate_fit(frame(spark, a=a[:, 0], b=a[:, 1], y=a[:, 0] - a[:, 1]), ["a", "b"], "y").first()
    assert (out["rows"], out["test_rows"]) == (90, 27)


def test_multivariate_fit_is_the_direct_one(spark):
    rng = np.random.default_rng(5)
    large, small = 90_000 + 9_000 * rng.normal(size=200), 0.05 + 0.002 * rng.normal(size=200)
    tiny = 1e-5 * rng.normal(size=200)
    y = 2 * large + 1e9 * tiny + 3e4 * small
    x = np.column_stack([large, tiny, small])
    out = combinations(multivariate_fit(frame(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2], y=y), ["a", "b", "c"], "y")).first()
    want = np.linalg.lstsq(np.column_stack([np.ones(140), x[:140]]), y[:140], rcond=None)[0]
    assert out["coefficients"] == pytest.approx(want[1:].tolist(), rel=1e-6) and out["r2"] == pytest.approx(1.0)
    assert (out["candidate"], out["kind"], out["risk"]) == (True, "multivariate_linear_combination", "amber")
    # equal fields: the minimum-norm solution has the intercept in its norm; values that are not finite don't count
    twin = np.append(1 + rng.normal(size=200), [np.nan, np.inf, 1.0])
    z = np.append(rng.normal(size=200) + 5, [1.0, 1.0, -np.inf])
    out = combinations(multivariate_fit(frame(spark, a=twin, b=twin, y=z), ["a", "b"], "y")).first()
    want = np.linalg.lstsq(np.column_stack([np.ones(140), twin[:140], twin[:140]]), z[:140], rcond=None)[0]
    assert out["rows"] == 200 and [out["intercept"], *out["coefficients"]] == pytest.approx(want.tolist(), rel=1e-6)
    assert (out["candidate"], out["kind"], out["risk"]) == (False, None, None)


def test_direct_least_squares_of_many_groups_and_parts(spark):
    rng = np.random.default_rng(6)
    rows = [(None if g == 2 else g, *rng.normal(size=2).tolist()) for g in range(7) for _ in range(3000)]
    rows = [(g, a, b, a - 2 * b + (g or 0)) for g, a, b in rows]
    made = spark.createDataFrame(rows, "g long, a double, b double, y double").repartition(6)
    out = {r["g"]: r for r in least_squares_direct(made, ["g"], ["a", "b"], "y").collect()}
    assert set(out) == {0, 1, None, 3, 4, 5, 6} and all(r["n"] == 3000 for r in out.values())
    for g, r in out.items():
        assert [r["intercept"], *r["coefficients"]] == pytest.approx([g or 0, 1.0, -2.0], abs=1e-9)
    whole = least_squares_direct(made, [], ["a", "b"], "y").first()
    x = np.array([(1.0, a, b) for _, a, b, _ in rows])
    assert whole["n"] == 21000 and [whole["intercept"], *whole["coefficients"]] == pytest.approx(
        np.linalg.lstsq(x, np.array([r[3] for r in rows]), rcond=None)[0].tolist())


def test_segments_setpoints_names(spark, long_grid):
    grid = long_grid({"x": [5, 5, 5, 7, 7, 9]})
    s = segment_statistics(grid, 0.05).first()
    assert (s["change_points"], s["longest_constant_run"], s["median_constant_run"]) == (2, 3, 2.0)
    top = setpoints(grid, 2.0, 1).first()
    assert (top["setpoint"], top["sample_count"]) == (8.0, 2) or top["setpoint"] == 4.0
    names = spark.createDataFrame([("x_Future",), ("plan_x",), ("ok",)], "name string")
    assert {r["name"]: r["risk"] for r in suspicious_names(names, ["future", "plan"]).collect()} == {"x_Future": "red", "plan_x": "amber"}


def test_dispatch_plan_audit(spark):
    fleet = [Unit("u", 50.0, "g", 0.6, 1.0, 40.0)]
    gas = [("p", t, "blast", 100.0, 40.0, 50.0, 60.0 + 10 * (t + 1), 0.0, 0.0) for t in range(4)]
    cols = "plan_id string, pos int, gas_type string, production double, demand double, use double, storage double, flare double, shortage double"
    units = [("p", t, "u", 40.0, 1.0, 0.0) for t in range(4)]
    ucols = "plan_id string, pos int, unit string, load double, on double, start double"
    run = lambda g, u: {r["rule"]: r["violation"] for r in audit_plan(
        spark.createDataFrame(g, cols), spark.createDataFrame(u, ucols), fleet, {"blast": 60.0}, {"blast": 0.8}, {"blast": 200.0}, block=2).collect()}
    assert max(run(gas, units).values()) == pytest.approx(0.0)
    jump = [u if u[1] != 2 else ("p", 2, "u", 49.0, 1.0, 0.0) for u in units]
    assert run(gas, jump)["ramp_up"] == pytest.approx(9 - 7.5) and run(gas, jump)["generation_conversion"] == pytest.approx(9.0)
    off = [u if u[1] != 1 else ("p", 1, "u", 0.0, 0.0, 0.0) for u in units]
    assert run(gas, off)["unmarked_start"] == 1.0
    lost = [g if g[1] != 3 else (*g[:6], 5.0, *g[7:]) for g in gas]
    out = run(lost, units)
    assert out["gas_bounds"] == pytest.approx(25.0) and out["material_balance"] == pytest.approx(95.0)
    price = spark.createDataFrame([("p", t, 1.0 + t, 40.0, 0.0) for t in range(4)], "plan_id string, pos int, price double, baseline_generation double, baseline_flare double")
    fig = plan_figures(spark.createDataFrame(gas, cols), spark.createDataFrame(units, ucols), price).first()
    assert fig["generation_mwh"] == 40.0 and fig["price_weighted_load_ratio"] == pytest.approx(1.0) and fig["relative_improvement"] == 0.0
    short = plan_figures(spark.createDataFrame([(*g[:8], 1.0) for g in gas], cols), spark.createDataFrame(units, ucols), price)
    assert shortage_verdict(short).first()["verdict"] == "rejected"
    rows = spark.createDataFrame([("p", 1, "blast", 5.0, 1.0, 10.0, 1.0)], "plan_id string, pos int, gas_type string, production double, demand double, initial_storage double, price double")
    assert input_rules(rows, 1, {"blast": 200.0}).first()["storage_outside"] == 1
    assert input_rules(rows, 1, {"blast": 20.0}).first()["status"] == "passed"


def replay(pdf, s, max_h=4):
    """Origin by origin, as the definition reads."""
    out = {}
    own, shared = {}, []
    for o in sorted(pdf["pos"].unique()):
        known = pdf[(pdf["target_pos"] == o) & pdf["y_true"].notna()]
        if len(known):
            a = known["y_true"] - known["y_pred"]
            r = a / np.maximum(known["y_pred"].abs(), 1)
            for h, x, y in zip(known["horizon"], a, r):
                own.setdefault(h, []).append((x, y))
            shared.append((a.median(), r.median()))
        mid = lambda xs, i: (np.median if s.centre == "median" else np.mean)([x[i] for x in xs[-s.window:]]) if xs else 0.0
        for _, row in pdf[pdf["pos"] == o].iterrows():
            h, b = row["horizon"], row["y_pred"]
            ha, hr = mid(own.get(h, []), 0), mid(own.get(h, []), 1)
            sa, sr = mid(shared, 0), mid(shared, 1)
            c = {"shared_absolute": sa, "shared_relative": b * sr, "horizon_absolute": ha, "horizon_relative": b * hr,
                 "blended_absolute": (sa + ha) / 2, "blended_relative": b * (sr + hr) / 2, "scaled_shared_absolute": sa * h / 8}[s.signal]
            out[o, h, s.name] = b + s.share * c
    return out


def test_compensation_equals_a_replay(spark):
    rng = np.random.default_rng(6)
    rows = []
    y = {p: (None if p % 7 == 3 else 100 + rng.normal()) for p in range(40)}
    for o in range(30):
        for h in range(1, 5):
            rows.append(("s", "f", "cross_month_0", o, h, o + h, y[o + h], 95 + rng.normal()))
    cols = ["series_id", "field", "fold", "pos", "horizon", "target_pos", "y_true", "y_pred"]
    pdf = pd.DataFrame(rows, columns=cols)
    tidy = spark.createDataFrame(rows, "series_id string, field string, fold string, pos long, horizon int, target_pos long, y_true double, y_pred double")
    settings = setting_grid(windows=(1, 4), shares=(0.5,))
    assert len(settings) == 28 and len(setting_grid()) == 588
    got = {(r["pos"], r["horizon"], r["setting"]): r["y_comp"] for r in compensate(tidy, settings).collect()}
    want = {}
    for s in settings:
        want |= replay(pdf, s)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert Setting("a", "mean", 4, 0.5).name == "a|mean|4|0.5"


@pytest.mark.parametrize("chunk", [7, 4096])
def test_nearest_equals_brute_force(spark, chunk):
    rng = np.random.default_rng(8)
    q, c = rng.normal(size=(20, 5)), rng.normal(size=(60, 5))
    mk = lambda m: spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(m)], "g string, pos long, pattern array<double>")
    got = {(r["query"], r["rank"]): r["neighbour"] for r in nearest(mk(q), mk(c), ["g"], 4, chunk=chunk).collect()}
    d = np.sqrt(((q[:, None] - c[None]) ** 2).sum(-1))
    want = {(i, k + 1): j for i in range(20) for k, j in enumerate(np.argsort(d[i], kind="stable")[:4])}
    assert got == want


def test_analog_forecast_equals_its_definition(spark):
    rng = np.random.default_rng(9)
    x = 100 + np.cumsum(rng.normal(size=120))
    wide = frame(spark, a=x)
    c, k, H = 6, 5, 2
    patterns = trajectory_patterns(wide, ["a"], [200.0], c, H)
    origins = spark.createDataFrame([("p", "f0", 100), ("p", "f0", 104)], "series_id string, fold string, pos long")
    got = {(r["pos"], r["horizon"]): r["analog"] for r in analog_forecast(patterns, origins, ["a"], [1, 2], k, chunk=16).collect()}

    def pattern(p):
        d = np.diff(x[p - c + 1:p + 1])
        s = max(1.4826 * np.median(np.abs(d - np.median(d))), 0.5)
        return np.concatenate([d / s, [x[p] / 200], [d[-4:].mean() / s]]), s

    pool = [p for p in range(c - 1, 100 - H) if p + H <= 99]
    for o in (100, 104):
        v, s = pattern(o)
        near = sorted((np.linalg.norm(pattern(p)[0] - v), p) for p in pool)[:k]
        w = np.array([np.exp(-d / max(np.median([n[0] for n in near]), 1e-6)) for d, _ in near])
        for h in (1, 2):
            ch = [(x[p + h] - x[p]) * np.clip(s / pattern(p)[1], 0.5, 2.0) for _, p in near]
            assert got[o, h] == pytest.approx(x[o] + (w * ch).sum() / w.sum())


def test_training_set_and_mixup(spark, long_grid):
    x = [20 + i % 13 + 0.1 * i for i in range(300)]
    feats, names = feature_frame(long_grid({"a": x}), online_above=1.0, stable_within=50.0)
    train = training_set(feats.withColumn("end", F.lit(1250)), (1, 4), F.col("end"), "delta", half_life=100.0)
    assert train.agg(F.max(F.col("pos") + F.col("horizon"))).first()[0] == 1250
    means = {r["horizon"]: r["m"] for r in train.groupBy("horizon").agg(F.avg("weight").alias("m")).collect()}
    assert means == pytest.approx({1: 1.0, 4: 1.0})
    row = train.where("pos = 1100 and horizon = 4").first()
    assert row["response"] == pytest.approx(x[104] - x[100])
    out = mixup(train, names, 0.25)
    counts = {(r["horizon"], r["augmented"]): r["n"] for r in out.groupBy("horizon", "augmented").agg(F.count(F.lit(1)).alias("n")).collect()}
    for h in (1, 4):
        assert counts[h, True] == round(counts[h, False] * 0.25)
    again = mixup(train, names, 0.25)
    assert out.select("pos", "horizon", "response", "augmented").exceptAll(again.select("pos", "horizon", "response", "augmented")).count() == 0
    with pytest.raises(Exception, match="too few"):
        training_set(feats.withColumn("end", F.lit(1010)), (1,), F.col("end")).collect()


def test_learned_models_and_constant_fallback(spark, long_grid, tmp_path):
    feats, names = feature_frame(long_grid({"line": [2.0 * i for i in range(120)], "flat": [42.0] * 120}))
    train = training_set(feats.withColumn("end", F.lit(1100)), (1,), F.col("end"), "absolute")
    model = fit(train, names, lambda: ridge(1e-6))
    assert model.constants == {("flat", None): 42.0}
    asked = feats.where("pos > 1100").withColumn("horizon", F.lit(1))
    out = {(r["field"], r["pos"]): r["y_pred"] for r in model.predict(asked).collect()}
    assert out["flat", 1110] == 42.0 and out["line", 1110] == pytest.approx(222.0, abs=0.5)
    model.save(spark, str(tmp_path))
    again = type(model).load(spark, str(tmp_path))
    assert (again.constants, again.names, again.response) == (model.constants, model.names, model.response)
    assert {(r["field"], r["pos"]): r["y_pred"] for r in again.predict(asked).collect()} == out


def test_scoring_columns_and_stored_input(spark, tmp_path):
    rows = [("s", i, float(i), float(i * i % 7), 1.0 * i) for i in range(20)]
    frame = spark.createDataFrame(rows, "series_id string, pos long, a double, b double, c double")
    found = prune_features(frame, ["a", "b", "c"], scoring=frame.drop("a"))
    assert found.not_in_scoring == ["a"] and found.kept == ["b", "c"]
    frame.write.parquet(f"{tmp_path}/input")
    rules, report = reread_input(spark, f"{tmp_path}/input", ["a", "b"], frame.select("series_id", "pos"))
    assert [r["status"] for r in rules.collect()] == ["passed"] and report.count() == 2
    more = frame.select("series_id", "pos").union(spark.createDataFrame([("t", 1)], "series_id string, pos long"))
    assert {r["series_id"]: r["status"] for r in reread_input(spark, f"{tmp_path}/input", ["a"], more)[0].collect()} == {"s": "passed", "t": "failed"}


def test_load_map_recovers_nonnegative_coefficients(spark):
    g = np.array([[2.0, 0.3], [0.3, 1.0]])
    assert nonnegative_fit(g, g @ np.array([1.5, 0.5])) == pytest.approx([1.5, 0.5])
    assert nonnegative_fit(g, g @ np.array([1.5, -0.5]))[1] == 0.0
    n, i = 240, np.arange(240)
    p, d, hold = 120 + 5 * np.sin(i / 12), 70 + 2 * np.cos(i / 8), 50000 + 20 * np.sin(i / 20)
    avail = p - d - np.r_[0, np.diff(hold)] / 15
    m = frame(spark, production__g=p, consumption__g=d, holder_change__g=np.r_[0, np.diff(hold)] / 15, component_one=80 + 0.3 * avail, component_extra=40 + 0.1 * avail)
    rows = {r["component"]: r for r in fit_load_map(m, ["g"], [4]).collect()}
    assert rows["component_one"]["coefficients"] == pytest.approx([0.0, 0.3], abs=1e-6) and rows["component_one"]["rows"] == n - 4
    assert rows["component_extra"]["intercept"] == pytest.approx(40.0, abs=1e-4)


def test_routing_expressions(spark):
    df = spark.createDataFrame([(1.0, 2.0, [0.2, 0.1]), (1.0, 2.0, [0.1, 0.1])], "a double, b double, e array<double>")
    assert [r[0] for r in df.select(pick_least(["a", "b"], F.col("e"))).collect()] == [2.0, 1.0]
    w = 1 / (1 + math.exp(-1))
    assert df.select(softmax_blend(["a", "b"], F.col("e"), 0.1)).first()[0] == pytest.approx((1 - w) * 1 + w * 2)


def test_streams_bin_and_mature(spark, tmp_path):
    from slotwise.streaming.live import mature_labels, stream_bins

    rows = [("a", "2025-01-01 00:15:00", 1.0), ("a", "2025-01-01 00:15:01", 3.0), ("a", "2025-01-01 00:29:00", 5.0), ("a", "2025-01-01 03:00:00", 9.0)]
    src, schema = str(tmp_path / "in"), "k string, ts timestamp_ntz, value double"
    spark.createDataFrame(rows, "k string, t string, value double").select("k", F.col("t").cast("timestamp_ntz").alias("ts"), "value").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    q = stream_bins(stream, ["k"], 900, "10 minutes").writeStream.format("memory").queryName("bins").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {str(r["bin_end"]): (r["mean"], r["n"]) for r in spark.table("bins").collect()}
    assert got["2025-01-01 00:15:00"] == (1.0, 1) and got["2025-01-01 00:30:00"] == (4.0, 2)
    fsrc = str(tmp_path / "f")
    spark.createDataFrame([("a", "2025-01-01 00:00:00", 1, 0.5)], "k string, o string, horizon int, y_pred double").select(
        "k", F.col("o").cast("timestamp_ntz").alias("origin"), "horizon", "y_pred").coalesce(1).write.parquet(fsrc)
    fc = spark.readStream.schema("k string, origin timestamp_ntz, horizon int, y_pred double").parquet(fsrc)
    q = mature_labels(fc, stream, ["k"], 900, "10 minutes").writeStream.format("memory").queryName("matured").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert [r["error"] for r in spark.table("matured").collect()] == [0.5]
