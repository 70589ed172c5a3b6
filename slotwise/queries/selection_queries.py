"""Gates, out-of-fold blends, winners, calibration, shortlists."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions.slots import slot_start
from slotwise.plans.forecast import melt
from slotwise.plans.fusion import (
    apply_weights, apply_winner, blend_report, calibrate, cross_fit_calibration, fold_weight, fuse, gram, hard_winner, hour_factors,
    oof_weights, used_models,
)
from slotwise.plans.gates import candidate_gate, column_gate, fold_gains, residual_gate, two_window_gate
from slotwise.plans.selection import (
    combine_windows, compare_challenger, diverse_shortlist, fold_coverage, join_candidates, method_scores,
    order_candidates, search_objective, trial_table,
)
from slotwise.session import cut_lineage
from slotwise.queries.base import HOUR, hourly_grid, query, sig, sig_sql, sigs
from slotwise.queries.forecast_queries import FLOORED, OK, backtest, tidy_sql

NAMES = ("last_value", "mean_8", "trend_8", "daily")
FOLD_NAME = "CASE WHEN fold < 2 THEN 'cross_month_' || CAST(fold AS VARCHAR) ELSE 'recent_' || CAST(fold AS VARCHAR) END"


def named(spark, sf, models=NAMES):
    """Back-test with fold names: the first two folds play cross-month, the others recent."""
    kind = F.when(F.col("fold") < 2, "cross_month").otherwise("recent")
    # the tidy table is the fact table of selection: stored once, read by every aggregate
    return cut_lineage(backtest(spark, sf, models).withColumns({
        "validation_type": kind, "fold": F.concat(kind, F.lit("_"), F.col("fold").cast("string"))}))


def named_sql(models=NAMES) -> str:
    parts = " UNION ALL ".join(
        f"SELECT series_id, field, fold, validation_type, pos, horizon, target_pos, y_true, '{m}' AS model, {m} AS y_pred FROM named"
        for m in models)
    return tidy_sql(models) + f""", named AS (SELECT * EXCLUDE (fold), {FOLD_NAME} AS fold,
  CASE WHEN fold < 2 THEN 'cross_month' ELSE 'recent' END AS validation_type FROM tidy),
long AS ({parts})"""


GAIN_SQL = f""",
pair AS (SELECT l.*, b.y_pred AS base FROM long l JOIN long b USING (series_id, field, fold, pos, horizon)
  WHERE b.model = 'last_value' AND l.model <> 'last_value' AND l.y_true IS NOT NULL AND l.y_pred IS NOT NULL AND b.y_pred IS NOT NULL),
gains AS (SELECT field, horizon, model AS candidate, fold, avg(abs(base - y_true) / greatest(abs(y_true), 1e-6)) AS baseline_mape,
  avg({FLOORED}) AS candidate_mape FROM pair GROUP BY 1, 2, 3, 4)
"""


@query("fold_gains", "WITH " + named_sql() + GAIN_SQL + f"""
SELECT field, horizon, candidate, fold, {sig_sql("baseline_mape")} AS baseline_mape, {sig_sql("candidate_mape")} AS candidate_mape FROM gains
""")
def fold_gains_query(spark, sf):
    return fold_gains(named(spark, sf), NAMES[1:], "last_value").select(
        "field", "horizon", "candidate", "fold", *sigs(["baseline_mape", "candidate_mape"]))


@query("column_gate", "WITH " + named_sql() + GAIN_SQL + f""",
g AS (SELECT field, horizon, candidate, avg(baseline_mape - candidate_mape) AS mg, min(baseline_mape - candidate_mape) AS wg,
  count(*) FILTER (baseline_mape - candidate_mape >= 0) AS nd, count(*) AS tf FROM gains GROUP BY 1, 2, 3)
SELECT field, horizon, candidate, {sig_sql("mg")} AS mean_gain, {sig_sql("wg")} AS worst_gain, nd AS non_degraded_folds, tf AS total_folds,
  mg > 0 AND nd >= least(3, tf) AND wg >= -0.5 AS passed,
  concat_ws('; ', CASE WHEN mg <= 0 THEN 'mean not improved' END, CASE WHEN nd < least(3, tf) THEN 'too few folds held' END,
            CASE WHEN wg < -0.5 THEN 'worst fold degraded' END) AS reasons
FROM g
""")
def column_gate_query(spark, sf):
    out = column_gate(named(spark, sf), NAMES[1:], minimum_non_degraded_folds=3, maximum_worst_degradation=0.5)
    return out.select("field", "horizon", "candidate", *sigs(["mean_gain", "worst_gain"]), "non_degraded_folds", "total_folds",
                      "passed", F.concat_ws("; ", "reasons").alias("reasons"))


_CAND = f""",
cf AS (SELECT validation_type, fold, avg(abs(base - y_true) / greatest(abs(y_true), 1e-6)) - avg({FLOORED}) AS gain
  FROM pair WHERE candidate = 'mean_8' GROUP BY 1, 2),
ct AS (SELECT validation_type, field, avg(abs(base - y_true) / greatest(abs(y_true), 1e-6)) - avg({FLOORED}) AS gain
  FROM pair WHERE candidate = 'mean_8' GROUP BY 1, 2),
cg AS (SELECT validation_type, avg(gain) AS mg, min(gain) AS wg, count(*) FILTER (gain > 0) AS improved, count(*) AS tf FROM cf GROUP BY 1),
cw AS (SELECT validation_type, min(gain) AS wt FROM ct GROUP BY 1),
verdict AS (SELECT validation_type, mg, wg, improved, tf, wt, mg >= 0.001 AND wt >= 0 AND improved >= least(3, tf) AND wg >= -0.015 AS passed FROM cg JOIN cw USING (validation_type))
""".replace("candidate = 'mean_8'", "model = 'mean_8'")


def _arms(spark, sf):
    wide = named(spark, sf, ("last_value", "mean_8")).where("y_true IS NOT NULL")
    return wide.withColumnRenamed("last_value", "y_pred").drop("mean_8"), wide.withColumnRenamed("mean_8", "y_pred").drop("last_value")


@query("candidate_gate", "WITH " + named_sql(("last_value", "mean_8")) + GAIN_SQL + _CAND + f"""
SELECT validation_type, {sig_sql("mg")} AS mean_gain, {sig_sql("wg")} AS worst_gain, improved AS improved_folds, tf AS total_folds,
  {sig_sql("wt")} AS worst_target_gain, passed FROM verdict
""")
def candidate_gate_query(spark, sf):
    base, cand = _arms(spark, sf)
    out = candidate_gate(base, cand, by=["validation_type"])
    return out.select("validation_type", *sigs(["mean_gain", "worst_gain"]), "improved_folds", "total_folds",
                      sig("worst_target_gain"), "passed")


@query("two_window_gate", "WITH " + named_sql(("last_value", "mean_8")) + GAIN_SQL + _CAND + f"""
SELECT bool_and(passed) AS passed, {sig_sql("avg(mg)")} AS mean_gain, {sig_sql("min(wg)")} AS worst_gain,
  CAST(sum(improved) AS BIGINT) AS improved_folds FROM verdict
""")
def two_window_gate_query(spark, sf):
    base, cand = _arms(spark, sf)
    return two_window_gate(candidate_gate(base, cand, by=["validation_type"])).select(
        "passed", *sigs(["mean_gain", "worst_gain"]), "improved_folds")


@query("residual_gate", "WITH " + named_sql() + GAIN_SQL + f"""
SELECT candidate, {sig_sql("min(baseline_mape - candidate_mape)")} AS minimum_fold_gain,
  count(*) FILTER (baseline_mape - candidate_mape >= 0.0001) AS folds_held, count(*) AS folds,
  count(*) FILTER (baseline_mape - candidate_mape >= 0.0001) > count(*) / 2.0 AS allowed
FROM (SELECT candidate, fold, avg(baseline_mape) AS baseline_mape, avg(candidate_mape) AS candidate_mape FROM gains GROUP BY 1, 2) GROUP BY 1
""")
def residual_gate_query(spark, sf):
    gains = fold_gains(named(spark, sf), NAMES[1:], "last_value").groupBy("candidate", "fold").agg(
        (F.avg("baseline_mape") - F.avg("candidate_mape")).alias("gain"))
    return residual_gate(gains, ["candidate"], require_all=False).select(
        "candidate", sig("minimum_fold_gain"), "folds_held", "folds", "allowed")


WEIGHT = "CASE WHEN fold LIKE 'recent_%' THEN 3.0 ELSE 1.0 END"
PREFIX = {"recent_": 3.0}


@query("gram", "WITH " + named_sql(("last_value", "mean_8", "daily")) + f""",
s AS (SELECT *, {WEIGHT} / pow(greatest(abs(y_true), 1e-6), 2) AS s FROM named WHERE y_true IS NOT NULL AND last_value IS NOT NULL
  AND mean_8 IS NOT NULL AND daily IS NOT NULL)
SELECT field, horizon, fold, count(*) AS n, {sig_sql("sum(s * last_value * y_true)")} AS b_0, {sig_sql("sum(s * mean_8 * y_true)")} AS b_1,
  {sig_sql("sum(s * daily * y_true)")} AS b_2, {sig_sql("sum(s * last_value * last_value)")} AS g_0_0,
  {sig_sql("sum(s * last_value * mean_8)")} AS g_0_1, {sig_sql("sum(s * last_value * daily)")} AS g_0_2,
  {sig_sql("sum(s * mean_8 * mean_8)")} AS g_1_1, {sig_sql("sum(s * mean_8 * daily)")} AS g_1_2, {sig_sql("sum(s * daily * daily)")} AS g_2_2
FROM s GROUP BY 1, 2, 3
""")
def gram_query(spark, sf):
    out = gram(named(spark, sf, ("last_value", "mean_8", "daily")), ("last_value", "mean_8", "daily"), prefixes=PREFIX)
    return out.select("field", "horizon", "fold", "n", *sigs([c for c in out.columns if c[:2] in ("b_", "g_")]))


# with two models the simplex fit has the closed form used here
@query("oof_weights_two", "WITH " + named_sql(("last_value", "mean_8")) + f""",
s AS (SELECT *, {WEIGHT} / pow(greatest(abs(y_true), 1e-6), 2) AS s FROM named WHERE y_true IS NOT NULL AND last_value IS NOT NULL AND mean_8 IS NOT NULL),
f AS (SELECT field, horizon, fold, sum(s * (mean_8 - last_value) * (y_true - last_value)) AS num, sum(s * (mean_8 - last_value) * (mean_8 - last_value)) AS den
  FROM s GROUP BY 1, 2, 3),
h AS (SELECT DISTINCT fold AS held FROM f UNION ALL SELECT NULL),
t AS (SELECT field, horizon, held, sum(num) / sum(den) AS w FROM f JOIN h ON held IS NULL OR fold <> held GROUP BY 1, 2, 3)
SELECT field, horizon, held, round(greatest(0, least(1, w)), 6) AS weight_mean_8 FROM t
""")
def oof_weights_two(spark, sf):
    models = ("last_value", "mean_8")
    out = oof_weights(gram(named(spark, sf, models), models, prefixes=PREFIX), models)
    return out.select("field", "horizon", "held", F.round(F.get("weights", F.lit(1)), 6).alias("weight_mean_8"))


# three members of fifteen may be used; the optimum of three lies inside the triangle or on one of its sides
@query("oof_weights_masked", "WITH " + named_sql(("last_value", "mean_8", "daily")) + f""",
s AS (SELECT *, {WEIGHT} / pow(greatest(abs(y_true), 1e-6), 2) AS s, mean_8 - last_value AS p, daily - last_value AS q, y_true - last_value AS r
  FROM named WHERE y_true IS NOT NULL AND last_value IS NOT NULL AND mean_8 IS NOT NULL AND daily IS NOT NULL),
f AS (SELECT field, horizon, fold, count(*) AS n, sum(s*p*p) AS pp, sum(s*p*q) AS pq, sum(s*q*q) AS qq, sum(s*p*r) AS pr, sum(s*q*r) AS qr, sum(s*r*r) AS rr
  FROM s GROUP BY 1, 2, 3),
h AS (SELECT DISTINCT fold AS held FROM f UNION ALL SELECT NULL),
t AS (SELECT field, horizon, held, CAST(sum(n) AS BIGINT) AS samples, sum(pp) AS pp, sum(pq) AS pq, sum(qq) AS qq, sum(pr) AS pr, sum(qr) AS qr, sum(rr) AS rr
  FROM f JOIN h ON held IS NULL OR fold <> held GROUP BY 1, 2, 3),
c AS (SELECT *, (pr*qq - qr*pq) / (pp*qq - pq*pq) AS a, (qr*pp - pr*pq) / (pp*qq - pq*pq) AS b FROM t UNION ALL
  SELECT *, greatest(0, least(1, pr/pp)), 0.0 FROM t UNION ALL SELECT *, 0.0, greatest(0, least(1, qr/qq)) FROM t UNION ALL
  SELECT *, greatest(0, least(1, (pr-pq-qr+qq)/(pp-2*pq+qq))), 1 - greatest(0, least(1, (pr-pq-qr+qq)/(pp-2*pq+qq))) FROM t),
l AS (SELECT *, rr - 2*a*pr - 2*b*qr + a*a*pp + 2*a*b*pq + b*b*qq AS loss FROM c WHERE a >= -1e-12 AND b >= -1e-12 AND a + b <= 1 + 1e-12)
SELECT field, horizon, held, samples, round(arg_min(a, loss), 5) + 0.0 AS weight_mean_8, round(arg_min(b, loss), 5) + 0.0 AS weight_daily, true AS only_allowed,
  round(min(loss) / arg_min(rr, loss), 6) AS loss_ratio
FROM l GROUP BY 1, 2, 3, 4
""")
def oof_weights_masked(spark, sf):
    """Fifteen candidates of which three may be used; a rejected one is empty on every other slot."""
    members = ("last_value", "mean_8", "daily")
    wide = named(spark, sf, members)
    wide = wide.withColumn("holes", F.when(F.col("pos") % 2 == 0, F.col("mean_8"))).select(
        "*", *[(F.col("last_value") + i).alias(f"extra_{i}") for i in range(11)])
    models = ("holes", *members, *[f"extra_{i}" for i in range(11)])
    mask = [m in members for m in models]
    masks = wide.select("field", "horizon").distinct().withColumn("mask", F.array(*[F.lit(m) for m in mask]))
    sums = gram(wide, models, prefixes=PREFIX, masks=masks)
    out = oof_weights(sums, models, masks=masks)
    folds = sums.select("field", "horizon", "fold", "b_1", "b_2", "b_3", *[f"g_{i}_{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j])
    y2 = wide.where("y_true IS NOT NULL AND last_value IS NOT NULL AND mean_8 IS NOT NULL AND daily IS NOT NULL").withColumn(
        "_s", fold_weight(F.col("fold"), PREFIX) / F.pow(F.greatest(F.abs("y_true"), F.lit(1e-6)), F.lit(2.0))).groupBy(
        "field", "horizon", "fold").agg(F.sum(F.col("_s") * F.col("y_true") * F.col("y_true")).alias("yy"))
    parts = out.join(folds.join(y2, ["field", "horizon", "fold"]), ["field", "horizon"]).where("held IS NULL OR held <> fold")
    names = [c for c in folds.columns if c[:2] in ("b_", "g_")] + ["yy"]
    total = parts.groupBy("field", "horizon", "held").agg(
        F.first("weights").alias("w"), F.first("samples").alias("samples"), *[F.sum(c).alias(c) for c in names])
    w = lambda i: F.get("w", F.lit(i))
    quad = sum((w(i) * w(j) * F.col(f"g_{min(i, j)}_{max(i, j)}") for i in (1, 2, 3) for j in (1, 2, 3)), F.lit(0.0))
    loss = F.col("yy") - 2 * sum((w(i) * F.col(f"b_{i}") for i in (1, 2, 3)), F.lit(0.0)) + quad
    alone = F.col("yy") - 2 * F.col("b_1") + F.col("g_1_1")
    rest = F.aggregate(F.slice("w", 5, 11), F.lit(0.0), lambda a, x: a + x) + w(0)
    return total.select(
        "field", "horizon", "held", "samples", F.round(w(2), 5).alias("weight_mean_8"), F.round(w(3), 5).alias("weight_daily"),
        (rest == 0).alias("only_allowed"), F.round(loss / alone, 6).alias("loss_ratio"))


@query("oof_blend")
def oof_blend(spark, sf):
    wide = named(spark, sf)
    weights = oof_weights(gram(wide, NAMES, prefixes=PREFIX), NAMES)
    blended = apply_weights(wide, weights, NAMES, "blend")
    return blend_report(blended, "blend", ["field", "horizon", "fold"])


def _regimes(spark, sf):
    from slotwise.operators.states import add_regime

    states = add_regime(hourly_grid(spark, sf), online_above=20.0, stable_within=10.0).drop("value")
    return named(spark, sf).join(states, ["series_id", "field", "pos"])


@query("regime_blend")
def regime_blend(spark, sf):
    wide = _regimes(spark, sf)
    weights = oof_weights(gram(wide, NAMES, ("field", "horizon", "fold", "regime"), PREFIX), NAMES, regime="regime",
                          minimum_samples=24, shrinkage=48.0)
    blended = apply_weights(wide, weights, NAMES, "blend", regime="regime")
    return blend_report(blended, "blend", ["field", "horizon", "fold", "regime"])


WIN_SQL = f""",
ok AS (SELECT * FROM long WHERE y_true IS NOT NULL),
per AS (SELECT field, horizon, model, fold, sum({WEIGHT} * {FLOORED}) AS loss, sum({WEIGHT}) AS w, count(*) AS n, avg({FLOORED}) AS plain
  FROM ok GROUP BY 1, 2, 3, 4),
h AS (SELECT DISTINCT fold AS held FROM per UNION ALL SELECT NULL),
tot AS (SELECT field, horizon, model, held, sum(loss) / sum(w) AS loss, CAST(sum(n) AS BIGINT) AS n FROM per JOIN h ON held IS NULL OR fold <> held GROUP BY 1, 2, 3, 4),
pick AS (SELECT field, horizon, held, n, model AS winner, loss FROM (
  SELECT *, row_number() OVER (PARTITION BY field, horizon, held ORDER BY round(loss, 12), list_position(['last_value', 'mean_8', 'trend_8', 'daily'], model)) AS rk FROM tot) WHERE rk = 1)
"""


@query("hard_winner", "WITH " + named_sql() + WIN_SQL + f"""
SELECT p.field, p.horizon, p.held, p.winner, p.n AS selection_samples, {sig_sql("p.loss")} AS selection_mape, q.n AS held_out_samples,
  {sig_sql("q.plain")} AS held_out_mape
FROM pick p LEFT JOIN per q ON q.field = p.field AND q.horizon = p.horizon AND q.fold = p.held AND q.model = p.winner
""")
def hard_winner_query(spark, sf):
    return hard_winner(named(spark, sf), NAMES, prefixes=PREFIX).select(
        "field", "horizon", "held", "winner", "selection_samples", sig("selection_mape"), "held_out_samples", sig("held_out_mape"))


@query("winner_routing", "WITH " + named_sql() + WIN_SQL + f"""
SELECT l.series_id, l.field, l.fold, l.pos, l.horizon, {sig_sql("l.y_pred")} AS routed
FROM long l JOIN pick p ON p.field = l.field AND p.horizon = l.horizon AND p.held = l.fold AND p.winner = l.model
""")
def winner_routing(spark, sf):
    wide = named(spark, sf)
    return apply_winner(wide, hard_winner(wide, NAMES, prefixes=PREFIX), NAMES, "routed").select(
        "series_id", "field", "fold", "pos", "horizon", sig("routed"))


def _timed(spark, sf, name="mean_8"):
    return named(spark, sf, (name,)).withColumnRenamed(name, "y_pred").withColumn("target_ts", slot_start("target_pos", HOUR))


def _factor_sql(keys: str, source: str) -> str:
    return f"""
ru AS (SELECT {keys}, CAST(floor(hour(make_timestamp(target_pos * 3600000000)) / 4) AS INTEGER) AS hour_bin, y_true / y_pred AS ratio,
  abs(y_pred) / greatest(abs(y_true), 1e-6) AS weight FROM {source} WHERE {OK} AND abs(y_pred) > 1e-6),
rw AS (SELECT *, sum(weight) OVER (PARTITION BY {keys}, hour_bin ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
  sum(weight) OVER (PARTITION BY {keys}, hour_bin) AS total, count(*) OVER (PARTITION BY {keys}, hour_bin) AS samples FROM ru),
factors AS (SELECT {keys}, hour_bin, samples, min(ratio) AS raw,
  least(greatest(1 + samples / (samples + 48.0) * (min(ratio) - 1), 0.9), 1.1) AS factor
  FROM rw WHERE cum >= 0.5 * total AND samples >= 24 GROUP BY {keys}, hour_bin, samples)"""


@query("hour_calibration", "WITH " + named_sql(("mean_8",)) + "," + _factor_sql("field, horizon", "long") + f"""
SELECT field, horizon, hour_bin, samples, {sig_sql("raw")} AS raw_factor, {sig_sql("factor")} AS factor FROM factors
""")
def hour_calibration(spark, sf):
    return hour_factors(_timed(spark, sf)).select("field", "horizon", "hour_bin", "samples", *sigs(["raw_factor", "factor"]))


@query("apply_calibration", "WITH " + named_sql(("mean_8",)) + "," + _factor_sql("field, horizon", "long") + f"""
SELECT l.series_id, l.field, l.fold, l.pos, l.horizon, {sig_sql("l.y_pred * coalesce(f.factor, 1)")} AS calibrated
FROM long l LEFT JOIN factors f ON f.field = l.field AND f.horizon = l.horizon
  AND f.hour_bin = CAST(floor(hour(make_timestamp(l.target_pos * 3600000000)) / 4) AS INTEGER)
""")
def apply_calibration(spark, sf):
    rows = _timed(spark, sf)
    return calibrate(rows, hour_factors(rows)).select("series_id", "field", "fold", "pos", "horizon", sig("calibrated"))


@query("cross_calibration", "WITH " + named_sql(("mean_8",)) + """,
training AS (SELECT l.*, h.held FROM long l, (SELECT DISTINCT fold AS held FROM long) h WHERE l.fold <> h.held),
""" + _factor_sql("held, field, horizon", "training") + f"""
SELECT l.series_id, l.field, l.fold, l.pos, l.horizon, {sig_sql("l.y_pred * coalesce(f.factor, 1)")} AS calibrated
FROM long l LEFT JOIN factors f ON f.held = l.fold AND f.field = l.field AND f.horizon = l.horizon
  AND f.hour_bin = CAST(floor(hour(make_timestamp(l.target_pos * 3600000000)) / 4) AS INTEGER)
""")
def cross_calibration(spark, sf):
    return cross_fit_calibration(_timed(spark, sf)).select("series_id", "field", "fold", "pos", "horizon", sig("calibrated"))


@query("calibration_gate", "WITH " + named_sql(("mean_8",)) + """,
training AS (SELECT l.*, h.held FROM long l, (SELECT DISTINCT fold AS held FROM long) h WHERE l.fold <> h.held),
""" + _factor_sql("held, field, horizon", "training") + f""",
cal AS (SELECT l.field, l.horizon, l.fold, l.y_true, l.y_pred AS base, l.y_pred * coalesce(f.factor, 1) AS y_pred
FROM long l LEFT JOIN factors f ON f.held = l.fold AND f.field = l.field AND f.horizon = l.horizon
  AND f.hour_bin = CAST(floor(hour(make_timestamp(l.target_pos * 3600000000)) / 4) AS INTEGER) WHERE y_true IS NOT NULL),
g AS (SELECT field, horizon, fold, avg(abs(base - y_true) / greatest(abs(y_true), 1e-6)) - avg({FLOORED}) AS gain FROM cal GROUP BY 1, 2, 3)
SELECT field, horizon, {sig_sql("avg(gain)")} AS mean_gain, {sig_sql("min(gain)")} AS worst_gain,
  avg(gain) > 0 AND count(*) FILTER (gain >= 0) >= least(3, count(*)) AND min(gain) >= -0.005 AS passed
FROM g GROUP BY 1, 2
""")
def calibration_gate(spark, sf):
    rows = cross_fit_calibration(_timed(spark, sf))
    return column_gate(rows, ["calibrated"], "y_pred", minimum_non_degraded_folds=3, maximum_worst_degradation=0.005).select(
        "field", "horizon", *sigs(["mean_gain", "worst_gain"]), "passed")


@query("fusion")
def fusion(spark, sf):
    rows, _ = fuse(_regimes(spark, sf), NAMES, prefixes=PREFIX, regime="regime", minimum_folds=3, worst=0.05,
                   minimum_samples=24, shrinkage=48.0)
    return blend_report(rows, "fused", ["field", "horizon", "source"])


@query("fusion_models")
def fusion_models(spark, sf):
    _, summary = fuse(named(spark, sf), NAMES, prefixes=PREFIX, minimum_folds=3, worst=0.05, hard_router=False)
    return used_models(summary, NAMES).withColumn("models", F.concat_ws(",", "models"))


@query("oracle_pick", "WITH " + named_sql() + f""",
e AS (SELECT *, {FLOORED} AS err, list_position(['last_value', 'mean_8', 'trend_8', 'daily'], model) AS i FROM long WHERE y_true IS NOT NULL)
SELECT series_id, field, fold, pos, horizon, {sig_sql("arg_min(y_pred, {'e': err, 'i': i})")} AS best FROM e GROUP BY 1, 2, 3, 4, 5
""")
def oracle_pick(spark, sf):
    from slotwise.plans.routing import oracle

    return oracle(named(spark, sf).where("y_true IS NOT NULL"), NAMES).select("series_id", "field", "fold", "pos", "horizon", sig("best"))


@query("fold_subset", "WITH " + tidy_sql(("last_value",)) + """,
k AS (SELECT fold, row_number() OVER (ORDER BY fold) - 1 AS i FROM (SELECT DISTINCT fold FROM tidy))
SELECT v || '_' || CAST(fold AS VARCHAR) AS fold, v AS validation_type, count(*) AS rows
FROM (SELECT 'recent' AS v, fold FROM k WHERE i IN (0, 1, 3) UNION ALL SELECT 'cross_month', fold FROM k WHERE i IN (0, 3)) JOIN tidy USING (fold)
GROUP BY 1, 2
""")
def fold_subset_query(spark, sf):
    tidy = backtest(spark, sf, ("last_value",))
    return combine_windows(tidy, tidy, 3, 2).groupBy("fold", "validation_type").agg(F.count(F.lit(1)).alias("rows"))


@query("fold_coverage", "WITH " + named_sql(("last_value",)) + """,
e(fold) AS (VALUES ('recent_0'), ('recent_1'), ('recent_2'), ('recent_3'), ('cross_month_0'), ('cross_month_1'), ('cross_month_2')),
a AS (SELECT DISTINCT fold FROM named)
SELECT fold, 'missing' AS problem FROM e WHERE fold NOT IN (SELECT fold FROM a)
UNION ALL SELECT fold, 'unexpected' FROM a WHERE fold NOT IN (SELECT fold FROM e)
""")
def fold_coverage_query(spark, sf):
    return fold_coverage(named(spark, sf, ("last_value",)), 4, 3)


@query("candidate_order", "WITH " + named_sql() + f""",
f AS (SELECT model, validation_type, fold, avg({FLOORED}) AS m FROM long GROUP BY 1, 2, 3),
c AS (SELECT model, avg(m) FILTER (validation_type = 'recent') AS r, max(m) FILTER (validation_type = 'recent') AS rw,
  avg(m) FILTER (validation_type = 'cross_month') AS x, max(m) FILTER (validation_type = 'cross_month') AS xw FROM f GROUP BY 1),
o AS (SELECT model, 0.8 * avg(m) + 0.2 * max(m) AS objective FROM f GROUP BY 1)
SELECT model, {sig_sql("r")} AS recent_mape, {sig_sql("rw")} AS recent_worst_mape, {sig_sql("x")} AS cross_month_mape,
  {sig_sql("0.55 * r + 0.1 * rw + 0.3 * x + 0.05 * xw")} AS selection_metric, {sig_sql("objective")} AS objective FROM c JOIN o USING (model)
""")
def candidate_order(spark, sf):
    long = melt(named(spark, sf), NAMES)
    return order_candidates(long).join(search_objective(long), "model").select(
        "model", *sigs(["recent_mape", "recent_worst_mape", "cross_month_mape", "selection_metric", "objective"]))


@query("shortlist", "WITH " + named_sql(("last_value", "mean_8", "trend_8", "daily", "median_8", "damped_5")) + f""",
fm AS (SELECT model, fold, avg({FLOORED}) AS m FROM long GROUP BY 1, 2),
t AS (SELECT model, row_number() OVER (ORDER BY model) - 1 AS number, 0.8 * avg(m) + 0.2 * max(m) AS value,
  CASE WHEN model IN ('daily', 'trend_8') THEN 'gas' ELSE 'direct' END AS p,
  CASE WHEN model LIKE 'm%' THEN 'window' ELSE 'other' END AS s FROM fm GROUP BY 1),
tm AS (SELECT model, field, avg({FLOORED}) AS m FROM long GROUP BY 1, 2),
cm AS (SELECT model, field, horizon, avg({FLOORED}) AS m FROM long GROUP BY 1, 2, 3),
best AS (SELECT * FROM t ORDER BY value, number LIMIT 1),
t1 AS (SELECT field, arg_min(number, {{'m': m, 'v': value, 'n': number}}) AS number FROM tm JOIN t USING (model) GROUP BY 1),
wins AS (SELECT number, count(*) AS w FROM (SELECT field, horizon, arg_min(number, {{'m': m, 'v': value, 'n': number}}) AS number
  FROM cm JOIN t USING (model) GROUP BY 1, 2) GROUP BY 1),
tiers AS (SELECT number, 0 AS tier, 0.0::DOUBLE AS a, '' AS b FROM best
  UNION ALL SELECT t1.number, 1, -tm.m, t1.field FROM t1 JOIN tm ON tm.field = t1.field AND tm.model = (SELECT model FROM best)
  UNION ALL (SELECT number, 2, 0.0, '' FROM t WHERE p = 'gas' ORDER BY value, number LIMIT 1)
  UNION ALL SELECT number, 3, row_number() OVER (ORDER BY w DESC, value, number), '' FROM wins JOIN t USING (number)
  UNION ALL SELECT arg_min(number, {{'v': value, 'n': number}}), 4, min(value), '' FROM t GROUP BY p, s
  UNION ALL SELECT number, 5, value, '' FROM t),
first AS (SELECT number, min({{'t': tier, 'a': a, 'b': b}}) AS place FROM tiers GROUP BY 1),
chosen AS (SELECT number, place FROM first ORDER BY place, number LIMIT 4)
SELECT CAST(number AS INTEGER) AS number, {sig_sql("value")} AS value, CAST(place.t AS INTEGER) AS tier FROM chosen JOIN t USING (number)
""")
def shortlist(spark, sf):
    names = ("last_value", "mean_8", "trend_8", "daily", "median_8", "damped_5")
    trials = trial_table(melt(named(spark, sf, names), names), {"daily": "gas", "trend_8": "gas", **{n: "direct" for n in names if n not in ("daily", "trend_8")}},
                         {n: "window" if n.startswith("m") else "other" for n in names})
    return diverse_shortlist(trials, 4, ["gas"]).select("number", sig("value"), "tier")


@query("join_candidates", "WITH " + named_sql(("last_value", "daily")) + f"""
SELECT validation_type, field, {sig_sql("avg(abs(last_value - y_true) / greatest(abs(y_true), 1e-6))")} AS incumbent_mape,
  {sig_sql("avg(abs(daily - y_true) / greatest(abs(y_true), 1e-6))")} AS challenger_mape, count(*) AS rows
FROM named WHERE y_true IS NOT NULL GROUP BY 1, 2
""")
def join_candidates_query(spark, sf):
    wide = named(spark, sf, ("last_value", "daily"))
    keys = ["series_id", "field", "fold", "validation_type", "pos", "horizon"]
    parts = {m: wide.select(*keys, "y_true", F.col(m).alias("y_pred")) for m in ("last_value", "daily")}
    joined = join_candidates(parts, keys)
    return compare_challenger(joined, "last_value", "daily", ["validation_type", "field"]).select(
        "validation_type", "field", *sigs(["incumbent_mape", "challenger_mape"]), "rows")


@query("method_scores", "WITH " + named_sql() + f""",
c AS (SELECT model, validation_type, field, horizon, avg({FLOORED}) AS m, count(*) AS n FROM long WHERE {OK} GROUP BY 1, 2, 3, 4)
SELECT model, validation_type, {sig_sql("100 * (1 - avg(m))")} AS score, CAST(sum(n) AS BIGINT) AS rows FROM c GROUP BY 1, 2
""")
def method_scores_query(spark, sf):
    return method_scores(melt(named(spark, sf), NAMES), ["model", "validation_type"]).select(
        "model", "validation_type", sig("score"), "rows")


@query("share_blends", "WITH " + named_sql(("last_value", "daily")) + f"""
SELECT share, {sig_sql("avg(abs((1 - share) * last_value + share * daily - y_true) / greatest(abs(y_true), 1e-6))")} AS mape
FROM named, unnest([0.1, 0.2, 0.3, 0.5]::DOUBLE[]) AS x(share) WHERE y_true IS NOT NULL GROUP BY 1
""")
def share_blends(spark, sf):
    from slotwise.plans.routing import blend_shares

    out = blend_shares(named(spark, sf, ("last_value", "daily")), "last_value", "daily", (0.1, 0.2, 0.3, 0.5))
    from slotwise.functions.numbers import ape_floor

    return out.where("y_true IS NOT NULL").groupBy("share").agg(sig(F.avg(ape_floor("y_true", "y_pred")), "mape"))

