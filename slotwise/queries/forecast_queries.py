"""Baseline forecasts from every slot, folds, tidy back-test, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions.slots import slot_start
from slotwise.operators.grid import resample
from slotwise.plans.forecast import Model, forecast, melt, model, pivot_forecast, unpivot_forecast, weighted_blend
from slotwise.plans.metrics import (
    alignment, best_by, coverage, error_groups, floored_means, fold_statistics, horizon_gain, largest_errors, score,
    summarize, tail_errors,
)
from slotwise.plans.splits import MonthStart, Recent, Rolling, add_folds, fold_table, split_integrity
from slotwise.session import cut_lineage
from slotwise.queries.base import BY_FIELD, DAY, FIELDS, GRID_SQL, HOUR, hourly_grid, query, sig, sig_sql, sigs, table

HORIZONS = tuple(range(1, 9))
LAST = Model("last_value", "last_value")
MEAN = Model("mean_8", "window_mean", window=8)
MEDIAN = Model("median_8", "window_median", window=8)
TREND = Model("trend_8", "linear_trend", window=8)
DAMPED = Model("damped_5", "damped_trend", window=5, damping=0.85)
DAILY = Model("daily", "seasonal_naive", period=24)
SEASONS = Model("season_median", "seasonal_median", period=24, seasons=3)
ENSEMBLE = model({"name": "ensemble", "type": "weighted_ensemble", "clip_min": 0.0, "members": [
    {"name": "last_value", "type": "last_value", "weight": 2.0},
    {"name": "trend_8", "type": "linear_trend", "window": 8, "weight": 1.0},
    {"name": "daily", "type": "seasonal_naive", "period_steps": 24, "weight": 1.0}]})

# per-slot history in SQL: window statistics over readings, then the last one at or before the slot
STATE_SQL = GRID_SQL + f""",
obs AS (SELECT series_id, field, pos, value, row_number() OVER ({BY_FIELD}) AS k FROM grid WHERE value IS NOT NULL),
st AS (SELECT *, avg(value) OVER w8 AS mean8, quantile_cont(value, 0.5) OVER w8 AS median8,
  CASE WHEN k > 1 THEN avg(value) OVER w8 + regr_slope(value, k) OVER w8 * (k - avg(k) OVER w8) END AS fit8,
  CASE WHEN k > 1 THEN regr_slope(value, k) OVER w8 END AS slope8, CASE WHEN k > 1 THEN regr_slope(value, k) OVER w5 END AS slope5
  FROM obs WINDOW w8 AS ({BY_FIELD} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW),
                  w5 AS ({BY_FIELD} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
h0 AS (SELECT g.series_id, g.field, g.pos, g.value AS raw,
  last_value(CASE WHEN s.k IS NOT NULL THEN {{'last': s.value, 'mean8': mean8, 'median8': median8, 'fit8': fit8,
    'slope8': slope8, 'slope5': slope5}} END IGNORE NULLS) OVER (PARTITION BY g.series_id, g.field ORDER BY g.pos) AS s
  FROM grid g LEFT JOIN st s USING (series_id, field, pos)),
hist AS (SELECT series_id, field, pos, raw, s.last AS last, s.mean8 AS mean8, s.median8 AS median8, s.fit8 AS fit8,
  s.slope8 AS slope8, s.slope5 AS slope5 FROM h0 WHERE s IS NOT NULL),
ask AS (SELECT hist.*, x.h AS horizon, pos + x.h AS target_pos FROM hist, unnest(generate_series(1, 8)) AS x(h))
"""
SEASON_JOIN = """
  LEFT JOIN grid d1 ON d1.series_id = a.series_id AND d1.field = a.field AND d1.pos = a.target_pos - 24
  LEFT JOIN grid d2 ON d2.series_id = a.series_id AND d2.field = a.field AND d2.pos = a.target_pos - 48
  LEFT JOIN grid d3 ON d3.series_id = a.series_id AND d3.field = a.field AND d3.pos = a.target_pos - 72
"""
MODEL_SQL = {
    "last_value": "last", "mean_8": "mean8", "median_8": "median8",
    "trend_8": "coalesce(fit8 + slope8 * horizon, last)",
    "damped_5": "coalesce(last + slope5 * (1 - pow(0.85, horizon)) / 0.15, last)",
    "daily": "coalesce(d1.value, last)",
    "season_median": "coalesce(list_median([d1.value, d2.value, d3.value]), last)",
}
MODEL_SQL["ensemble"] = f"greatest(0, 0.5 * last + 0.25 * ({MODEL_SQL['trend_8']}) + 0.25 * ({MODEL_SQL['daily']}))"
MODELS = {m.name: m for m in (LAST, MEAN, MEDIAN, TREND, DAMPED, DAILY, SEASONS, ENSEMBLE)}
QUERY_NAMES = {"last_value": "fc_last", "mean_8": "fc_mean", "median_8": "fc_median", "trend_8": "fc_trend",
               "damped_5": "fc_damped", "daily": "fc_seasonal", "season_median": "fc_season_median", "ensemble": "fc_ensemble"}


def _register_forecast(name: str, key: str) -> None:
    seasonal = SEASON_JOIN if "d1" in MODEL_SQL[name] else ""

    @query(key, "WITH " + STATE_SQL + f"""
SELECT a.series_id, a.field, a.pos, a.horizon, {sig_sql(MODEL_SQL[name])} AS y_pred FROM ask a {seasonal}
""")
    def run(spark, sf):
        out = forecast(hourly_grid(spark, sf), [MODELS[name]], HORIZONS, block=256)
        return out.select("series_id", "field", "pos", "horizon", sig(name, "y_pred"))


for _name, _key in QUERY_NAMES.items():
    _register_forecast(_name, _key)

# ---- folds -------------------------------------------------------------------------------
EXPANDING = Rolling(4, 360, 48, 48)
SITE_SPAN = GRID_SQL + ", ends AS (SELECT series_id, lo AS first_pos, hi AS last_pos FROM span)"
FOLD_SQL = SITE_SPAN + """,
folds AS (SELECT series_id, f AS fold, first_pos AS train_start, first_pos + 360 + 48 * f - 1 AS train_end,
  first_pos + 360 + 48 * f AS valid_start, first_pos + 360 + 48 * f + 47 AS valid_end FROM ends, unnest(generate_series(0, 3)) AS x(f))
"""


@query("splits_expanding", "WITH " + FOLD_SQL + "SELECT series_id, CAST(fold AS INTEGER) AS fold, train_start, train_end, valid_start, valid_end FROM folds")
def splits_expanding(spark, sf):
    return fold_table(hourly_grid(spark, sf), EXPANDING, 8)


@query("splits_rolling", "WITH " + SITE_SPAN + """
SELECT series_id, CAST(f AS INTEGER) AS fold, greatest(first_pos, first_pos + 200 + 100 * f - 240) AS train_start,
  first_pos + 200 + 100 * f - 1 AS train_end, first_pos + 200 + 100 * f AS valid_start, first_pos + 200 + 100 * f + 95 AS valid_end
FROM ends, unnest(generate_series(0, 2)) AS x(f)
""")
def splits_rolling(spark, sf):
    return fold_table(hourly_grid(spark, sf), Rolling(3, 200, 96, 100, "rolling", 240), 8)


@query("splits_recent", "WITH " + SITE_SPAN + """
SELECT series_id, CAST(f AS INTEGER) AS fold, greatest(first_pos, last_pos - 8 - 48 + 1 - (4 - f) * 48 - 300) AS train_start,
  last_pos - 8 - 48 - (4 - f) * 48 AS train_end, last_pos - 8 - 48 + 1 - (4 - f) * 48 AS valid_start,
  last_pos - 8 - (4 - f) * 48 AS valid_end
FROM ends, unnest(generate_series(0, 4)) AS x(f)
""")
def splits_recent(spark, sf):
    return fold_table(hourly_grid(spark, sf), Recent(5, 48, 48, 300), 8)


MONTHS = ("1996-03", "1997-01", "1998-07")


@query("splits_month", """
WITH b AS (SELECT o_orderpriority AS series_id, CAST(ceil(epoch_us(o_orderdate) / 86400000000.0) AS BIGINT) AS pos FROM orders),
e AS (SELECT series_id, min(pos) AS first_pos FROM b GROUP BY 1)
SELECT series_id, CAST(f AS INTEGER) AS fold, first_pos AS train_start, s - 1 AS train_end, s AS valid_start, s + 13 AS valid_end
FROM e, (VALUES (0, date_diff('day', DATE '1970-01-01', DATE '1996-03-01')), (1, date_diff('day', DATE '1970-01-01', DATE '1997-01-01')),
                (2, date_diff('day', DATE '1970-01-01', DATE '1998-07-01'))) AS m(f, s)
""")
def splits_month(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.lit("value").alias("field"), F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("value"))
    bins = resample(rows, ["series_id", "field"], "ts", {"value": "mean"}, DAY)
    return fold_table(bins, MonthStart(MONTHS, 14), 8, step_seconds=DAY)


@query("split_integrity", "WITH " + SITE_SPAN + """,
f AS (SELECT series_id, first_pos + 200 + 60 * f - 1 AS te, first_pos + 200 + 60 * f AS vs FROM ends, unnest(generate_series(0, 2)) AS x(f)),
o AS (SELECT series_id, unnest(generate_series(vs, vs + 95)) AS pos FROM f),
c AS (SELECT series_id, pos, count(*) - 1 AS again FROM o GROUP BY 1, 2),
n AS (SELECT series_id, count(*) AS folds, count(*) FILTER (te >= vs) AS training_overlaps FROM f GROUP BY 1),
a AS (SELECT series_id, CAST(sum(again) AS BIGINT) AS overlapping_origins FROM c GROUP BY 1)
SELECT series_id, folds, training_overlaps, overlapping_origins,
  CASE WHEN overlapping_origins = 0 AND training_overlaps = 0 THEN 'passed' ELSE 'failed' END AS status FROM n JOIN a USING (series_id)
""")
def split_integrity_query(spark, sf):
    return split_integrity(fold_table(hourly_grid(spark, sf), Rolling(3, 200, 96, 60), 8))


# ---- tidy back-test: four expanding folds, five models -------------------------------------
TIDY_MODELS = ("last_value", "mean_8", "trend_8", "daily", "ensemble")


def backtest(spark, sf, models=TIDY_MODELS, rule=EXPANDING):
    grid = hourly_grid(spark, sf).withColumn("label", F.col("value"))
    folds = fold_table(grid, rule, max(HORIZONS))
    origins = add_folds(grid.select("series_id", "pos").distinct(), rule, folds)
    return forecast(grid, [MODELS[m] for m in models], HORIZONS, origins, label="label")


def tidy_sql(models=TIDY_MODELS) -> str:
    cells = ",\n  ".join(f"{MODEL_SQL[m]} AS {m}" for m in models)
    return STATE_SQL + """,
ends AS (SELECT series_id, lo AS first_pos, hi AS last_pos FROM span),
folds AS (SELECT series_id, f AS fold, first_pos AS train_start, first_pos + 360 + 48 * f - 1 AS train_end,
  first_pos + 360 + 48 * f AS valid_start, first_pos + 360 + 48 * f + 47 AS valid_end
  FROM ends, unnest(generate_series(0, 3)) AS x(f)),
""" + f"""tidy AS (
SELECT a.series_id, a.field, CAST(fo.fold AS INTEGER) AS fold, a.pos, CAST(a.horizon AS INTEGER) AS horizon, a.target_pos,
  y.value AS y_true, {cells}
FROM ask a JOIN folds fo ON fo.series_id = a.series_id AND a.pos BETWEEN fo.valid_start AND fo.valid_end
  LEFT JOIN grid y ON y.series_id = a.series_id AND y.field = a.field AND y.pos = a.target_pos {SEASON_JOIN})
"""


@query("backtest_tidy", "WITH " + tidy_sql() + "SELECT series_id, field, fold, pos, horizon, target_pos, "
       + ", ".join(f"{sig_sql(m)} AS {m}" for m in ("y_true", *TIDY_MODELS)) + " FROM tidy")
def backtest_tidy(spark, sf):
    return backtest(spark, sf).select(
        "series_id", "field", "fold", "pos", "horizon", "target_pos", *sigs(["y_true", *TIDY_MODELS]))


OK = "y_true IS NOT NULL AND y_pred IS NOT NULL"
APE = """CASE WHEN y_true = 0 THEN (CASE WHEN y_pred = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END)
  ELSE abs(y_true - y_pred) / abs(y_true) END"""
FLOORED = "abs(y_pred - y_true) / greatest(abs(y_true), 1e-6)"
BUNDLE_SQL = f"""count(*) FILTER ({OK}) AS sample_count, {sig_sql(f"avg({APE}) FILTER ({OK})")} AS mape,
  {sig_sql(f"1 - avg({APE}) FILTER ({OK})")} AS score_1_mape,
  count(*) FILTER ({OK} AND abs(y_true) <= 1e-6) AS near_zero_count, count(*) FILTER ({OK} AND y_true = 0) AS zero_count,
  {sig_sql(f"avg(abs(y_pred - y_true)) FILTER ({OK})")} AS mae,
  {sig_sql(f"sqrt(avg((y_pred - y_true) * (y_pred - y_true)) FILTER ({OK}))")} AS rmse,
  {sig_sql(f"avg(y_pred - y_true) FILTER ({OK})")} AS bias"""


def long_sql(models=TIDY_MODELS) -> str:
    parts = " UNION ALL ".join(
        f"SELECT series_id, field, fold, pos, horizon, target_pos, y_true, '{m}' AS model, {m} AS y_pred FROM tidy" for m in models)
    return tidy_sql(models) + f", long AS ({parts})\n"


def gs_sql(source: str, by: str = "", where: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}
  CASE WHEN GROUPING(field) = 0 AND GROUPING(horizon) = 0 THEN 'target_horizon' WHEN GROUPING(field) = 0 THEN 'target'
       WHEN GROUPING(horizon) = 0 THEN 'horizon' ELSE 'overall' END AS scope,
  CASE WHEN GROUPING(field) = 0 THEN field ELSE '__all__' END AS field,
  CASE WHEN GROUPING(horizon) = 0 THEN horizon ELSE -1 END AS horizon_steps,
  CASE WHEN GROUPING(horizon) = 0 THEN horizon * 60 ELSE -1 END AS horizon_minutes, {BUNDLE_SQL},
  CASE WHEN GROUPING(field) = 1 AND GROUPING(horizon) = 1 THEN count(*) FILTER (NOT ({OK})) ELSE 0 END AS excluded_non_finite_pairs
FROM {source} {where} GROUP BY GROUPING SETS (({lead}field, horizon), ({lead}field), ({lead}horizon), ({by}))"""


FLOATS = ("mape", "score_1_mape", "mae", "rmse", "bias")


def _sig_metrics(df):
    return df.select(*[sig(c) if c in FLOATS else c for c in df.columns])


@query("metrics_gs", "WITH " + long_sql(("last_value",)) + gs_sql("long"))
def metrics_gs(spark, sf):
    tidy = backtest(spark, sf, ("last_value",)).withColumnRenamed("last_value", "y_pred")
    return _sig_metrics(summarize(tidy, step_minutes=60))


@query("benchmark_metrics", "WITH " + long_sql() + gs_sql("long", "model"))
def benchmark_metrics(spark, sf):
    return _sig_metrics(summarize(melt(backtest(spark, sf), TIDY_MODELS), ["model"], step_minutes=60))


@query("benchmark_best", "WITH " + long_sql() + ", m AS (" + gs_sql("long", "model") + """)
SELECT * EXCLUDE (rk) FROM (
  SELECT scope, field, horizon_steps, model, mape, rmse, row_number() OVER (PARTITION BY scope, field, horizon_steps ORDER BY mape, rmse, model) AS rk
  FROM m WHERE scope IN ('target_horizon', 'target', 'overall')) WHERE rk = 1
""")
def benchmark_best(spark, sf):
    metrics = _sig_metrics(summarize(melt(backtest(spark, sf), TIDY_MODELS), ["model"], step_minutes=60))
    wanted = metrics.where(F.col("scope").isin("target_horizon", "target", "overall"))
    return best_by(wanted, ["scope", "field", "horizon_steps"]).select("scope", "field", "horizon_steps", "model", "mape", "rmse")


@query("score", "WITH " + long_sql() + f""",
c AS (SELECT model, field, horizon, 1 - avg({APE}) FILTER ({OK}) AS s FROM long GROUP BY 1, 2, 3)
SELECT model, {sig_sql("sum(s * w) / sum(w) * 100")} AS prediction_score, {sig_sql("sum(s * w) / sum(w) * 100 * 0.8 + 90 * 0.2")} AS final_score,
  count(*) AS cells, {sig_sql("max(s) FILTER (field = 'click' AND horizon = 1) * 100")} AS click_h1
FROM (SELECT *, CASE WHEN field = 'view' THEN 2.0 ELSE 1.0 END * CASE WHEN horizon = 1 THEN 3.0 ELSE 1.0 END AS w FROM c) GROUP BY 1
""")
def score_query(spark, sf):
    out = score(melt(backtest(spark, sf), TIDY_MODELS), ["model"], {"view": 2.0}, {1: 3.0}, percent=True,
                data_score=90.0, mix=(0.8, 0.2))
    return out.select("model", *sigs(["prediction_score", "final_score"]), F.size("components").cast("bigint").alias("cells"),
                      sig(F.col("components")["click_h1"], "click_h1"))


@query("fold_stats", "WITH " + long_sql(("daily",)) + ", m AS (" + gs_sql("long", "fold") + f""")
SELECT scope, field, horizon_steps, horizon_minutes, {sig_sql("avg(mape)")} AS mape_mean,
  {sig_sql("coalesce(stddev_samp(mape), 0)")} AS mape_std, max(mape) AS mape_worst, {sig_sql("avg(score_1_mape)")} AS score_mean,
  {sig_sql("coalesce(stddev_samp(score_1_mape), 0)")} AS score_std, min(score_1_mape) AS score_worst, {sig_sql("avg(mae)")} AS mae_mean,
  {sig_sql("avg(rmse)")} AS rmse_mean, {sig_sql("avg(bias)")} AS bias_mean, count(DISTINCT fold) AS folds
FROM m GROUP BY 1, 2, 3, 4
""")
def fold_stats(spark, sf):
    tidy = backtest(spark, sf, ("daily",)).withColumnRenamed("daily", "y_pred")
    out = fold_statistics(_sig_metrics(summarize(tidy, ["fold"], step_minutes=60)))
    keep = ("mape_worst", "score_worst")
    return out.select(*[sig(c) if c.endswith(("_mean", "_std")) and c not in keep else c for c in out.columns])


@query("horizon_gain", "WITH " + long_sql(("last_value", "mean_8")) + f""",
c AS (SELECT field, horizon AS horizon_steps, avg({APE}) FILTER ({OK} AND model = 'mean_8') AS mape,
  avg({APE}) FILTER ({OK} AND model = 'last_value') AS baseline_mape FROM long GROUP BY 1, 2)
SELECT field, horizon_steps, {sig_sql("mape")} AS mape, {sig_sql("baseline_mape")} AS baseline_mape,
  {sig_sql("baseline_mape - mape")} AS mape_gain, {sig_sql("(1 - mape) - (1 - baseline_mape)")} AS score_gain FROM c
""")
def horizon_gain_query(spark, sf):
    tidy = backtest(spark, sf, ("last_value", "mean_8"))
    out = horizon_gain(tidy.withColumnRenamed("mean_8", "y_pred"), tidy.withColumnRenamed("last_value", "y_pred"))
    return out.select("field", "horizon_steps", *sigs(["mape", "baseline_mape", "mape_gain", "score_gain"]))


@query("mape_grains", "WITH " + long_sql(("mean_8",)) + f"""
SELECT fold, field, horizon, {sig_sql(f"avg({FLOORED})")} AS mean_ape, count(*) AS rows
FROM long GROUP BY GROUPING SETS ((fold), (field), (field, horizon))
""")
def mape_grains(spark, sf):
    tidy = backtest(spark, sf, ("mean_8",)).withColumnRenamed("mean_8", "y_pred")
    return floored_means(tidy, [["fold"], ["field"], ["field", "horizon"]]).select(
        "fold", "field", "horizon", sig("mean_ape"), "rows")


@query("worst_errors", "WITH " + long_sql(("last_value",)) + f"""
SELECT series_id, field, fold, pos, horizon, {sig_sql("p")} AS absolute_percentage_error, {sig_sql("abs(y_true - y_pred)")} AS absolute_error
FROM (SELECT *, {APE} AS p FROM long)
ORDER BY CASE WHEN isnan(p) THEN NULL ELSE p END DESC NULLS LAST, abs(y_true - y_pred) DESC NULLS LAST, series_id, field, fold, pos, horizon LIMIT 50
""")
def worst_errors(spark, sf):
    tidy = backtest(spark, sf, ("last_value",)).withColumnRenamed("last_value", "y_pred")
    return largest_errors(tidy, 50, ["series_id", "field", "fold", "pos", "horizon"]).select(
        "series_id", "field", "fold", "pos", "horizon", *sigs(["absolute_percentage_error", "absolute_error"]))


@query("tail_errors", "WITH " + long_sql(("mean_8",)) + f""",
r AS (SELECT *, {FLOORED} AS ape FROM long), t AS (SELECT field, horizon, quantile_cont(ape, 0.95) AS threshold FROM r GROUP BY 1, 2)
SELECT series_id, field, fold, pos, horizon, {sig_sql("ape")} AS ape FROM r JOIN t USING (field, horizon) WHERE ape >= threshold
""")
def tail_errors_query(spark, sf):
    tidy = cut_lineage(backtest(spark, sf, ("mean_8",)).withColumnRenamed("mean_8", "y_pred"))
    return tail_errors(tidy).select("series_id", "field", "fold", "pos", "horizon", sig("ape"))


# ---- conditions carried with the predictions -------------------------------------------------
COND_SQL = f""",
flags AS (SELECT series_id, field, pos, value, value - lag(value) OVER ({BY_FIELD}) AS delta, coalesce(value > 20, false) AS onl,
  coalesce(lag(value) OVER ({BY_FIELD}) > 20, false) AS was FROM grid),
tagged AS (SELECT l.*, (onl AND NOT was)::INT AS startup, (NOT onl AND was)::INT AS shutdown, (value IS NULL)::INT AS missing,
  coalesce(delta > 10, false) AS up, coalesce(delta < -10, false) AS down, onl AND coalesce(abs(delta) <= 10, false) AS stable,
  make_timestamp(l.pos * 3600000000) AS origin, make_timestamp(l.target_pos * 3600000000) AS target_ts
  FROM long l JOIN flags USING (series_id, field, pos)),
cond AS (SELECT *, (month(origin) <> month(target_ts))::INT AS month_change, (isodow(origin) >= 6)::INT AS weekend,
  CASE WHEN startup = 1 THEN 'startup' WHEN shutdown = 1 THEN 'shutdown' WHEN up THEN 'ramp_up' WHEN down THEN 'ramp_down'
       WHEN stable THEN 'stable' WHEN missing > 0 THEN 'high_missing' WHEN month(origin) <> month(target_ts) THEN 'month_change'
       ELSE 'normal' END AS condition,
  CASE WHEN shutdown = 1 THEN 'shutdown' WHEN startup = 1 THEN 'startup' WHEN down THEN 'ramp_down' WHEN up THEN 'ramp_up'
       ELSE 'stable' END AS regime FROM tagged)
"""


def conditioned(spark, sf, name="mean_8"):
    from slotwise.operators.states import add_states, condition_label, regime_from_flags

    states = add_states(hourly_grid(spark, sf), online_above=20.0, stable_within=10.0, step_minutes=60).withColumn(
        "missing", F.col("value").isNull().cast("int")).drop("value")
    tidy = backtest(spark, sf, (name,)).withColumnRenamed(name, "y_pred")
    joined = cut_lineage(tidy.join(states, ["series_id", "field", "pos"])).withColumns({
        "origin": slot_start("pos", HOUR), "target_ts": slot_start("target_pos", HOUR)})
    return joined.withColumns({
        "month_change": (F.month("origin") != F.month("target_ts")).cast("int"),
        "weekend": (F.weekday("origin") >= 5).cast("int")}).withColumns({
            "condition": condition_label(F.col("missing"), F.lit(0), F.col("month_change")),
            "regime": regime_from_flags()})


@query("condition_metrics", "WITH " + long_sql(("mean_8",)) + COND_SQL + gs_sql("cond", "condition"))
def condition_metrics(spark, sf):
    return _sig_metrics(summarize(conditioned(spark, sf), ["condition"], step_minutes=60))


@query("coverage", "WITH " + long_sql(("mean_8",)) + COND_SQL + """
SELECT count(*) AS rows, list_sort(list(DISTINCT strftime(origin, '%Y-%m')))[1] AS first_month,
  CAST(len(list(DISTINCT strftime(origin, '%Y-%m'))) AS INTEGER) AS months,
  count(*) FILTER (weekend = 1) AS weekend_rows, count(*) FILTER (month_change = 1) AS month_change_rows,
  count(*) FILTER (missing > 0) AS high_missing_rows, CAST(sum(startup) AS BIGINT) AS startup_rows,
  CAST(sum(shutdown) AS BIGINT) AS shutdown_rows, count(*) FILTER (condition = 'ramp_up') AS ramp_up,
  count(*) FILTER (condition = 'high_missing') AS high_missing
FROM cond
""")
def coverage_query(spark, sf):
    out = coverage(conditioned(spark, sf))
    # the map lists the conditions that occur
    rows_of = lambda name: F.coalesce(F.col("conditions")[name], F.lit(0)).alias(name)
    return out.select(
        "rows", F.get("months", F.lit(0)).alias("first_month"), F.size("months").alias("months"), "weekend_rows", "month_change_rows",
        "high_missing_rows", "startup_rows", "shutdown_rows", rows_of("ramp_up"), rows_of("high_missing"))


@query("error_groups", "WITH " + long_sql(("mean_8",)) + COND_SQL + f"""
SELECT field, horizon, CAST(hour(origin) AS INTEGER) AS origin_hour, regime, missing > 0 AS has_missing, count(*) AS samples,
  {sig_sql(f"avg({FLOORED})")} AS mean_mape, {sig_sql(f"quantile_cont({FLOORED}, 0.95)")} AS p95_mape
FROM cond GROUP BY 1, 2, 3, 4, 5
""")
def error_groups_query(spark, sf):
    rows = conditioned(spark, sf).withColumns({"origin_hour": F.hour("origin"), "has_missing": F.col("missing") > 0})
    keys = ["field", "horizon", "origin_hour", "regime", "has_missing"]
    return error_groups(rows, keys).select(*keys, "samples", *sigs(["mean_mape", "p95_mape"]))


@query("alignment", "WITH " + long_sql(("last_value",)) + f""",
j AS (SELECT o AS off, g.value AS y_true, l.y_pred FROM long l, unnest([-2, -1, 0, 1, 2]) AS x(o)
  JOIN grid g ON g.series_id = l.series_id AND g.field = l.field AND g.pos = l.target_pos + o WHERE g.value IS NOT NULL)
SELECT off AS label_offset_steps, off * 60 AS label_offset_minutes, count(*) AS sample_count, {sig_sql(f"avg({APE})")} AS mape,
  {sig_sql(f"(1 - avg({APE})) * 100")} AS score_percent, count(*) FILTER (abs(y_true) <= 1e-6) AS near_zero_count,
  CASE WHEN off > 0 THEN 'red_future_diagnostic_only' WHEN off < 0 THEN 'amber_wrong_alignment' ELSE 'official_alignment' END AS risk,
  off = 0 AS used_for_model_selection
FROM j GROUP BY off
""")
def alignment_query(spark, sf):
    labels = hourly_grid(spark, sf).withColumnRenamed("value", "label")
    out = alignment(backtest(spark, sf, ("last_value",)), labels, step_minutes=60)
    return out.select("label_offset_steps", "label_offset_minutes", "sample_count", *sigs(["mape", "score_percent"]),
                      "near_zero_count", "risk", "used_for_model_selection")


@query("wide_forecast", "WITH " + STATE_SQL + """
SELECT a.series_id, a.pos, """ + ", ".join(
    sig_sql(f"max(CASE WHEN field = '{t}' AND horizon = {h} THEN mean8 END)") + f' AS "{t}_t+{60 * h}_pred"'
    for t in FIELDS for h in HORIZONS) + " FROM ask a GROUP BY 1, 2")
def wide_forecast(spark, sf):
    tidy = forecast(hourly_grid(spark, sf), [MEAN], HORIZONS).withColumnRenamed("mean_8", "y_pred")
    wide = pivot_forecast(tidy, FIELDS, HORIZONS, 60)
    return wide.select("series_id", "pos", *[sig(F.col(f"`{c}`"), c) for c in wide.columns[2:]])


@query("parse_forecast_columns", "WITH " + STATE_SQL + f"""
SELECT a.series_id, a.pos, field, CAST(horizon AS INTEGER) AS horizon, {sig_sql("last")} AS y_pred FROM ask a
UNION ALL
SELECT k.series_id, k.pos, t.field, CAST(x.h AS INTEGER), NULL
FROM (SELECT DISTINCT series_id, pos FROM ask) k, (SELECT DISTINCT field FROM grid) t, unnest(generate_series(1, 8)) AS x(h)
WHERE NOT EXISTS (SELECT 1 FROM ask b WHERE b.series_id = k.series_id AND b.pos = k.pos AND b.field = t.field)
""")
def parse_forecast_columns(spark, sf):
    tidy = forecast(hourly_grid(spark, sf), [LAST], HORIZONS).withColumnRenamed("last_value", "y_pred")
    wide = pivot_forecast(tidy, FIELDS, HORIZONS, 60)
    return unpivot_forecast(wide, 60).select("series_id", "pos", "field", "horizon", sig("y_pred"))


@query("blend_by_column", "WITH " + tidy_sql(("last_value", "mean_8", "daily")) + f""",
w AS (SELECT DISTINCT field, horizon, 0.5 + horizon / 16.0 AS wm, 0.3 AS wd, CASE WHEN horizon <= 4 THEN 1.0 ELSE 0.2 END AS wl FROM ask)
SELECT series_id, field, fold, pos, horizon, {sig_sql("(wl * last_value + wm * mean_8 + wd * daily) / (wl + wm + wd)")} AS y_pred
FROM tidy JOIN w USING (field, horizon)
""")
def blend_by_column(spark, sf):
    names = ("last_value", "mean_8", "daily")
    long = melt(backtest(spark, sf, names), names)
    cells = long.select("field", "horizon", "model").distinct()
    weight = (F.when(F.col("model") == "mean_8", 0.5 + F.col("horizon") / 16.0).when(F.col("model") == "daily", 0.3)
              .when(F.col("horizon") <= 4, 1.0).otherwise(0.2))
    keys = ["series_id", "field", "fold", "pos", "horizon"]
    return weighted_blend(long, cells.withColumn("weight", weight), keys, ["field", "horizon"]).select(*keys, sig("y_pred"))


@query("affine_blend", "WITH " + tidy_sql(("last_value", "mean_8")) + f"""
SELECT series_id, field, fold, pos, horizon, {sig_sql("greatest(0, 1.4 * mean_8 - 0.4 * last_value)")} AS y_pred FROM tidy
""")
def affine_blend(spark, sf):
    names = ("last_value", "mean_8")
    long = melt(backtest(spark, sf, names), names)
    weights = long.select("field", "model").distinct().withColumn(
        "weight", F.when(F.col("model") == "mean_8", 1.4).otherwise(-0.4))
    keys = ["series_id", "field", "fold", "pos", "horizon"]
    return weighted_blend(long, weights, keys, ["field"], signed=True).select(*keys, sig("y_pred"))

