"""Validation jobs, causality checks, review bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.operators.blocks import beside
from slotwise.operators.clean import clean, drop_empty_fields
from slotwise.operators.features import flag_features, rolling_features
from slotwise.operators.grid import densify, resample
from slotwise.plans.audit import delay_pairs, relation_summary
from slotwise.plans.causality import change_future, moved_rows, shifted_mean_gap
from slotwise.plans.contracts import aligned_sources, target_time_errors
from slotwise.plans.forecast import forecast, pivot_forecast
from slotwise.plans.metrics import summarize
from slotwise.plans.selection import combine_windows, join_candidates, method_scores
from slotwise.plans.splits import MonthStart, Recent, Rolling
from slotwise.plans.validate import local_scores, predict_tables, reachability, rolling_validation, scheme_gains, schemes
from slotwise.queries.audit_queries import PLANTED_SQL, REL, _relation, moments_sql, planted
from slotwise.queries.base import DAY, FIELDS, GRID_SQL, hourly_grid, query, sig, sig_sql, sigs, table
from slotwise.queries.clean_queries import CLEAN, CLEAN_SQL
from slotwise.queries.forecast_queries import (
    APE, HORIZONS, LAST, MEAN, MODELS, MONTHS, OK, STATE_SQL, TIDY_MODELS, TREND, alignment, backtest, long_sql,
    tidy_sql,
)
from slotwise.plans.forecast import melt


@query("flag_features", CLEAN_SQL + "SELECT series_id, pos, " + ", ".join(
    f"CAST(max(missing) FILTER (field = '{f}') AS INTEGER) AS feat_missing__{f}, CAST(max(missing_run) FILTER (field = '{f}') AS INTEGER) AS feat_missing_run__{f}, "
    f"CAST(max(outlier) FILTER (field = '{f}') AS INTEGER) AS feat_outlier__{f}, {sig_sql(f'''max(robust) FILTER (field = '{f}')''')} AS feat_robust__{f}" for f in FIELDS)
    + " FROM cleaned GROUP BY 1, 2")
def flag_features_query(spark, sf):
    out = flag_features(drop_empty_fields(clean(hourly_grid(spark, sf), CLEAN)), FIELDS)
    return out.select(*[sig(c) if c.startswith("feat_robust") else c for c in out.columns])


def _cut(grid):
    return grid.groupBy("series_id").agg((F.max("pos") - 200).alias("cut"))


@query("feature_causality", "WITH " + GRID_SQL + "SELECT count(*) AS slots, CAST(0 AS BIGINT) AS moved FROM grid")
def feature_causality(spark, sf):
    """Slots of the grid and feature rows before the cut that react to a changed future."""
    grid = hourly_grid(spark, sf)
    build = lambda g: rolling_features(clean(g, CLEAN), (8,), ("mean", "slope"), "robust").drop("value")
    moved = moved_rows(build, grid, _cut(grid)).agg(F.count(F.lit(1)).alias("moved"))
    return beside(grid.agg(F.count(F.lit(1)).alias("slots")), moved)


@query("forecast_causality", "WITH " + GRID_SQL + "SELECT count(*) AS slots, CAST(0 AS BIGINT) AS moved FROM grid")
def forecast_causality(spark, sf):
    grid = hourly_grid(spark, sf)
    build = lambda g: forecast(g, [MODELS[m] for m in ("mean_8", "trend_8", "daily", "season_median")], (1, 8))
    moved = moved_rows(build, grid, _cut(grid), (-11.0, 9999991.0)).agg(F.count(F.lit(1)).alias("moved"))
    return beside(grid.agg(F.count(F.lit(1)).alias("slots")), moved)


@query("changed_future", "WITH " + GRID_SQL + f"""
SELECT series_id, field, pos, {sig_sql("CASE WHEN pos > hi - 200 THEN -7 * value + 1000003 ELSE value END")} AS value FROM grid JOIN span USING (series_id)
""")
def changed_future(spark, sf):
    grid = hourly_grid(spark, sf)
    return change_future(grid, _cut(grid), (-7.0, 1000003.0)).select("series_id", "field", "pos", sig("value"))


@query("shift_check", "WITH " + GRID_SQL + "SELECT count(*) AS slots, CAST(0 AS BIGINT) AS wrong FROM grid")
def shift_check(spark, sf):
    grid = hourly_grid(spark, sf)
    wrong = shifted_mean_gap(rolling_features(grid, (8,), ("mean",)), grid, 8, "roll_8_mean")
    return beside(grid.agg(F.count(F.lit(1)).alias("slots")), wrong.agg(F.count(F.lit(1)).alias("wrong")))


@query("target_time_check", "WITH " + tidy_sql(("last_value",)) + """
SELECT count(*) AS rows, count(*) FILTER (target_pos <> pos + horizon) AS wrong, count(*) FILTER (target_pos % 11 = 0) AS planted FROM tidy
""")
def target_time_check(spark, sf):
    """The back-test's own target slots, and the same with every eleventh slot moved by one."""
    tidy = backtest(spark, sf, ("last_value",))
    moved = tidy.withColumn("target_pos", F.col("target_pos") + (F.col("target_pos") % 11 == 0).cast("int"))
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    return beside(beside(count(tidy, "rows"), count(target_time_errors(tidy), "wrong")), count(target_time_errors(moved), "planted"))


RULES = {"expanding": Rolling(2, 300, 96, 96), "rolling": Rolling(2, 300, 96, 96, "rolling", 200), "recent": Recent(2, 96, 96)}
SCHEME_SQL = STATE_SQL + f""",
ends AS (SELECT series_id, lo AS first_pos, hi AS last_pos FROM span),
folds AS (SELECT series_id, 'expanding' AS validation_type, f AS fold, first_pos + 300 + 96 * f AS vs FROM ends, unnest([0, 1]) AS x(f)
  UNION ALL SELECT series_id, 'rolling', f, first_pos + 300 + 96 * f FROM ends, unnest([0, 1]) AS x(f)
  UNION ALL SELECT series_id, 'recent', f, last_pos - 8 - 96 + 1 - (1 - f) * 96 FROM ends, unnest([0, 1]) AS x(f)),
sch AS (SELECT fo.validation_type, CAST(fo.fold AS INTEGER) AS fold, a.horizon, a.field, y.value AS y_true, mean8 AS m, last AS b
  FROM ask a JOIN folds fo ON fo.series_id = a.series_id AND a.pos BETWEEN fo.vs AND fo.vs + 95
  LEFT JOIN grid y ON y.series_id = a.series_id AND y.field = a.field AND y.pos = a.target_pos)
"""


@query("scheme_backtest", "WITH " + SCHEME_SQL + f"""
SELECT validation_type, fold, {sig_sql(f"avg({APE.replace('y_pred', 'm')}) FILTER (y_true IS NOT NULL)")} AS mape_mean_8,
  {sig_sql(f"avg({APE.replace('y_pred', 'b')}) FILTER (y_true IS NOT NULL)")} AS mape_last_value, count(*) FILTER (y_true IS NOT NULL) AS sample_count
FROM sch GROUP BY 1, 2
""")
def scheme_backtest(spark, sf):
    grid = hourly_grid(spark, sf).withColumn("label", F.col("value"))
    tidy = schemes(grid, [MEAN, LAST], RULES, HORIZONS)
    return scheme_gains(tidy, "mean_8", "last_value").select(
        "validation_type", "fold", *sigs(["mape_mean_8", "mape_last_value"]), "sample_count")


@query("reachability", "WITH " + long_sql() + f""",
m AS (SELECT model, avg({APE}) FILTER ({OK}) AS mape FROM long GROUP BY 1),
j AS (SELECT o AS off, g.value AS y_true, l.y_pred FROM long l, unnest([-2, -1, 0, 1, 2]) AS x(o)
  JOIN grid g ON g.series_id = l.series_id AND g.field = l.field AND g.pos = l.target_pos + o WHERE g.value IS NOT NULL AND model = 'last_value'),
a AS (SELECT off, (1 - avg({APE})) * 100 AS s FROM j GROUP BY 1)
SELECT {sig_sql("100 * (1 - max(mape) FILTER (model = 'last_value'))")} AS baseline_score_percent, arg_min(model, mape) AS best_model,
  {sig_sql("100 * (1 - min(mape))")} AS best_score_percent,
  round((SELECT max(s) FROM a WHERE off <> 0) - (SELECT s FROM a WHERE off = 0), 4) AS wrong_alignment_gain FROM m
""")
def reachability_query(spark, sf):
    tidy = backtest(spark, sf)
    metrics = summarize(melt(tidy, TIDY_MODELS), ["model"])
    labels = hourly_grid(spark, sf).withColumnRenamed("value", "label")
    out = reachability(metrics, alignment(tidy, labels))
    return out.select(sig("baseline_score_percent"), "best_model", sig("best_score_percent"), F.round("wrong_alignment_gain", 4).alias("wrong_alignment_gain"))


def _windows(spark, sf, name):
    tidy = backtest(spark, sf, (name,)).withColumnRenamed(name, "y_pred")
    return combine_windows(tidy.where("fold >= 2"), tidy.where("fold < 2"), 2, 2)


_WIN = """, wn AS (SELECT l.*, CASE WHEN fold >= 2 THEN 'recent' ELSE 'cross_month' END AS validation_type FROM long l)"""


@query("local_score", "WITH " + long_sql(("mean_8",)) + _WIN + f""",
c AS (SELECT validation_type, field, horizon, 1 - avg({APE}) FILTER ({OK}) AS s FROM wn GROUP BY 1, 2, 3)
SELECT validation_type, {sig_sql("avg(s) * 100")} AS final_score, max(folds) AS folds, max(n) AS prediction_pairs FROM c
JOIN (SELECT validation_type, count(DISTINCT fold) AS folds, count(*) AS n FROM wn GROUP BY 1) USING (validation_type) GROUP BY 1
""")
def local_score(spark, sf):
    return local_scores(_windows(spark, sf, "mean_8"), percent=True).select("validation_type", sig("final_score"), "folds", "prediction_pairs")


@query("oof_table", "WITH " + tidy_sql(("last_value", "mean_8", "daily")) + f"""
SELECT CASE WHEN fold >= 2 THEN 'recent_' ELSE 'cross_month_' END || CAST(fold AS VARCHAR) AS fold, field, horizon, count(*) AS rows,
  {sig_sql("avg(last_value)")} AS last_value, {sig_sql("avg(mean_8)")} AS mean_8, {sig_sql("avg(daily)")} AS daily FROM tidy GROUP BY 1, 2, 3
""")
def oof_table(spark, sf):
    """Candidate table of both windows on common keys, one column per candidate."""
    names = ("last_value", "mean_8", "daily")
    keys = ["series_id", "field", "fold", "validation_type", "pos", "horizon"]
    joined = join_candidates({n: _windows(spark, sf, n) for n in names}, keys)
    return joined.groupBy("fold", "field", "horizon").agg(F.count(F.lit(1)).alias("rows"), *[sig(F.avg(n), n) for n in names])


@query("month_review", """
WITH b AS (SELECT o_orderpriority AS series_id, CAST(ceil(epoch_us(o_orderdate) / 86400000000.0) AS BIGINT) AS pos, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2),
e AS (SELECT series_id, min(pos) AS lo, max(pos) AS hi FROM b GROUP BY 1),
s AS (SELECT series_id, unnest(generate_series(lo, hi)) AS pos FROM e),
g AS (SELECT s.series_id, s.pos, b.value, last_value(b.value IGNORE NULLS) OVER (PARTITION BY s.series_id ORDER BY s.pos) AS last FROM s LEFT JOIN b USING (series_id, pos)),
f AS (SELECT * FROM (VALUES (0, date_diff('day', DATE '1970-01-01', DATE '1996-03-01')), (1, date_diff('day', DATE '1970-01-01', DATE '1997-01-01')),
  (2, date_diff('day', DATE '1970-01-01', DATE '1998-07-01'))) AS m(fold, vs)),
t AS (SELECT g.series_id, f.fold, h AS horizon, y.value AS y_true, g.last AS last_value, coalesce(w.value, g.last) AS weekly FROM g JOIN f ON g.pos BETWEEN vs AND vs + 13, unnest([1, 2, 3]) AS x(h)
  LEFT JOIN g y ON y.series_id = g.series_id AND y.pos = g.pos + h LEFT JOIN g w ON w.series_id = g.series_id AND w.pos = g.pos + h - 7
  WHERE g.last IS NOT NULL),
l AS (SELECT *, 'last_value' AS model, last_value AS p FROM t UNION ALL SELECT *, 'weekly', weekly FROM t),
c AS (SELECT model, horizon, avg(abs(p - y_true) / greatest(abs(y_true), 1e-6)) AS m, count(*) AS n FROM l WHERE y_true IS NOT NULL GROUP BY 1, 2)
SELECT model, round(100 * (1 - avg(m)), 5) AS score, CAST(sum(n) AS BIGINT) AS rows FROM c GROUP BY 1
""")
def month_review(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.lit("value").alias("field"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))
    grid = densify(resample(rows, ["series_id", "field"], "ts", {"value": "mean"}, DAY)).withColumn("label", F.col("value"))
    from slotwise.plans.forecast import Model

    weekly = Model("weekly", "seasonal_naive", period=7)
    tidy = rolling_validation(grid, [LAST, weekly], MonthStart(MONTHS, 14), (1, 2, 3), step_seconds=DAY)
    out = method_scores(melt(tidy, ("last_value", "weekly")), ["model"])
    return out.select("model", F.round("score", 5).alias("score"), "rows")


@query("predict_tables", "WITH " + STATE_SQL + f"""
SELECT a.series_id, a.pos, {sig_sql("max(least(greatest(coalesce(fit8 + slope8 * horizon, last), 0), 100)) FILTER (field = 'click' AND horizon = 1)")} AS click_1,
  {sig_sql("max(least(greatest(coalesce(fit8 + slope8 * horizon, last), 0), 100)) FILTER (field = 'view' AND horizon = 2)")} AS view_2 FROM ask a GROUP BY 1, 2
""")
def predict_tables_query(spark, sf):
    tidy = forecast(hourly_grid(spark, sf), [TREND], (1, 2, 3, 4)).withColumnRenamed("trend_8", "y_pred")
    tables = predict_tables(tidy, FIELDS, 2, 4, 60, capacities={f: 100.0 for f in FIELDS})
    return tables["short"].select("series_id", "pos", sig(F.col("`click_t+60_pred`"), "click_1"), sig(F.col("`view_t+120_pred`"), "view_2"))


@query("blend_sources", "WITH " + STATE_SQL + """,
w AS (SELECT series_id, pos, count(DISTINCT field) AS nf FROM hist GROUP BY 1, 2)
SELECT 'a' AS "table", CAST(0 AS BIGINT) AS wrong_columns, CAST(0 AS BIGINT) AS row_difference, CAST(0 AS BIGINT) AS repeated_origins,
  count(*) FILTER (nf < 5) AS non_finite, CAST(0 AS BIGINT) AS axis_difference FROM w
UNION ALL SELECT 'b', 0, 0, 0, count(*) FILTER (nf < 5), 0 FROM w
""")
def blend_sources(spark, sf):
    tidy = forecast(hourly_grid(spark, sf), [LAST, MEAN], (1, 2))
    wide = lambda m: pivot_forecast(tidy, FIELDS, (1, 2), 60, m)
    first = wide("last_value")
    return aligned_sources({"a": first, "b": wide("mean_8")}, 10, first.count())


@query("relation_summary", "WITH " + PLANTED_SQL + moments_sql("planted", ("view", "leak_1", "leak_2", "delayed"), ("view", "leak_1", "leak_2", "delayed"), -4, 4) + REL.replace("FROM wide)", "FROM wide)", 1) + """,
src(f, s, i) AS (VALUES ('view', 'load', 0), ('leak_1', 'scenario', 1), ('leak_2', 'scenario', 2), ('delayed', 'other', 3)),
dl AS (SELECT count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY series_id, field, target ORDER BY abs(round(correlation, 9)) DESC, "offset") AS rk FROM mo
  WHERE pairs >= 20) JOIN src a ON a.f = field JOIN src b ON b.f = target WHERE rk = 1 AND abs(correlation) >= 0.9 AND a.i < b.i AND a.s <> b.s)
SELECT (SELECT count(*) FROM co) AS linear_relations, (SELECT count(*) FROM (SELECT series_id FROM rs GROUP BY 1 HAVING 1 - sum(res * res) / (var_pop(y) * count(*)) >= 0)) AS candidate_relations,
  (SELECT n FROM dl) AS delay_candidates
""")
def relation_summary_query(spark, sf):
    summary, _, _ = _relation(spark, sf)
    wide = planted(spark, sf).select("series_id", "pos", "view", "leak_1", "leak_2", "delayed")
    sources = {"view": "load", "leak_1": "scenario", "leak_2": "scenario", "delayed": "other"}
    return relation_summary(summary, delay_pairs(wide, sources, 4))

