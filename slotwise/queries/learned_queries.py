"""Training sets, weights, augmentation, learned forecasts and routers."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions.numbers import row_sum
from slotwise.functions.slots import slot_start
from slotwise.plans.forecast import forecast
from slotwise.plans.learned import (
    boosted, component_forecast, feature_frame, fit, fit_load_map, forest, gas_components, metadata, mixing_pairs, mixup,
    predict_loads, ridge, search, training_set, with_target_clock,
)
from slotwise.plans.fusion import blend_report
from slotwise.plans.ridge_paths import predict_paths, ratio_labels, ridge_paths, unsolved
from slotwise.plans.routing import cross_fit, route_by_error, route_by_winner, router_features, stack_ratio
from slotwise.plans.splits import Rolling, fold_table
from slotwise.queries.base import BY_FIELD, BY_SITE, HOUR, WIDE_SQL, hourly_grid, hourly_wide, query, sig, sig_sql, sigs
from slotwise.queries.forecast_queries import LAST, MEAN
from slotwise.queries.selection_queries import named, named_sql
from slotwise.queries.state_queries import STATE_SQL as FLAG_SQL
from slotwise.session import cut_lineage

TRAIN_HORIZONS = (1, 4)


def _features(spark, sf):
    return feature_frame(hourly_grid(spark, sf), online_above=20.0, stable_within=10.0, step_seconds=HOUR)


def _training(spark, sf, response="absolute", **options):
    features, names = _features(spark, sf)
    ends = features.groupBy("series_id").agg((F.max("pos") - 100).alias("train_end"))
    rows = training_set(features.join(ends, "series_id"), TRAIN_HORIZONS, F.col("train_end"), response, **options)
    return rows, names


TRAIN_SQL = FLAG_SQL + """,
cut AS (SELECT series_id, hi - 100 AS te FROM span),
tr0 AS (SELECT g.series_id, g.field, g.pos, x.h AS horizon, g.value, y.value AS actual, te
  FROM grid g JOIN cut USING (series_id), unnest([1, 4]) AS x(h), grid y
  WHERE y.series_id = g.series_id AND y.field = g.field AND y.pos = g.pos + x.h AND y.value IS NOT NULL AND g.pos + x.h <= te AND g.value IS NOT NULL AND g.pos >= te - 400),
fl AS (SELECT field, horizon, quantile_cont(abs(actual), 0.01) AS fl FROM tr0 WHERE abs(actual) > 0 GROUP BY 1, 2),
tr1 AS (SELECT t.*, 1 / greatest(abs(actual), greatest(fl, 1e-6)) * pow(0.5, (te - pos) / 200.0) AS w FROM tr0 t JOIN fl USING (field, horizon)),
tr AS (SELECT *, w / avg(w) OVER (PARTITION BY field, horizon) AS weight FROM tr1)
"""


@query("training_set", "WITH " + TRAIN_SQL + f"""
SELECT series_id, field, pos, CAST(horizon AS INTEGER) AS horizon, {sig_sql("actual")} AS actual, {sig_sql("actual - value")} AS response, {sig_sql("weight")} AS weight FROM tr
""")
def training_set_query(spark, sf):
    rows, _ = _training(spark, sf, "delta", window=400, half_life=200.0)
    return rows.select("series_id", "field", "pos", "horizon", *sigs(["actual", "response", "weight"]))


@query("sample_weight_floor", "WITH " + TRAIN_SQL + f"""
SELECT field, CAST(horizon AS INTEGER) AS horizon, count(*) AS rows, {sig_sql("max(weight)")} AS largest, {sig_sql("min(weight)")} AS smallest FROM tr GROUP BY 1, 2
""")
def sample_weight_floor(spark, sf):
    rows, _ = _training(spark, sf, "delta", window=400, half_life=200.0)
    return rows.groupBy("field", "horizon").agg(
        F.count(F.lit(1)).alias("rows"), sig(F.max("weight"), "largest"), sig(F.min("weight"), "smallest"))


@query("future_ratio", "WITH " + FLAG_SQL + f"""
SELECT series_id, field, pos, {sig_sql(f"CASE WHEN value <> 0 THEN lead(value, 4) OVER ({BY_FIELD}) / value - 1 END")} AS ratio FROM grid
""")
def future_ratio(spark, sf):
    from slotwise.functions.numbers import safe_ratio
    from slotwise.operators.blocks import with_halo

    out = with_halo(hourly_grid(spark, sf), ["series_id", "field"],
                    lambda rows, w: rows.withColumn("ratio", safe_ratio(F.lead("value", 4).over(w), F.col("value")) - 1), ahead=4)
    return out.select("series_id", "field", "pos", sig("ratio"))


@query("mixing_pairs", "WITH " + TRAIN_SQL + f""",
sm AS (SELECT t.series_id, t.field, t.horizon, t.pos, CASE WHEN startup = 1 THEN 'startup' WHEN shutdown = 1 THEN 'shutdown' WHEN online = 1 AND ramp_up = 1 THEN 'ramp_up'
  WHEN online = 1 AND ramp_down = 1 THEN 'ramp_down' WHEN online = 1 THEN 'online' ELSE 'offline' END AS state FROM tr t JOIN states USING (series_id, field, pos)),
pr AS (SELECT *, lag(pos) OVER w AS pp, lag(state) OVER w AS ps FROM sm WINDOW w AS (PARTITION BY series_id, field, horizon ORDER BY pos))
SELECT field, CAST(horizon AS INTEGER) AS horizon, state, count(*) AS pairs FROM pr WHERE pos - pp = 1 AND state = ps GROUP BY 1, 2, 3
""")
def mixing_pairs_query(spark, sf):
    rows, _ = _training(spark, sf, "delta", window=400, half_life=200.0)
    return mixing_pairs(rows, []).groupBy("field", "horizon", F.col("_state").alias("state")).agg(F.count(F.lit(1)).alias("pairs"))


def _pairs_sql(source: str) -> str:
    return f""",
sm AS (SELECT t.series_id, t.field, t.horizon, t.pos, CASE WHEN startup = 1 THEN 'startup' WHEN shutdown = 1 THEN 'shutdown' WHEN online = 1 AND ramp_up = 1 THEN 'ramp_up'
  WHEN online = 1 AND ramp_down = 1 THEN 'ramp_down' WHEN online = 1 THEN 'online' ELSE 'offline' END AS state FROM {source} t JOIN states USING (series_id, field, pos)),
pr AS (SELECT *, lag(pos) OVER w AS pp, lag(state) OVER w AS ps FROM sm WINDOW w AS (PARTITION BY series_id, field, horizon ORDER BY pos)),
np AS (SELECT field, horizon, count(*) FILTER (pos - pp = 1 AND state = ps) AS pairs, count(*) AS n FROM pr GROUP BY 1, 2)
"""


@query("mixup_rows", "WITH " + TRAIN_SQL + _pairs_sql("tr") + """
SELECT field, CAST(horizon AS INTEGER) AS horizon, n AS rows, CAST(least(round_even(n * 0.25, 0), pairs) AS BIGINT) AS added, 1.0::DOUBLE AS mean_weight FROM np
""")
def mixup_rows(spark, sf):
    rows, names = _training(spark, sf, "delta", window=400, half_life=200.0)
    return mixup(rows, names, 0.25).groupBy("field", "horizon").agg(
        F.count_if(~F.col("augmented")).alias("rows"), F.count_if("augmented").alias("added"), F.round(F.avg("weight"), 6).alias("mean_weight"))


def _learned(spark, sf, learner, response, scaled=False):
    """Fit on the early part, predict the last hundred slots."""
    rows, names = _training(spark, sf, response)
    rows, clock = with_target_clock(rows, HOUR)
    model = fit(rows, [*names, *clock], learner, response, scaled=scaled)
    features, _ = _features(spark, sf)
    ends = features.groupBy("series_id").agg((F.max("pos") - 100).alias("train_end"))
    asked = features.where(F.col("value").isNotNull()).join(ends, "series_id").where(
        "pos > train_end").withColumn("horizon", F.explode(F.array(*map(F.lit, TRAIN_HORIZONS))))
    asked, _ = with_target_clock(asked, HOUR)
    return model.predict(asked).select("series_id", "field", "pos", "horizon", "y_pred")


@query("fc_boosted")
def fc_boosted(spark, sf):
    return _learned(spark, sf, lambda: boosted(trees=8), "delta")


@query("fc_relative_boosted")
def fc_relative_boosted(spark, sf):
    return _learned(spark, sf, lambda: boosted(trees=5), "ratio")


ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)  # fixed value: penalties of the grid
RATIOS = {h: f"ratio_{h}" for h in TRAIN_HORIZONS}


def _ridge_rows(spark, sf):
    """All rows with the ratios to come, the early ones, and three families of features, each within the next."""
    features, names = _features(spark, sf)
    rows = ratio_labels(features, TRAIN_HORIZONS)
    rows = cut_lineage(rows.join(rows.groupBy("series_id").agg((F.max("pos") - 100).alias("train_end")), "series_id"))
    families = {"level": ["feat_current"], "compact": ["feat_current", *[n for n in names if "diff" in n or "lag" in n]], "full": list(names)}
    return rows, rows.where(F.col("pos") + max(TRAIN_HORIZONS) <= F.col("train_end")), families


def _ridge_models(train, families):
    models = cut_lineage(ridge_paths(train, RATIOS, families, ALPHAS))
    return models, list(dict.fromkeys(n for family in families.values() for n in family))


@query("fc_ridge")
def fc_ridge(spark, sf):
    rows, train, families = _ridge_rows(spark, sf)
    models, names = _ridge_models(train, families)
    told = predict_paths(rows.where("pos > train_end AND value IS NOT NULL"), models, names)
    return told.select("series_id", "field", "pos", "horizon", "family", "alpha", (F.col("value") * (1 + F.col("predicted"))).alias("y_pred"))


RIDGE_SQL = FLAG_SQL + f""",
cut AS (SELECT series_id, hi - 100 AS te FROM span),
aheads AS (SELECT series_id, field, pos, value, lead(value, 1) OVER ({BY_FIELD}) AS one, lead(value, 4) OVER ({BY_FIELD}) AS four FROM grid),
early AS (SELECT field, value AS x, one / value - 1 AS y1, four / value - 1 AS y4 FROM aheads JOIN cut USING (series_id)
  WHERE pos + 4 <= te AND value <> 0 AND one IS NOT NULL AND four IS NOT NULL),
slopes AS (SELECT field, count(*) AS rows, covar_pop(y1, x) / var_pop(x) AS b1, covar_pop(y4, x) / var_pop(x) AS b4 FROM early GROUP BY 1)
"""


@query("ridge_equations", "WITH " + RIDGE_SQL + f"""
SELECT field, family, alpha, CAST(horizon AS INTEGER) AS horizon, rows, 0.0::DOUBLE AS residual,
  CASE WHEN family = 'level' THEN {sig_sql("(CASE horizon WHEN 1 THEN b1 ELSE b4 END) * rows / (rows + alpha)")} END AS slope
FROM slopes, unnest(['level', 'compact', 'full']) AS f(family), unnest([0.1, 1, 10, 100, 1000]::DOUBLE[]) AS a(alpha), unnest([1, 4]) AS h(horizon)
""")
def ridge_equations(spark, sf):
    """The normal equations of all settings, from the rows; slopes of the family of one feature, which SQL has in closed form."""
    _, train, families = _ridge_rows(spark, sf)
    models, names = _ridge_models(train, families)
    left = unsolved(train, models, RATIOS, names).withColumn("residual", F.round("residual", 6) + 0.0)
    slope = models.select("field", "family", "alpha", "horizon", F.when(F.col("family") == "level", F.get("coefficients", F.lit(0))).alias("slope"))
    return left.join(slope, ["field", "family", "alpha", "horizon"]).select(
        "field", "family", "alpha", "horizon", "rows", F.abs("residual").alias("residual"), sig("slope"))


@query("fc_forest")
def fc_forest(spark, sf):
    return _learned(spark, sf, lambda: forest(trees=8, depth=4), "absolute")


@query("final_fit", "WITH " + TRAIN_SQL.replace(" AND g.value IS NOT NULL AND g.pos >= te - 400", "") + """
SELECT count(*) AS training_rows, min(pos) AS first_slot, max(pos + horizon) AS last_label_slot, count(DISTINCT field) AS targets, count(DISTINCT horizon) AS horizons,
  'training' AS data_source, 'absolute' AS response, 15 AS features, 5 AS models, 0 AS constants FROM tr0
""")
def final_fit(spark, sf):
    rows, names = _training(spark, sf, "absolute")
    return metadata(rows, fit(rows, names, lambda: ridge(1.0), "absolute"))


@query("candidate_search")
def candidate_search(spark, sf):
    features, names = _features(spark, sf)
    grid = hourly_grid(spark, sf)
    folds = fold_table(grid, Rolling(2, 456, 48, 48), 4)
    trials = [{"name": "ridge_10", "response": "absolute", "alpha": 10.0}, {"name": "ridge_mix", "response": "delta", "alpha": 1.0, "mixup": 0.25, "window": 300}]
    tidy = search(trials, features, names, (1, 4), folds, HOUR, lambda t: ridge(t["alpha"]))
    from slotwise.plans.selection import search_objective

    return search_objective(tidy.where("y_true IS NOT NULL"), "trial")


@query("component_forecast", "WITH " + WIDE_SQL + f""",
pe AS (SELECT series_id, pos, click AS part, view - click AS extra FROM wide),
lv AS (SELECT series_id, pos, last_value(part IGNORE NULLS) OVER ({BY_SITE}) AS part, last_value(extra IGNORE NULLS) OVER ({BY_SITE}) AS extra FROM pe)
SELECT series_id, pos, CAST(h AS INTEGER) AS horizon, {sig_sql("part")} AS part, {sig_sql("part + extra")} AS total
FROM lv, unnest([1, 2]) AS x(h) WHERE part IS NOT NULL OR extra IS NOT NULL
""")
def component_forecast_query(spark, sf):
    run = lambda long: forecast(long, [LAST], (1, 2)).withColumnRenamed("last_value", "y_pred")
    out = component_forecast(hourly_wide(spark, sf), "click", "view", run)
    return out.select("series_id", "pos", "horizon", sig("part"), sig("total"))


def _gas(spark, sf):
    wide = hourly_wide(spark, sf)
    return gas_components(
        wide, {"blast": row_sum(["click", "error"]), "coke": F.col("purchase")}, {"blast": F.col("signup"), "coke": F.lit(0.0)},
        {"blast": "error"}, 60.0, "click", "view")


@query("load_map")
def load_map(spark, sf):
    return fit_load_map(_gas(spark, sf), ("blast", "coke"), (1, 4)).select(
        "component", "horizon", "rows", F.round("intercept", 6).alias("intercept"),
        *[F.round(F.get("coefficients", F.lit(i)), 6).alias(f"c_{i}") for i in range(3)])


@query("gas_two_stage")
def gas_two_stage(spark, sf):
    from slotwise.operators.grid import lengthen, widen

    rows = _gas(spark, sf)
    names = [f"{kind}__{g}" for g in ("blast", "coke") for kind in ("production", "consumption", "holder_change")]
    tidy = forecast(lengthen(rows.select("series_id", "pos", *names), names), [MEAN], (1, 4))
    stage_one = widen(tidy, names, ("series_id", "pos", "horizon"), "field", "mean_8")
    now = rows.select("series_id", "pos", "component_one", "component_extra").where("component_one IS NOT NULL AND component_extra IS NOT NULL")
    return predict_loads(stage_one, now, fit_load_map(rows, ("blast", "coke"), (1, 4)), ("blast", "coke"))


CANDIDATES = ("last_value", "mean_8", "daily")


def _routed(spark, sf):
    wide = named(spark, sf, CANDIDATES).where("y_true IS NOT NULL").withColumns({
        "origin": slot_start("pos", HOUR), "target_ts": slot_start("target_pos", HOUR)})
    before = set(wide.columns)
    rows = router_features(wide, CANDIDATES)
    return rows, [c for c in rows.columns if c not in before]


@query("router_features", "WITH " + named_sql(CANDIDATES) + f""",
r AS (SELECT series_id, field, fold, pos, horizon, last_value AS a, mean_8 AS b, daily AS c, greatest(abs(last_value), 1) AS s,
  make_timestamp(pos * 3600000000) AS o, (last_value + mean_8 + daily) / 3 AS m FROM named WHERE y_true IS NOT NULL)
SELECT series_id, field, fold, pos, horizon, {sig_sql("b / s")} AS pred_mean_8, {sig_sql("(c - a) / s")} AS delta_daily,
  {sig_sql("sqrt(((a - m) * (a - m) + (b - m) * (b - m) + (c - m) * (c - m)) / 3) / s")} AS candidate_std,
  {sig_sql("(greatest(a, b, c) - least(a, b, c)) / s")} AS candidate_range, {sig_sql("(list_median([a, b, c]) - a) / s")} AS candidate_direction,
  round(sin(2 * pi() * (hour(o) * 60 + minute(o)) / 1440), 6) AS origin_day_sin FROM r
""")
def router_features_query(spark, sf):
    rows, _ = _routed(spark, sf)
    return rows.select("series_id", "field", "fold", "pos", "horizon", *sigs(
        ["pred_mean_8", "delta_daily", "candidate_std", "candidate_range", "candidate_direction"]), F.round("origin_day_sin", 6).alias("origin_day_sin"))


def _report(rows):
    return blend_report(rows, "routed", ["field", "fold"])


@query("router_error")
def router_error(spark, sf):
    rows, names = _routed(spark, sf)
    return _report(cross_fit(rows, lambda train, held: route_by_error(
        train, held, names, CANDIDATES, lambda: forest(trees=4, depth=3))))


@query("router_winner")
def router_winner(spark, sf):
    rows, names = _routed(spark, sf)
    return _report(cross_fit(rows, lambda train, held: route_by_winner(train, held, names, CANDIDATES, trees=6)))


@query("router_ridge")
def router_ridge(spark, sf):
    rows, names = _routed(spark, sf)
    return _report(cross_fit(rows, lambda train, held: stack_ratio(train, held, names, lambda: ridge(10.0), scaled=True)))


@query("router_residual")
def router_residual(spark, sf):
    rows, names = _routed(spark, sf)
    return _report(cross_fit(rows, lambda train, held: stack_ratio(
        train, held, names, lambda: boosted(trees=3), "mean_8", clip=(0.7, 1.3), share=0.5)))

