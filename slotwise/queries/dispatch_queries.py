"""Post-processing, dispatch products, online compensation, analog forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions.clock import tariff
from slotwise.functions.slots import slot_start
from slotwise.operators.balance import Roles
from slotwise.operators.blocks import asof_last
from slotwise.plans.analog import analog_forecast, nearest, trajectory_patterns
from slotwise.plans.compensation import compensate, recipe, setting_grid
from slotwise.plans.dispatch import (
    Unit, audit_plan, dispatch_input, group_totals, input_rules, largest_violation, plan_figures, resource_forecast, shortage_verdict,
)
from slotwise.plans.forecast import forecast
from slotwise.plans.postprocess import adjustment_counts, apply_limits, before_after, first_fold_limits
from slotwise.plans.splits import Rolling
from slotwise.queries.base import (
    BY_SITE, GRID_SQL, HOUR, WIDE_SQL, hourly_grid, hourly_wide, query, sig, sig_sql, sigs, table,
)
from slotwise.queries.forecast_queries import (
    DAILY, EXPANDING, LAST, STATE_SQL, TREND, _sig_metrics, backtest, gs_sql, long_sql,
)
from slotwise.queries.selection_queries import named, named_sql

# ---- limits ------------------------------------------------------------------------------
LIMITS = dict(capacities={"click": 120.0, "view": 150.0}, ramp=15.0, part="click", total="view")


def _trend(spark, sf):
    grid = hourly_grid(spark, sf)
    states = forecast(grid, [TREND, LAST], (1, 2, 3, 4))
    return states.withColumnRenamed("trend_8", "y_pred").withColumnRenamed("last_value", "current")


LIMIT_SQL = "WITH RECURSIVE " + STATE_SQL + """,
t AS (SELECT series_id, field, pos, CAST(horizon AS INTEGER) AS horizon, coalesce(fit8 + slope8 * horizon, last) AS y_pred, last AS cur FROM ask WHERE horizon <= 4),
c AS (SELECT *, CASE field WHEN 'click' THEN 120.0 WHEN 'view' THEN 150.0 END AS cap, greatest(y_pred, 0) AS p0 FROM t),
d AS (SELECT *, (y_pred < 0)::INT AS hn, coalesce(p0 > cap, false)::INT AS hc, CASE WHEN cap IS NULL THEN p0 ELSE least(p0, cap) END AS p1 FROM c),
r AS (SELECT series_id, field, pos, horizon, least(greatest(p1, cur - 15), cur + 15) AS p2 FROM d WHERE horizon = 1
  UNION ALL SELECT d.series_id, d.field, d.pos, d.horizon, least(greatest(d.p1, r.p2 - 15), r.p2 + 15)
  FROM r JOIN d ON d.series_id = r.series_id AND d.field = r.field AND d.pos = r.pos AND d.horizon = r.horizon + 1),
e AS (SELECT d.*, r.p2, (abs(d.p1 - r.p2) > 1e-8 + 1e-5 * abs(r.p2))::INT AS hr,
  max(CASE WHEN d.field = 'view' THEN r.p2 END) OVER (PARTITION BY d.series_id, d.pos, d.horizon) AS tot FROM d JOIN r USING (series_id, field, pos, horizon)),
lim AS (SELECT series_id, field, pos, horizon, y_pred, hn, hc, hr, coalesce(field = 'click' AND p2 > tot, false)::INT AS hk,
  CASE WHEN coalesce(field = 'click' AND p2 > tot, false) THEN tot ELSE p2 END AS y_limited FROM e)
"""


@query("forecast_limits", LIMIT_SQL + f"""
SELECT series_id, field, pos, horizon, {sig_sql("y_limited")} AS y_limited, hn AS hit_non_negative, hc AS hit_capacity, hk AS hit_consistency FROM lim
""")
def forecast_limits(spark, sf):
    return apply_limits(_trend(spark, sf), **LIMITS).select(
        "series_id", "field", "pos", "horizon", sig("y_limited"), "hit_non_negative", "hit_capacity", "hit_consistency")


@query("limit_counts", LIMIT_SQL + """
SELECT field, CAST(sum(hn) AS BIGINT) AS non_negative, CAST(sum(hc) AS BIGINT) AS capacity, CAST(sum(hr) AS BIGINT) AS ramp,
  CAST(sum(hk) AS BIGINT) AS consistency, count(*) FILTER (abs(y_pred - y_limited) > 1e-8 + 1e-5 * abs(y_limited)) AS adjusted_cells
FROM lim GROUP BY 1
""")
def limit_counts(spark, sf):
    return adjustment_counts(apply_limits(_trend(spark, sf), **LIMITS), ["field"])


@query("first_fold_limits", "WITH " + STATE_SQL + f""",
ends AS (SELECT series_id, lo AS first_pos FROM span),
folds AS (SELECT series_id, f AS fold, first_pos + 300 + 40 * f AS vs, first_pos + 300 + 40 * f + 95 AS ve FROM ends, unnest(generate_series(0, 2)) AS x(f))
SELECT a.series_id, a.field, CAST(fold AS INTEGER) AS fold, a.pos, CAST(horizon AS INTEGER) AS horizon, {sig_sql("least(greatest(last, 0), 100)")} AS y_limited
FROM ask a JOIN folds f ON f.series_id = a.series_id AND a.pos BETWEEN vs AND ve
""")
def first_fold_limits_query(spark, sf):
    tidy = backtest(spark, sf, ("last_value",), Rolling(3, 300, 96, 40)).withColumnRenamed("last_value", "y_pred")
    return first_fold_limits(tidy, capacities={f: 100.0 for f in ("click", "error", "purchase", "signup", "view")}).select(
        "series_id", "field", "fold", "pos", "horizon", sig("y_limited"))


@query("limits_before_after", "WITH " + long_sql(("trend_8",)).replace(
    "AS y_pred FROM tidy", "AS y_pred, 'before' AS stage FROM tidy") + """, both_stages AS (
  SELECT field, horizon, y_true, y_pred, stage FROM long UNION ALL
  SELECT field, horizon, y_true, least(greatest(y_pred, 0), 100) AS y_pred, 'after' FROM long)
""" + gs_sql("both_stages", "stage"))
def limits_before_after(spark, sf):
    tidy = backtest(spark, sf, ("trend_8",)).withColumnRenamed("trend_8", "y_pred")
    limited = apply_limits(tidy, {f: 100.0 for f in ("click", "error", "purchase", "signup", "view")})
    return _sig_metrics(before_after(limited, step_minutes=60))


# ---- dispatch ----------------------------------------------------------------------------
@query("tariff", """
SELECT event_id, CASE WHEN (hour(ts) >= 8 AND hour(ts) < 11) OR (hour(ts) >= 17 AND hour(ts) < 22) THEN 1.0
  WHEN hour(ts) < 7 OR hour(ts) >= 23 THEN 0.35 ELSE 0.65 END::DOUBLE AS price FROM events
""")
def tariff_query(spark, sf):
    return table(spark, sf, "events").select("event_id", tariff("ts").alias("price"))


FLEET = (Unit("click", 60.0, "small", 0.3), Unit("error", 80.0, "small", 0.3), Unit("signup", 120.0, "large", 0.3))
INITIAL = {"blast": 50.0, "coke": 60.0}
CONVERSION = {"blast": 1.2, "coke": 0.8}
CAPACITY = {"blast": 200.0, "coke": 250.0}


def plan_tables(spark, sf):
    """A plan per site out of the aligned readings; it breaks rules, which is what the audit must show."""
    wide = hourly_wide(spark, sf).na.fill(0.0)
    gas = wide.select(F.col("series_id").alias("plan_id"), "pos", F.explode(F.array(
        F.struct(F.lit("blast").alias("gas_type"), F.col("view").alias("production"), F.col("purchase").alias("demand"), F.col("click").alias("use"),
                 (F.col("error") + 20).alias("storage"), (F.col("signup") / 10).alias("flare"), (F.col("purchase") / 20).alias("shortage")),
        F.struct(F.lit("coke").alias("gas_type"), F.col("signup").alias("production"), F.col("error").alias("demand"), F.col("view").alias("use"),
                 (F.col("click") + 30).alias("storage"), (F.col("error") / 10).alias("flare"), F.lit(0.0).alias("shortage")))).alias("g")).select("plan_id", "pos", "g.*")
    units = wide.select(F.col("series_id").alias("plan_id"), "pos", F.explode(F.array(*[
        F.struct(F.lit(u.name).alias("unit"), F.col(u.name).alias("load"), (F.col(u.name) > 20).cast("double").alias("on"),
                 (F.col(u.name) > 60).cast("double").alias("start")) for u in FLEET])).alias("u")).select("plan_id", "pos", "u.*")
    return gas, units


PLAN_SQL = WIDE_SQL + """,
z AS (SELECT series_id AS plan_id, pos, coalesce(click, 0) AS click, coalesce(error, 0) AS error, coalesce(purchase, 0) AS purchase,
  coalesce(signup, 0) AS signup, coalesce(view, 0) AS view FROM wide),
gas AS (SELECT plan_id, pos, 'blast' AS gas_type, view AS production, purchase AS demand, click AS use_, error + 20 AS storage, signup / 10 AS flare,
  purchase / 20 AS shortage, 50.0 AS init, 1.2 AS conv, 200.0 AS cap FROM z
  UNION ALL SELECT plan_id, pos, 'coke', signup, error, view, click + 30, error / 10, 0, 60.0, 0.8, 250.0 FROM z),
un AS (SELECT plan_id, pos, unit, load, (load > 20)::INT::DOUBLE AS on_, (load > 60)::INT::DOUBLE AS start_, rated, g FROM (
  SELECT plan_id, pos, 'click' AS unit, click AS load, 60.0 AS rated, 'small' AS g FROM z UNION ALL SELECT plan_id, pos, 'error', error, 80.0, 'small' FROM z
  UNION ALL SELECT plan_id, pos, 'signup', signup, 120.0, 'large' FROM z))
"""
AUDIT_SQL = PLAN_SQL + """,
mb AS (SELECT plan_id, 'material_balance' AS rule, abs(storage - coalesce(lag(storage) OVER (PARTITION BY plan_id, gas_type ORDER BY pos), init)
  + use_ + flare - shortage - production + demand) AS v FROM gas),
gc AS (SELECT plan_id, 'generation_conversion' AS rule, abs(l - m) AS v FROM (SELECT plan_id, pos, sum(load) AS l FROM un GROUP BY 1, 2)
  JOIN (SELECT plan_id, pos, sum(use_ * conv) AS m FROM gas GROUP BY 1, 2) USING (plan_id, pos)),
ul AS (SELECT *, coalesce(lag(load) OVER w, 0) AS pl, coalesce(lag(on_) OVER w, 0) AS po, rated * 0.01 * 60 AS ramp FROM un
  WINDOW w AS (PARTITION BY plan_id, unit ORDER BY pos)),
ur AS (SELECT plan_id, unnest([{'rule': 'load_above_rated', 'v': load - rated * on_}, {'rule': 'load_below_least', 'v': rated * 0.3 * on_ - load},
  {'rule': 'start_while_off', 'v': start_ - on_}, {'rule': 'unmarked_start', 'v': on_ - po - start_}, {'rule': 'ramp_up', 'v': load - pl - ramp},
  {'rule': 'ramp_down', 'v': pl - load - ramp}, {'rule': 'not_integer', 'v': 0.0}, {'rule': 'unit_bounds', 'v': greatest(-load, -on_, on_ - 1, -start_, start_ - 1)}]) AS s FROM ul),
gb AS (SELECT plan_id, 'gas_bounds' AS rule, greatest(cap * 0.15 - storage, storage - cap * 0.9, -use_, -flare, -shortage, 0) AS v FROM gas),
al AS (SELECT * FROM mb UNION ALL SELECT * FROM gc UNION ALL SELECT plan_id, s.rule, greatest(s.v, 0) FROM ur UNION ALL SELECT * FROM gb),
audit AS (SELECT plan_id, rule, max(v) AS violation, count(*) FILTER (v > 1e-5) AS broken FROM al GROUP BY 1, 2)
"""


def _audit(spark, sf):
    gas, units = plan_tables(spark, sf)
    return audit_plan(gas, units, FLEET, INITIAL, CONVERSION, CAPACITY, step_minutes=60)


@query("plan_audit", "WITH " + AUDIT_SQL + f"SELECT plan_id, rule, {sig_sql('violation')} AS violation, broken FROM audit")
def plan_audit(spark, sf):
    return _audit(spark, sf).select("plan_id", "rule", sig("violation"), "broken")


@query("plan_max_violation", "WITH " + AUDIT_SQL + f"SELECT plan_id, {sig_sql('max(violation)')} AS max_violation FROM audit GROUP BY 1")
def plan_max_violation(spark, sf):
    return largest_violation(_audit(spark, sf)).select("plan_id", sig("max_violation"))


FIGURE_SQL = PLAN_SQL + f""",
pr AS (SELECT plan_id, pos, view * 2 AS bg, error / 5 AS bf, CASE WHEN h BETWEEN 8 AND 10 OR h BETWEEN 17 AND 21 THEN 1.0 WHEN h < 7 OR h >= 23 THEN 0.35 ELSE 0.65 END AS price
  FROM (SELECT *, hour(make_timestamp(pos * 3600000000)) AS h FROM z)),
pd AS (SELECT * FROM (SELECT plan_id, pos, sum(shortage) AS sh, sum(flare) AS fl FROM gas GROUP BY 1, 2) JOIN (SELECT plan_id, pos, sum(load) AS ge FROM un GROUP BY 1, 2) USING (plan_id, pos)
  JOIN pr USING (plan_id, pos)),
fig AS (SELECT plan_id, sum(sh) AS total_shortage, sum(fl) AS total_flare, sum(ge) AS mwh, count(*) FILTER (sh > 1e-9) AS shortage_periods,
  sum(ge * price) / (sum(ge) * avg(price)) AS ratio, sum(ge * price) - sum(fl) * 0.5 AS benefit, sum(bg * price) - sum(bf) * 0.5 AS base FROM pd GROUP BY 1)
"""


def _figures(spark, sf):
    gas, units = plan_tables(spark, sf)
    wide = hourly_wide(spark, sf).na.fill(0.0)
    price = wide.select(F.col("series_id").alias("plan_id"), "pos", tariff(slot_start("pos", HOUR)).alias("price"),
                        (F.col("view") * 2).alias("baseline_generation"), (F.col("error") / 5).alias("baseline_flare"))
    return plan_figures(gas, units, price, 1.0, 0.5)


@query("plan_figures", "WITH " + FIGURE_SQL + f"""
SELECT plan_id, {sig_sql("total_shortage")} AS total_shortage, {sig_sql("total_flare")} AS total_flare, {sig_sql("mwh")} AS generation_mwh, shortage_periods,
  {sig_sql("ratio")} AS price_weighted_load_ratio, {sig_sql("benefit")} AS benefit, {sig_sql("base")} AS baseline_benefit,
  {sig_sql("(benefit - base) / base")} AS relative_improvement FROM fig
""")
def plan_figures_query(spark, sf):
    out = _figures(spark, sf)
    return out.select(*[c if c in ("plan_id", "shortage_periods") else sig(c) for c in out.columns])


@query("shortage_gate", "WITH " + FIGURE_SQL + f"""
SELECT plan_id, {sig_sql("total_shortage")} AS total_shortage, CASE WHEN total_shortage > 1e-6 THEN 'rejected' ELSE 'accepted' END AS verdict FROM fig
""")
def shortage_gate(spark, sf):
    return shortage_verdict(_figures(spark, sf)).select("plan_id", sig("total_shortage"), "verdict")


@query("group_totals", "WITH " + PLAN_SQL + f"""
SELECT plan_id, pos, {sig_sql("sum(load) FILTER (g = 'small')")} AS small_plan, {sig_sql("sum(load)")} AS total_plan FROM un GROUP BY 1, 2
""")
def group_totals_query(spark, sf):
    _, units = plan_tables(spark, sf)
    return group_totals(units, FLEET, "small").select("plan_id", "pos", sig("small_plan"), sig("total_plan"))


GAS_ROLES = Roles(production={"blast": ["click", "error"], "coke": ["purchase"]}, user_demand={"blast": ["signup"], "coke": ["purchase"]},
                  holder={"blast": "view"})
RESOURCE_SQL = WIDE_SQL + """,
res AS (SELECT series_id, pos, CASE WHEN coalesce(click, error) IS NOT NULL THEN coalesce(click, 0) + coalesce(error, 0) END AS pb, signup AS db,
  purchase AS pc, purchase AS dc, view AS bg FROM wide),
o AS (SELECT series_id, hi AS pos FROM span),
f AS (SELECT o.series_id, o.pos, h, o.pos + h AS target_pos FROM o, unnest(generate_series(1, 24)) AS x(h)),
lastv AS (SELECT series_id, arg_max(pb, pos) FILTER (pb IS NOT NULL) AS pb, arg_max(db, pos) FILTER (db IS NOT NULL) AS db, arg_max(pc, pos) FILTER (pc IS NOT NULL) AS pc,
  arg_max(bg, pos) FILTER (bg IS NOT NULL) AS bg FROM res GROUP BY 1),
rf AS (SELECT f.series_id, f.pos, f.target_pos, greatest(coalesce(r.pb, l.pb), 0) AS pb, greatest(coalesce(r.db, l.db), 0) AS db,
  greatest(coalesce(r.pc, l.pc), 0) AS pc, greatest(coalesce(r.bg, l.bg), 0) AS bg, l.bg AS holder
  FROM f JOIN lastv l USING (series_id) LEFT JOIN res r ON r.series_id = f.series_id AND r.pos = f.target_pos - 24)
"""


@query("resource_forecast", "WITH " + RESOURCE_SQL + f"""
SELECT series_id, pos, target_pos, 'blast' AS gas_type, {sig_sql("pb")} AS production, {sig_sql("db")} AS demand, {sig_sql("pb - db")} AS available, {sig_sql("bg")} AS baseline_generation FROM rf
UNION ALL SELECT series_id, pos, target_pos, 'coke', {sig_sql("pc")}, {sig_sql("pc")}, {sig_sql("pc - pc")}, {sig_sql("bg")} FROM rf
""")
def resource_forecast_query(spark, sf):
    wide = hourly_wide(spark, sf)
    origins = wide.groupBy("series_id").agg(F.max("pos").alias("pos"))
    out = resource_forecast(wide, GAS_ROLES, "view", DAILY, 24, origins)
    return out.select("series_id", "pos", "target_pos", "gas_type", *sigs(["production", "demand", "available", "baseline_generation"]))


def _inputs(spark, sf):
    wide = hourly_wide(spark, sf)
    origins = wide.groupBy("series_id").agg(F.max("pos").alias("pos"))
    return dispatch_input(wide, GAS_ROLES, "view", DAILY, 24, origins, HOUR)


@query("dispatch_input", "WITH " + RESOURCE_SQL + f"""
SELECT series_id, target_pos, gas_type, {sig_sql("production")} AS production, {sig_sql("initial_storage")} AS initial_storage,
  CASE WHEN hour(t) BETWEEN 8 AND 10 OR hour(t) BETWEEN 17 AND 21 THEN 1.0 WHEN hour(t) < 7 OR hour(t) >= 23 THEN 0.35 ELSE 0.65 END::DOUBLE AS price
FROM (SELECT series_id, target_pos, 'blast' AS gas_type, pb AS production, holder AS initial_storage, make_timestamp(target_pos * 3600000000) AS t FROM rf
  UNION ALL SELECT series_id, target_pos, 'coke', pc, NULL, make_timestamp(target_pos * 3600000000) FROM rf)
""")
def dispatch_input_query(spark, sf):
    return _inputs(spark, sf).select("series_id", "target_pos", "gas_type", sig("production"), sig("initial_storage"), "price")


@query("price_path", "WITH " + RESOURCE_SQL + f""",
pl AS (SELECT series_id, arg_max(purchase, pos) FILTER (purchase IS NOT NULL) AS last FROM wide GROUP BY 1)
SELECT rf.series_id, rf.target_pos, {sig_sql("coalesce(w.purchase, pl.last)")} AS price
FROM rf JOIN pl USING (series_id) LEFT JOIN wide w ON w.series_id = rf.series_id AND w.pos = rf.target_pos - 24
""")
def price_path(spark, sf):
    wide = hourly_wide(spark, sf)
    origins = wide.groupBy("series_id").agg(F.max("pos").alias("pos"))
    out = dispatch_input(wide, GAS_ROLES, "view", DAILY, 24, origins, HOUR, price_field="purchase")
    return out.groupBy("series_id", "target_pos").agg(sig(F.max("price"), "price"))


@query("dispatch_input_contract", "WITH " + RESOURCE_SQL + """,
i AS (SELECT series_id AS plan_id, 'blast' AS gas_type, pb AS p, db AS d, coalesce(holder BETWEEN 200 * 0.15 AND 200 * 0.9, false) AS ok FROM rf
  UNION ALL SELECT series_id, 'coke', pc, pc, false FROM rf)
SELECT plan_id, gas_type, count(*) FILTER (p IS NULL OR d IS NULL) AS non_finite, count(*) FILTER (p < 0 OR d < 0) AS negative,
  count(*) FILTER (NOT ok) AS storage_outside,
  CASE WHEN count(*) FILTER (p IS NULL OR d IS NULL OR p < 0 OR d < 0 OR NOT ok) = 0 THEN 'passed' ELSE 'failed' END AS status FROM i GROUP BY 1, 2
""")
def dispatch_input_contract(spark, sf):
    rows = _inputs(spark, sf).select(
        F.col("series_id").alias("plan_id"), F.col("target_pos").alias("pos"), "gas_type", "production", "demand", "initial_storage", "price")
    return input_rules(rows, 24, {"blast": 200.0, "coke": 200.0}).select(
        "plan_id", "gas_type", "non_finite", "negative", "storage_outside", "status")


@query("asof_holder", "WITH " + GRID_SQL + f"""
SELECT e.event_id, e.series_id, {sig_sql("arg_max(g.value, g.pos)")} AS holder
FROM (SELECT event_id, series_id, CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) AS pos FROM raw) e
LEFT JOIN grid g ON g.series_id = e.series_id AND g.field = 'view' AND g.pos <= e.pos AND g.value IS NOT NULL GROUP BY 1, 2
""")
def asof_holder(spark, sf):
    from slotwise.functions.slots import slot_ceil
    from slotwise.queries.base import readings

    probes = readings(spark, sf).select("event_id", "series_id", slot_ceil("ts", HOUR).alias("pos"))
    facts = hourly_grid(spark, sf).where("field = 'view'")
    return asof_last(facts, probes, ["series_id"], "value", "holder", block=200).select("event_id", "series_id", sig("holder"))


# ---- online compensation -----------------------------------------------------------------
SETTINGS = setting_grid(("shared_absolute", "horizon_relative", "blended_absolute", "scaled_shared_absolute"), ("mean", "median"), (4,), (0.5,))
COMP_SQL = named_sql(("last_value",)) + f""",
og AS (SELECT DISTINCT series_id, field, fold, pos FROM named),
er AS (SELECT n.series_id, n.field, n.fold, n.target_pos AS pos, n.horizon, y_true - last_value AS a, (y_true - last_value) / greatest(abs(last_value), 1) AS r
  FROM named n JOIN og ON og.series_id = n.series_id AND og.field = n.field AND og.fold = n.fold AND og.pos = n.target_pos WHERE y_true IS NOT NULL),
own AS (SELECT series_id, field, fold, pos, horizon, avg(a) OVER w AS am, quantile_cont(a, 0.5) OVER w AS ad, avg(r) OVER w AS rm, quantile_cont(r, 0.5) OVER w AS rd
  FROM er WINDOW w AS (PARTITION BY series_id, field, fold, horizon ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
sh0 AS (SELECT series_id, field, fold, pos, quantile_cont(a, 0.5) AS a FROM er GROUP BY 1, 2, 3, 4),
sh AS (SELECT *, avg(a) OVER w AS am, quantile_cont(a, 0.5) OVER w AS ad FROM sh0 WINDOW w AS (PARTITION BY series_id, field, fold ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
j AS (SELECT n.series_id, n.field, n.fold, n.pos, n.horizon, n.y_true, n.last_value AS b, coalesce(o.am, 0) AS oam, coalesce(o.ad, 0) AS oad,
  coalesce(o.rm, 0) AS orm, coalesce(o.rd, 0) AS ord_, coalesce(s.am, 0) AS sam, coalesce(s.ad, 0) AS sad
  FROM named n ASOF LEFT JOIN own o ON o.series_id = n.series_id AND o.field = n.field AND o.fold = n.fold AND o.horizon = n.horizon AND n.pos >= o.pos
  ASOF LEFT JOIN sh s ON s.series_id = n.series_id AND s.field = n.field AND s.fold = n.fold AND n.pos >= s.pos),
comp AS (SELECT series_id, field, fold, pos, horizon, y_true, unnest([
  {{'s': 'shared_absolute|mean|4|0.5', 'y': b + 0.5 * sam}}, {{'s': 'shared_absolute|median|4|0.5', 'y': b + 0.5 * sad}},
  {{'s': 'horizon_relative|mean|4|0.5', 'y': b + 0.5 * b * orm}}, {{'s': 'horizon_relative|median|4|0.5', 'y': b + 0.5 * b * ord_}},
  {{'s': 'blended_absolute|mean|4|0.5', 'y': b + 0.25 * (sam + oam)}}, {{'s': 'blended_absolute|median|4|0.5', 'y': b + 0.25 * (sad + oad)}},
  {{'s': 'scaled_shared_absolute|mean|4|0.5', 'y': b + 0.5 * sam * horizon / 8.0}}, {{'s': 'scaled_shared_absolute|median|4|0.5', 'y': b + 0.5 * sad * horizon / 8.0}}]) AS x FROM j)
"""


def _compensated(spark, sf):
    return compensate(named(spark, sf, ("last_value",)), SETTINGS, prediction="last_value")


@query("online_compensation", "WITH " + COMP_SQL + f"SELECT series_id, field, fold, pos, horizon, x.s AS setting, {sig_sql('x.y')} AS y_comp FROM comp")
def online_compensation(spark, sf):
    return _compensated(spark, sf).select("series_id", "field", "fold", "pos", "horizon", "setting", sig("y_comp"))


def _recipe_sql(by: str) -> str:
    lead = f"{by}, " if by else ""
    return "WITH " + COMP_SQL + f""",
su AS (SELECT field, horizon, fold, x.s AS setting, sum(abs(x.y - y_true) / greatest(abs(y_true), 1e-6)) AS e, count(x.y) AS n FROM comp
  WHERE fold LIKE 'cross_month_%' AND y_true IS NOT NULL GROUP BY 1, 2, 3, 4),
hd AS (SELECT DISTINCT fold AS held FROM su UNION ALL SELECT NULL),
ce AS (SELECT field, horizon, held, setting, sum(e) / sum(n) AS m FROM su JOIN hd ON held IS NULL OR held <> fold GROUP BY 1, 2, 3, 4),
sc AS (SELECT {lead}held, setting, 100 * (1 - avg(m)) AS score FROM ce GROUP BY {lead}held, setting)
SELECT {lead}held, setting, {sig_sql("score")} AS score FROM (SELECT *, row_number() OVER (PARTITION BY {lead}held ORDER BY round(score, 10) DESC, setting) AS rk FROM sc) WHERE rk = 1
"""


@query("compensation_recipe", _recipe_sql(""))
def compensation_recipe(spark, sf):
    return recipe(_compensated(spark, sf)).select("held", "setting", sig("score"))


@query("compensation_recipe_by_column", _recipe_sql("field, horizon"))
def compensation_recipe_by_column(spark, sf):
    return recipe(_compensated(spark, sf), ["field", "horizon"]).select("field", "horizon", "held", "setting", sig("score"))


# ---- analogs -----------------------------------------------------------------------------
@query("knn_patterns", f"""
WITH p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT query, neighbour, {sig_sql("d")} AS distance, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS rk FROM p) WHERE rk <= 8
""")
def knn_patterns(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return nearest(vectors, vectors, [], 8, "embedding", "vec_id", chunk=256, same=False).select("query", "neighbour", sig("distance"), "rank")


@query("trajectory_patterns", "WITH " + WIDE_SQL + f""",
w AS (SELECT series_id, pos, click, view, list(click) OVER c AS lc, list(view) OVER c AS lv, count(click) OVER c AS nc, count(view) OVER c AS nv
  FROM (SELECT series_id, pos, last_value(click IGNORE NULLS) OVER ({BY_SITE}) AS click, last_value(view IGNORE NULLS) OVER ({BY_SITE}) AS view FROM wide)
  WINDOW c AS ({BY_SITE} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
d AS (SELECT *, [lc[i + 1] - lc[i] FOR i IN [1, 2, 3, 4]] AS dc, [lv[i + 1] - lv[i] FOR i IN [1, 2, 3, 4]] AS dv FROM w WHERE nc = 5 AND nv = 5),
s AS (SELECT *, greatest(1.4826 * list_median([abs(x - list_median(dc)) FOR x IN dc]), 0.5) AS sc, greatest(1.4826 * list_median([abs(x - list_median(dv)) FOR x IN dv]), 0.5) AS sv FROM d)
SELECT series_id, pos, {sig_sql("sc")} AS scale_click, {sig_sql("sv")} AS scale_view, {sig_sql("dc[1] / sc")} AS first_step, {sig_sql("dv[4] / sv")} AS last_step,
  {sig_sql("view / 150")} AS level_view, {sig_sql("(dc[1] + dc[2] + dc[3] + dc[4]) / 4 / sc")} AS trend_click
FROM s
""")
def trajectory_patterns_query(spark, sf):
    out = trajectory_patterns(filled(spark, sf), ("click", "view"), (120.0, 150.0), 5, block=300)
    at = lambda c, i: F.get(c, F.lit(i))
    return out.select("series_id", "pos", sig(at("scale", 0), "scale_click"), sig(at("scale", 1), "scale_view"), sig(at("pattern", 0), "first_step"),
                      sig(at("pattern", 7), "last_step"), sig(at("pattern", 9), "level_view"), sig(at("pattern", 10), "trend_click"))


def filled(spark, sf):
    """Forward-filled click and view, wide."""
    from slotwise.operators.clean import missing_and_fill
    from slotwise.operators.grid import widen

    long = missing_and_fill(hourly_grid(spark, sf).where(F.col("field").isin("click", "view")))
    return widen(long.drop("value").withColumnRenamed("filled", "value"), ("click", "view"))


@query("analog_forecast", "WITH " + WIDE_SQL + f""",
v AS (SELECT series_id, pos, last_value(click IGNORE NULLS) OVER ({BY_SITE}) AS a, last_value(view IGNORE NULLS) OVER ({BY_SITE}) AS b FROM wide),
w AS (SELECT *, list(a) OVER c AS la, list(b) OVER c AS lb, count(a) OVER c AS na, count(b) OVER c AS nb FROM v
  WINDOW c AS ({BY_SITE} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)),
d AS (SELECT series_id, pos, a, b, [la[i + 1] - la[i] FOR i IN range(1, 16)] AS da, [lb[i + 1] - lb[i] FOR i IN range(1, 16)] AS db FROM w WHERE na = 16 AND nb = 16),
s AS (SELECT *, greatest(1.4826 * list_median([abs(x - list_median(da)) FOR x IN da]), 0.5) AS sa, greatest(1.4826 * list_median([abs(x - list_median(db)) FOR x IN db]), 0.5) AS sb FROM d),
p AS (SELECT series_id, pos, a, b, sa, sb, [x / sa FOR x IN da] || [x / sb FOR x IN db] || [a / 120, b / 150, list_sum(da[12:15]) / 4 / sa, list_sum(db[12:15]) / 4 / sb] AS pat FROM s),
fo AS (SELECT series_id, f AS fold, lo + 360 + 48 * f AS vs, lo + 360 + 48 * f + 47 AS ve, hi FROM span, unnest(generate_series(0, 3)) AS x(f)),
q AS (SELECT p.*, fold, vs FROM p JOIN fo USING (series_id) WHERE pos BETWEEN vs AND ve),
n AS (SELECT q.series_id, q.fold, q.pos, c.pos AS np, list_distance(q.pat, c.pat) AS dist, q.a AS qa, q.b AS qb, c.a AS ca, c.b AS cb,
  least(greatest(q.sa / greatest(c.sa, 1e-6), 0.5), 2) AS ra, least(greatest(q.sb / greatest(c.sb, 1e-6), 0.5), 2) AS rb
  FROM q JOIN p c ON c.series_id = q.series_id AND c.pos + 8 <= q.vs - 1),
k AS (SELECT *, exp(-dist / greatest(median(dist) OVER (PARTITION BY series_id, fold, pos), 1e-6)) AS wt FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, fold, pos ORDER BY dist, np) AS rk FROM n) WHERE rk <= 32),
r AS (SELECT k.series_id, CAST(k.fold AS INTEGER) AS fold, k.pos, x.h AS horizon, sum((v.a - ca) * ra * wt) / greatest(sum(wt), 1e-12) + any_value(qa) AS ya,
  sum((v.b - cb) * rb * wt) / greatest(sum(wt), 1e-12) + any_value(qb) AS yb
  FROM k, unnest([1, 2, 4, 8]) AS x(h) JOIN v ON v.series_id = k.series_id AND v.pos = k.np + x.h GROUP BY 1, 2, 3, 4)
SELECT series_id, fold, pos, horizon, 'click' AS field, round(ya, 6) AS analog FROM r UNION ALL SELECT series_id, fold, pos, horizon, 'view', round(yb, 6) FROM r
""")
def analog_forecast_query(spark, sf):
    from slotwise.plans.splits import add_folds, fold_table

    wide = filled(spark, sf)
    folds = fold_table(wide, EXPANDING, 8)
    origins = add_folds(wide.select("series_id", "pos"), EXPANDING, folds).select("series_id", "pos", "fold")
    patterns = trajectory_patterns(wide, ("click", "view"), (120.0, 150.0), 16, 8)
    return analog_forecast(patterns, origins, ("click", "view"), (1, 2, 4, 8), 32).withColumn("analog", F.round("analog", 6))

