"""Availability rules, balances, states, regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.operators.availability import FieldRule, FieldUse, inventory, judge, registry_table, select_allowed
from slotwise.operators.balance import Roles, gas_features, role_sums, role_table, use_per_load
from slotwise.operators.states import FLAGS, add_regime, add_states, component_split, load_history
from slotwise.queries.base import (
    BY_FIELD, BY_SITE, FIELDS, GRID_SQL, WIDE_SQL, hourly_grid, hourly_wide, query, readings, sig, sig_sql, sigs,
)

ROLES = Roles(
    production={"blast": ["click", "error"], "coke": ["purchase"]},
    user_demand={"blast": ["signup"], "coke": ["view"]},
    process_demand={"coke": ["error"]},
    generator_use={"blast": ["purchase"]},
    holder={"blast": "view"},
    targets=("click", "view"),
)
RULES = [
    FieldRule("click", "gas", True, 1, allow_short=True, allow_long=True),
    FieldRule("view", "load", True, 0, is_label=True, allow_short=True, allow_long=True),
    FieldRule("purchase", "price", True, 0, is_plan=True, allow_short=True, allow_long=False, known_ahead_steps=4),
    FieldRule("signup", "user", True, 0, allow_short=True, allow_long=True, collection_delay_steps=2),
]


@query("role_sums", "WITH " + GRID_SQL + """,
roles(role, gas_type, field) AS (VALUES ('production', 'blast', 'click'), ('production', 'blast', 'error'),
  ('production', 'coke', 'purchase'), ('user_demand', 'blast', 'signup'), ('user_demand', 'coke', 'view'),
  ('process_demand', 'coke', 'error'), ('generator_use', 'blast', 'purchase'))
SELECT series_id, pos, role, gas_type, """ + sig_sql("sum(value)") + """ AS value
FROM grid JOIN roles USING (field) GROUP BY 1, 2, 3, 4
""")
def role_sums_query(spark, sf):
    return role_sums(hourly_grid(spark, sf), role_table(spark, ROLES)).withColumn("value", sig("value", "value"))


_BAL = WIDE_SQL + f""",
base AS (SELECT *,
  CASE WHEN coalesce(click, error) IS NOT NULL THEN coalesce(click, 0) + coalesce(error, 0) END AS pb,
  signup AS db, purchase AS pc, view + error AS dc, purchase AS ub FROM wide),
bal AS (SELECT *, pb - db AS bb, pc - dc AS bc, view - lag(view) OVER ({BY_SITE}) AS dh FROM base),
av AS (SELECT *, bb - dh AS ab, bc AS ac, bb - dh + bc AS atot,
  CASE WHEN coalesce(click, error, purchase) IS NOT NULL
       THEN coalesce(click, 0) + coalesce(error, 0) + coalesce(purchase, 0) END AS tp,
  CASE WHEN coalesce(signup, view) IS NOT NULL THEN coalesce(signup, 0) + coalesce(view, 0) END AS td FROM bal)
"""


def _past(expression: str, column: str, size: int) -> str:
    frame = f"OVER ({BY_SITE} ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)"
    return sig_sql(f"CASE WHEN count({column}) {frame} >= {max(2, size // 2)} THEN {expression} {frame} END")


@query("gas_balance", "WITH " + _BAL + f""", b0 AS (SELECT *, pos - min(pos) OVER () AS x FROM av)
SELECT series_id, pos, {sig_sql("lag(bb) OVER w")} AS feat_gas_balance_blast, {sig_sql("lag(bc) OVER w")} AS feat_gas_balance_coke,
  {sig_sql("lag(pb) OVER w")} AS feat_gas_production_blast, {sig_sql("lag(dc) OVER w")} AS feat_gas_priority_demand_coke,
  {sig_sql("CASE WHEN lag(bb) OVER w IS NOT NULL THEN greatest(-lag(bb) OVER w, 0) END")} AS feat_gas_supply_gap_blast,
  {sig_sql("CASE WHEN lag(dc) OVER w <> 0 THEN lag(pc) OVER w / lag(dc) OVER w END")} AS feat_gas_production_demand_ratio_coke,
  {sig_sql("CASE WHEN lag(pb) OVER w <> 0 THEN lag(ub) OVER w / lag(pb) OVER w END")} AS feat_generator_use_ratio_blast,
  {_past("avg(bb)", "bb", 8)} AS feat_gas_balance_blast_8_mean, {_past("stddev_pop(bb)", "bb", 8)} AS feat_gas_balance_blast_8_std,
  {_past("regr_slope(bb, x)", "bb", 8)} AS feat_gas_balance_blast_8_slope
FROM b0 WINDOW w AS ({BY_SITE})
""")
def gas_balance(spark, sf):
    names = ["feat_gas_balance_blast", "feat_gas_balance_coke", "feat_gas_production_blast", "feat_gas_priority_demand_coke",
             "feat_gas_supply_gap_blast", "feat_gas_production_demand_ratio_coke", "feat_generator_use_ratio_blast",
             "feat_gas_balance_blast_8_mean", "feat_gas_balance_blast_8_std", "feat_gas_balance_blast_8_slope"]
    return gas_features(hourly_wide(spark, sf), ROLES, windows=(8,)).select("series_id", "pos", *sigs(names))


@query("holder_features", "WITH " + WIDE_SQL + f""",
h AS (SELECT series_id, pos, lag(view, 1) OVER w AS l1, lag(view, 2) OVER w AS l2, lag(view, 3) OVER w AS l3,
             lag(view, 5) OVER w AS l5 FROM wide WINDOW w AS ({BY_SITE}))
SELECT series_id, pos, {sig_sql("(l1 - l2) / 15")} AS feat_holder_change_rate_blast,
  {sig_sql("(l1 - l5) / 60")} AS feat_holder_change_rate_blast_4,
  {sig_sql("(l1 - 2 * l2 + l3) / 225")} AS feat_holder_change_acceleration_blast, {sig_sql("l1")} AS feat_holder_level_blast,
  {sig_sql("CASE WHEN l1 - l2 IS NOT NULL THEN greatest(l1 - l2, 0) END")} AS feat_holder_fill_blast,
  {sig_sql("CASE WHEN l1 - l2 IS NOT NULL THEN greatest(l2 - l1, 0) END")} AS feat_holder_release_blast,
  {sig_sql("l1 / 400")} AS feat_holder_level_fraction_blast, {sig_sql("l1 / 400 - 0.15")} AS feat_holder_low_margin_blast,
  {sig_sql("0.9 - l1 / 400")} AS feat_holder_high_margin_blast,
  {sig_sql("CASE WHEN l1 IS NOT NULL THEN least(l1 / 400 - 0.15, 0.9 - l1 / 400) END")} AS feat_holder_safe_margin_blast,
  {sig_sql("(l1 + l1 - l2) / 400")} AS feat_holder_projected_fraction_blast
FROM h
""")
def holder_features(spark, sf):
    out = gas_features(hourly_wide(spark, sf), ROLES, momentum=(1, 4), capacity=400.0, windows=(4,), block=128)
    wanted = ("change_rate_blast", "change_rate_blast_4", "change_acceleration_blast", "level_blast", "fill_blast",
              "release_blast", "level_fraction_blast", "low_margin_blast", "high_margin_blast", "safe_margin_blast",
              "projected_fraction_blast")
    return out.select("series_id", "pos", *sigs([f"feat_holder_{n}" for n in wanted]))


@query("plant_totals", "WITH " + _BAL + f""", b0 AS (SELECT *, pos - min(pos) OVER () AS x FROM av)
SELECT series_id, pos, {sig_sql("lag(tp) OVER w")} AS feat_gas_total_production, {sig_sql("lag(td) OVER w")} AS feat_gas_total_demand,
  {sig_sql("lag(error) OVER w")} AS feat_gas_total_process_demand, {sig_sql("lag(purchase) OVER w")} AS feat_gas_total_use,
  {sig_sql("lag(tp) OVER w - lag(td) OVER w - lag(error) OVER w")} AS feat_gas_total_balance,
  {sig_sql("CASE WHEN lag(tp) OVER w <> 0 THEN lag(purchase) OVER w / lag(tp) OVER w END")} AS feat_gas_use_to_production_ratio,
  {sig_sql("lag(ab) OVER w")} AS feat_gas_available_blast, {sig_sql("lag(atot) OVER w")} AS feat_gas_total_available,
  {sig_sql("CASE WHEN lag(atot) OVER w IS NOT NULL THEN greatest(-lag(atot) OVER w, 0) END")} AS feat_gas_total_supply_gap,
  {_past("avg(atot)", "atot", 16)} AS feat_gas_total_available_16_mean,
  {_past("regr_slope(atot, x)", "atot", 16)} AS feat_gas_total_available_16_slope
FROM b0 WINDOW w AS ({BY_SITE})
""")
def plant_totals(spark, sf):
    names = ["production", "demand", "process_demand", "use", "balance"]
    out = gas_features(hourly_wide(spark, sf), ROLES, windows=(16,))
    return out.select("series_id", "pos", *sigs([f"feat_gas_total_{n}" for n in names] + [
        "feat_gas_use_to_production_ratio", "feat_gas_available_blast", "feat_gas_total_available",
        "feat_gas_total_supply_gap", "feat_gas_total_available_16_mean", "feat_gas_total_available_16_slope"]))


@query("use_per_load", "WITH " + WIDE_SQL + f""",
r AS (SELECT series_id, pos, pos - min(pos) OVER () AS x,
  lag(purchase) OVER ({BY_SITE}) / CASE WHEN abs(click) >= 1 THEN click END AS ratio FROM wide),
f AS (SELECT *, CASE WHEN count(ratio) OVER p >= 4 THEN quantile_cont(ratio, 0.5) OVER p END AS med,
  CASE WHEN count(ratio) OVER p >= 4 THEN regr_slope(ratio, x) OVER p END AS slope
  FROM r WINDOW p AS ({BY_SITE} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT series_id, pos, {sig_sql("ratio")} AS ratio, {sig_sql("CASE WHEN med <> 0 THEN ratio / med - 1 END")} AS gap_8,
       {sig_sql("slope")} AS slope_8
FROM f
""")
def use_per_load_query(spark, sf):
    name = "feat_gas_load_blast_use_per_mw_click"
    return use_per_load(hourly_wide(spark, sf), ROLES, (8,)).select(
        "series_id", "pos", sig(name, "ratio"), sig(f"{name}_8_relative_gap", "gap_8"), sig(f"{name}_8_slope", "slope_8"))


STATE_SQL = GRID_SQL + f""",
p AS (SELECT *, lag(value) OVER ({BY_FIELD}) AS prev FROM grid),
st AS (SELECT series_id, field, pos, value, value - prev AS delta, coalesce(value > 20, false) AS onl,
  coalesce(prev > 20, false) AS was FROM p),
states AS (SELECT series_id, field, pos, value, delta, onl::INT AS online, (onl AND NOT was)::INT AS startup,
  (NOT onl AND was)::INT AS shutdown, (onl AND coalesce(abs(delta) <= 10, false))::INT AS stable,
  coalesce(delta > 10, false)::INT AS ramp_up, coalesce(delta < -10, false)::INT AS ramp_down FROM st)
"""
REGIME_CASE = """CASE WHEN shutdown = 1 THEN 'shutdown' WHEN startup = 1 THEN 'startup'
  WHEN ramp_down = 1 THEN 'ramp_down' WHEN ramp_up = 1 THEN 'ramp_up' ELSE 'stable' END"""


@query("state_flags", "WITH " + STATE_SQL + f"""
SELECT series_id, field, pos, online, startup, shutdown, stable, ramp_up, ramp_down, {sig_sql("delta / 60")} AS ramp_rate
FROM states
""")
def state_flags_query(spark, sf):
    out = add_states(hourly_grid(spark, sf), online_above=20.0, stable_within=10.0, step_minutes=60)
    return out.select("series_id", "field", "pos", *FLAGS, sig("ramp_rate"))


@query("regime", "WITH " + STATE_SQL + f"SELECT series_id, field, pos, {REGIME_CASE} AS regime FROM states")
def regime_query(spark, sf):
    return add_regime(hourly_grid(spark, sf), online_above=20.0, stable_within=10.0, block=100).select(
        "series_id", "field", "pos", "regime")


@query("load_history", "WITH " + GRID_SQL + ", g AS (SELECT *, pos - min(pos) OVER () AS x FROM grid), m AS (SELECT series_id, field, pos, value,\n"
       + ",\n".join(
           f"CASE WHEN count(value) OVER p{n} >= {n // 2} THEN {e} OVER p{n} END AS {a}_{n}"
           for n in (4, 32) for e, a in (("avg(value)", "mean"), ("regr_slope(value, x)", "slope"), ("stddev_pop(value)", "vol")))
       + f""" FROM g WINDOW p4 AS ({BY_FIELD} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
  p32 AS ({BY_FIELD} ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING))
SELECT series_id, field, pos, {sig_sql("value - mean_4")} AS gap_4, {sig_sql("CASE WHEN mean_4 <> 0 THEN value / mean_4 - 1 END")} AS rel_4,
  {sig_sql("slope_4")} AS slope_4, {sig_sql("vol_4")} AS vol_4, {sig_sql("value - mean_32")} AS gap_32,
  {sig_sql("CASE WHEN mean_32 <> 0 THEN value / mean_32 - 1 END")} AS rel_32, {sig_sql("slope_32")} AS slope_32, {sig_sql("vol_32")} AS vol_32
FROM m
""")
def load_history_query(spark, sf):
    out = load_history(hourly_grid(spark, sf), (4, 32))
    pick = {"gap": "mean_gap", "rel": "relative_mean_gap", "slope": "slope", "vol": "volatility"}
    return out.select("series_id", "field", "pos",
                      *[sig(f"{n}_{long}", f"{short}_{n}") for n in (4, 32) for short, long in pick.items()])


@query("component_split", "WITH " + WIDE_SQL + f"""
SELECT series_id, pos, {sig_sql("view - click")} AS extra_load, {sig_sql("CASE WHEN view <> 0 THEN click / view END")} AS extra_ratio,
  {sig_sql("view - click")} AS target_gap, coalesce(view >= click, false)::INT AS target_consistent
FROM wide
""")
def component_split_query(spark, sf):
    return component_split(hourly_wide(spark, sf), "click", "view").select(
        "series_id", "pos", *sigs(["extra_load", "extra_ratio", "target_gap"]), "target_consistent")


REGISTRY_SQL = """
registry(field, source_file, available, min_lag, is_label, is_plan, a_short, a_long, delay, ahead) AS (VALUES
  ('click', 'gas', true, 1, false, false, true, true, 0, 0), ('view', 'load', true, 0, true, false, true, true, 0, 0),
  ('purchase', 'price', true, 0, false, true, true, false, 0, 4), ('signup', 'user', true, 0, false, false, true, true, 2, 0)),
uses AS (SELECT DISTINCT event_type || '_' || CAST(o AS VARCHAR) AS feature, event_type AS field, o AS "offset", s AS scope
  FROM events, unnest([-4, -1, 0, 2]) AS x(o), unnest(['short', 'long', 'other']) AS y(s))
"""


def _uses(spark, sf):
    fields = readings(spark, sf).select("field").distinct()
    return fields.select(
        "field", F.explode(F.array(*map(F.lit, (-4, -1, 0, 2)))).alias("offset")).select(
        F.concat("field", F.lit("_"), F.col("offset").cast("string")).alias("feature"), "field", "offset",
        F.explode(F.array(*map(F.lit, ("short", "long", "other")))).alias("scope"))


@query("availability", "WITH " + REGISTRY_SQL + """
SELECT u.feature, u.field, u."offset", u.scope,
  CASE WHEN scope NOT IN ('short', 'long') THEN 'unknown scope'
       WHEN NOT coalesce(available AND CASE scope WHEN 'short' THEN a_short ELSE a_long END, false) THEN 'not allowed in scope'
       WHEN "offset" > -coalesce(min_lag, 0) THEN 'lag too short'
       WHEN "offset" + delay - ahead > 0 THEN 'not yet available at origin' END AS objection
FROM uses u LEFT JOIN registry r USING (field)
""")
def availability(spark, sf):
    return judge(_uses(spark, sf), registry_table(spark, RULES))


@query("field_inventory", "WITH " + REGISTRY_SQL + """
SELECT f.field, r.field IS NOT NULL AS registered, coalesce(available, false) AS available_at_origin,
  coalesce(a_short, false) AS allow_short, coalesce(a_long, false) AS allow_long, coalesce(is_label, false) AS is_label,
  coalesce(is_plan, false) AS is_plan, '' AS pending
FROM (SELECT DISTINCT event_type AS field FROM events) f LEFT JOIN registry r USING (field)
""")
def field_inventory(spark, sf):
    return inventory(readings(spark, sf).select("field").distinct(), registry_table(spark, RULES))


@query("gated_features", "WITH " + WIDE_SQL + f"""
SELECT series_id, pos, {sig_sql("view")} AS view_0, {sig_sql("lag(click, 1) OVER w")} AS click_1,
  {sig_sql("lag(signup, 4) OVER w")} AS signup_4
FROM wide WINDOW w AS ({BY_SITE})
""")
def gated_features(spark, sf):
    from slotwise.operators.blocks import with_halo

    lags = {"view": (0,), "click": (0, 1), "signup": (1, 4), "purchase": (1,), "error": (4,)}
    uses = [FieldUse(f"{f}_{k}", f, -k) for f, ks in lags.items() for k in ks]
    frame = with_halo(
        hourly_wide(spark, sf), ["series_id"],
        lambda rows, w: rows.withColumns({f"{f}_{k}": F.lag(f, k).over(w) for f, ks in lags.items() for k in ks}), back=4)
    out = select_allowed(frame.drop(*FIELDS), uses, RULES)
    return out.select("series_id", "pos", *sigs([c for c in out.columns if c not in ("series_id", "pos")]))

