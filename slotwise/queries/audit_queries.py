"""Leakage audit and relation discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.operators.availability import registry_table, scope_allowed
from slotwise.operators.correlate import lag_moments
from slotwise.operators.grid import resample_variants
from slotwise.plans.audit import (
    Relation, boundary_sensitivity, check_summary, combinations, copies, delay_pairs, first_findings, future_correlations, lag_table,
    linear_relation, multivariate_fit, plan_fields, segment_statistics, setpoints, strongest, suspicious_names, with_change,
)
from slotwise.plans.contracts import duplicates
from slotwise.queries.base import (
    BY_FIELD, BY_SITE, FIELDS, GRID_SQL, HOUR, TARGETS, WIDE_SQL, hourly_grid, hourly_wide, query, readings, sig,
    sig_sql,
)
from slotwise.queries.state_queries import RULES

# planted columns: two leaks of the future and one delayed copy of a target
PLANTED_SQL = WIDE_SQL + f""",
planted AS (SELECT *, 2 * lead(view, 1) OVER ({BY_SITE}) + 3 AS leak_1, lead(view, 2) OVER ({BY_SITE}) AS leak_2,
  lag(view, 2) OVER ({BY_SITE}) - 1 AS delayed FROM wide)
"""
AUDITED = ("click", "error", "purchase", "signup", "leak_1", "leak_2", "delayed")


def planted(spark, sf):
    from slotwise.operators.blocks import with_halo

    return with_halo(hourly_wide(spark, sf), ["series_id"], lambda rows, w: rows.withColumns({
        "leak_1": 2 * F.lead("view", 1).over(w) + 3, "leak_2": F.lead("view", 2).over(w),
        "delayed": F.lag("view", 2).over(w) - 1}), back=2, ahead=2)


def moments_sql(source: str, fields, targets, low: int, high: int) -> str:
    left = " UNION ALL ".join(f"SELECT series_id, pos, '{f}' AS field, {f} AS x FROM {source}" for f in fields)
    right = " UNION ALL ".join(f"SELECT series_id, pos, '{t}' AS target, {t} AS y FROM {source}" for t in targets)
    return f""",
lx AS ({left}), ry AS ({right}),
pairs AS (SELECT l.series_id, l.field, r.target, CAST(o AS INTEGER) AS "offset", l.x, r.y, l.x IS NOT NULL AND r.y IS NOT NULL AS both_
  FROM lx l, unnest(generate_series({low}, {high})) AS u(o) JOIN ry r ON r.series_id = l.series_id AND r.pos = l.pos + o
),
mo AS (SELECT series_id, field, target, "offset", count(*) FILTER (both_) AS pairs,
  CASE WHEN count(*) FILTER (both_) >= 10 AND min(x) FILTER (both_) < max(x) FILTER (both_) AND min(y) FILTER (both_) < max(y) FILTER (both_)
    THEN corr(x, y) FILTER (both_) END AS correlation,
  regr_slope(y, x) FILTER (both_) AS slope, regr_intercept(y, x) FILTER (both_) AS icept
  FROM pairs GROUP BY 1, 2, 3, 4)
"""


@query("lag_corr", "WITH " + WIDE_SQL + moments_sql("wide", FIELDS, TARGETS, -96, 96) + f"""
SELECT series_id, field, target, "offset", "offset" * 60 AS offset_minutes, pairs, {sig_sql("round(correlation, 7)")} AS correlation,
  CASE WHEN "offset" > 0 THEN 'red_future_diagnostic_only' WHEN "offset" = 0 THEN 'amber_current' ELSE 'green_historical' END AS risk
FROM mo
""")
def lag_corr(spark, sf):
    out = lag_table(lag_moments(hourly_wide(spark, sf), FIELDS, TARGETS, -96, 96), 60)
    return out.select("series_id", "field", "target", "offset", "offset_minutes", "pairs",
                      sig(F.round("correlation", 7), "correlation"), "risk")


@query("affine_copy", "WITH " + PLANTED_SQL + moments_sql("planted", AUDITED, ("view",), -96, 96) + f"""
SELECT series_id, field, target, "offset", round(slope, 6) AS coefficient, round(icept, 6) AS intercept,
  CASE WHEN "offset" > 0 THEN 'red' ELSE 'amber' END AS risk
FROM (SELECT *, row_number() OVER (PARTITION BY series_id, field, target ORDER BY abs(round(correlation, 9)) DESC, "offset") AS rk FROM mo
  WHERE abs(correlation) >= 0.995) WHERE rk = 1 AND sqrt(greatest(0, 1 - correlation * correlation)) <= 0.01
""")
def affine_copy(spark, sf):
    out = copies(lag_moments(planted(spark, sf), AUDITED, ("view",), -96, 96), ("view",))
    return out.select("series_id", "field", "target", "offset", F.round("coefficient", 6).alias("coefficient"),
                      F.round("intercept", 6).alias("intercept"), "risk")


@query("future_corr", "WITH " + PLANTED_SQL + moments_sql("planted", AUDITED, ("view",), 1, 96) + """
SELECT series_id, field, target, "offset", 'red' AS risk
FROM (SELECT *, row_number() OVER (PARTITION BY series_id, field, target ORDER BY abs(round(correlation, 9)) DESC, "offset") AS rk FROM mo
  WHERE abs(correlation) >= 0.995) WHERE rk = 1
""")
def future_corr(spark, sf):
    out = future_correlations(lag_moments(planted(spark, sf), AUDITED, ("view",), 1, 96), ("view",))
    return out.select("series_id", "field", "target", "offset", "risk")


@query("denied_field_corr", "WITH " + PLANTED_SQL + moments_sql("planted", ("error", "purchase", "leak_1", "leak_2", "delayed"), ("view",), 1, 96) + f"""
SELECT field, max(abs(round(correlation, 7))) AS strongest, count(*) FILTER (abs(correlation) >= 0.995) AS offsets_over FROM mo GROUP BY 1
""")
def denied_field_corr(spark, sf):
    registry = registry_table(spark, RULES)
    allowed = {r.field for r in registry.where(scope_allowed(F.lit("long"))).select("field").collect()}
    denied = [f for f in AUDITED if f not in allowed and f != "view"]
    return lag_moments(planted(spark, sf), denied, ("view",), 1, 96).groupBy("field").agg(
        F.max(F.abs(F.round("correlation", 7))).alias("strongest"), F.count_if(F.abs("correlation") >= 0.995).alias("offsets_over"))


# every field but the target
OTHERS = tuple(f for f in FIELDS if f != "view")


def normal_equations_sql(source: str, fields) -> str:
    """(series_id, c0, c_<field>): least squares of ``y`` by elimination in the covariances, a step a view."""
    k = len(fields)
    columns = [*fields, "y"]
    pairs = [(i, j) for i in range(k) for j in range(i, k + 1)]
    views = [f"m0 AS (SELECT series_id, avg(y) AS m_y, {', '.join(f'avg({f}) AS m_{f}' for f in fields)}, "
             + ", ".join(f"covar_pop({columns[i]}, {columns[j]}) AS g{i}_{j}" for i, j in pairs) + f" FROM {source} GROUP BY 1)"]
    for p in range(k - 1):
        left = ", ".join(f"g{i}_{j} - g{p}_{i} * g{p}_{j} / g{p}_{p} AS g{i}_{j}" if i > p else f"g{i}_{j}" for i, j in pairs)
        views.append(f"m{p + 1} AS (SELECT series_id, m_y, {', '.join(f'm_{f}' for f in fields)}, {left} FROM m{p})")
    last = f"m{k - 1}"
    for p in reversed(range(k)):
        known = "".join(f" - g{p}_{j} * c_{fields[j]}" for j in range(p + 1, k))
        views.append(f"s{p} AS (SELECT *, (g{p}_{k}{known}) / g{p}_{p} AS c_{fields[p]} FROM {last})")
        last = f"s{p}"
    made = "".join(f" - c_{f} * m_{f}" for f in fields)
    return ",\n".join(views) + f""",
co AS (SELECT series_id, m_y{made} AS c0, {', '.join(f'c_{f}' for f in fields)} FROM {last})"""


MULTI = f""",
cx AS (SELECT series_id, pos, {', '.join(OTHERS)}, view AS y, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS k,
  count(*) OVER (PARTITION BY series_id) AS n FROM wide WHERE {' AND '.join(f'coalesce(isfinite({f}), false)' for f in (*OTHERS, 'view'))}),
tr AS (SELECT * FROM cx WHERE k <= greatest(20, floor(n * 0.7)) AND n >= {max(30, 2 * len(OTHERS))}),
{normal_equations_sql("tr", OTHERS)},
te AS (SELECT cx.*, y - (c0{''.join(f' + c_{f} * {f}' for f in OTHERS)}) AS res, c0, {', '.join(f'c_{f}' for f in OTHERS)}
  FROM cx JOIN co USING (series_id) WHERE k > greatest(20, floor(n * 0.7)) AND n >= {max(30, 2 * len(OTHERS))}),
ju AS (SELECT series_id, max(n) AS rows, count(*) AS test_rows, 1 - sum(res * res) / greatest(var_pop(y) * count(*), 1e-12) AS r2,
  sqrt(sum(res * res) / count(*)) / greatest(stddev_pop(y), 1e-12) AS ratio, max(c0) AS c0, {', '.join(f'max(c_{f}) AS c_{f}' for f in OTHERS)}
  FROM te GROUP BY 1 HAVING count(*) >= 10)
"""


@query("multivariate_copy", "WITH " + WIDE_SQL + MULTI + f"""
SELECT series_id, rows, test_rows, round(r2, 7) AS r2, round(ratio, 7) AS residual_ratio, round(c0, 6) AS intercept,
  {', '.join(f'round(c_{f}, 7) AS coef_{f}' for f in OTHERS)},
  CAST(to_json(list_transform(list_sort([{', '.join(f"struct_pack(o := -abs(c_{f}), f := '{f}')" for f in OTHERS)}]), lambda x: x.f)[1:8]) AS VARCHAR)
    AS features,
  r2 >= 0.995 AS candidate, CASE WHEN r2 >= 0.995 THEN 'multivariate_linear_combination' END AS kind, CASE WHEN r2 >= 0.995 THEN 'amber' END AS risk
FROM ju
""")
def multivariate_copy(spark, sf):
    fit = strongest(combinations(multivariate_fit(hourly_wide(spark, sf), OTHERS, "view", block=256)), OTHERS)
    return fit.select(
        "series_id", "rows", "test_rows", F.round("r2", 7).alias("r2"), F.round("residual_ratio", 7).alias("residual_ratio"),
        F.round("intercept", 6).alias("intercept"),
        *[F.round(F.get("coefficients", F.lit(i)), 7).alias(f"coef_{f}") for i, f in enumerate(OTHERS)],
        "features", "candidate", "kind", "risk")


@query("suspicious_names", """
WITH n AS (SELECT DISTINCT event_type || s AS name FROM events, unnest(['', '_future', '_Target_next', '_plan', '_ok']) AS x(s))
SELECT name, concat_ws(',', CASE WHEN lower(name) LIKE '%future%' THEN 'future' END, CASE WHEN lower(name) LIKE '%target%' THEN 'target' END,
  CASE WHEN lower(name) LIKE '%plan%' THEN 'plan' END) AS matched,
  CASE WHEN lower(name) LIKE '%future%' OR lower(name) LIKE '%target%' THEN 'red' ELSE 'amber' END AS risk
FROM n WHERE lower(name) LIKE '%future%' OR lower(name) LIKE '%target%' OR lower(name) LIKE '%plan%'
""")
def suspicious_names_query(spark, sf):
    endings = F.explode(F.array(*map(F.lit, ("", "_future", "_Target_next", "_plan", "_ok"))))
    names = readings(spark, sf).select("field").distinct().withColumn("s", endings).select(F.concat("field", "s").alias("name"))
    return suspicious_names(names, ["future", "target", "plan"]).withColumn("matched", F.concat_ws(",", "matched"))


@query("boundary_sensitivity", """
WITH v AS (
  SELECT event_type AS field, value, unnest([
    {'label': 'left', 'closed': 'left', 'pos': CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT)},
    {'label': 'left', 'closed': 'right', 'pos': CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) - 1},
    {'label': 'right', 'closed': 'left', 'pos': CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) + 1},
    {'label': 'right', 'closed': 'right', 'pos': CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT)}]) AS s FROM events),
b AS (SELECT field, s.label AS label, s.closed AS closed, s.pos AS pos, avg(value) AS v FROM v GROUP BY 1, 2, 3, 4),
d AS (SELECT b.label, b.closed, b.field, avg(abs(b.v - r.v)) AS d, count(*) AS n FROM b JOIN b r ON r.field = b.field AND r.pos = b.pos
  AND r.label = 'right' AND r.closed = 'right' GROUP BY 1, 2, 3)
SELECT label, closed, CAST(sum(n) AS BIGINT) AS common_rows, round(avg(d), 7) AS mean_absolute_difference,
  label = 'right' AND closed = 'right' AS reference FROM d GROUP BY 1, 2
""")
def boundary_sensitivity_query(spark, sf):
    out = boundary_sensitivity(resample_variants(readings(spark, sf), ["field"], "ts", {"value": "mean"}, HOUR), keys=("field",))
    return out.select("label", "closed", "common_rows", F.round("mean_absolute_difference", 7).alias("mean_absolute_difference"), "reference")


@query("findings_dedup", "WITH " + PLANTED_SQL + moments_sql("planted", AUDITED, ("view",), -2, 2) + """,
f AS (SELECT field, target, 'strong' AS kind, "offset", abs(round(correlation, 7)) AS strength, series_id FROM mo WHERE abs(correlation) >= 0.995)
SELECT field, target, kind, "offset", strength, series_id FROM (
  SELECT *, row_number() OVER (PARTITION BY field, target, kind, "offset" ORDER BY strength DESC, series_id) AS rk FROM f) WHERE rk = 1
""")
def findings_dedup(spark, sf):
    strong = lag_moments(planted(spark, sf), AUDITED, ("view",), -2, 2).where(F.abs("correlation") >= 0.995)
    rows = strong.select("field", "target", F.lit("strong").alias("kind"), "offset", F.abs(F.round("correlation", 7)).alias("strength"), "series_id")
    return first_findings(rows, order=[F.desc("strength"), F.col("series_id")])


@query("audit_checks", "WITH " + WIDE_SQL + """
SELECT 'unique_time_index' AS "check", (SELECT count(*) FROM (SELECT series_id, pos FROM wide GROUP BY 1, 2 HAVING count(*) > 1)) AS offending, 'passed' AS status
UNION ALL SELECT 'unregistered_fields', (SELECT count(DISTINCT event_type) FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')), 'failed'
UNION ALL SELECT 'empty_slots', (SELECT count(*) FROM wide WHERE coalesce(click, error, purchase, signup, view) IS NULL),
  CASE WHEN (SELECT count(*) FROM wide WHERE coalesce(click, error, purchase, signup, view) IS NULL) = 0 THEN 'passed' ELSE 'failed' END
""")
def audit_checks(spark, sf):
    wide = hourly_wide(spark, sf)
    fields = readings(spark, sf).select("field").distinct()
    return check_summary({
        "unique_time_index": duplicates(wide, ["series_id", "pos"]),
        "unregistered_fields": fields.join(registry_table(spark, RULES), "field", "left_anti"),
        "empty_slots": wide.where(F.coalesce(*FIELDS).isNull())})


REL = """,
d AS (SELECT series_id, pos, view - lag(view) OVER (PARTITION BY series_id ORDER BY pos) AS y, click AS a, error AS b FROM wide),
cx AS (SELECT * FROM d WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL),
tr AS (SELECT series_id, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_pop(a, a) AS aa, covar_pop(a, b) AS ab,
  covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM cx GROUP BY 1),
co AS (SELECT series_id, n, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb, ma, mb, my FROM tr WHERE n >= 30),
rs AS (SELECT cx.*, n, ca, cb, my - ca * ma - cb * mb AS c0, y - (my + ca * (a - ma) + cb * (b - mb)) AS res,
  strftime(make_timestamp(pos * 3600000000), '%Y-%m') AS month FROM cx JOIN co USING (series_id))
"""
BALANCE = Relation("material_balance", "view_change", ("click", "error"))


def _relation(spark, sf):
    return linear_relation(with_change(hourly_wide(spark, sf), "view", "view_change"), BALANCE, 0.0, HOUR)


@query("linear_relations", "WITH " + WIDE_SQL + REL + """
SELECT series_id, max(n) AS n, round(max(ca), 7) AS coef_click, round(max(cb), 7) AS coef_error, round(max(c0), 6) AS intercept,
  round(1 - sum(res * res) / (var_pop(y) * count(*)), 7) AS r2, round(stddev_pop(res), 6) AS residual_std,
  round(quantile_cont(abs(res), 0.5), 6) AS residual_p50_abs, round(quantile_cont(abs(res), 0.95), 6) AS residual_p95_abs,
  1 - sum(res * res) / (var_pop(y) * count(*)) >= 0 AS candidate
FROM rs GROUP BY 1
""")
def linear_relations(spark, sf):
    summary, _, _ = _relation(spark, sf)
    return summary.select(
        "series_id", "n", F.round(F.get("coefficients", F.lit(0)), 7).alias("coef_click"),
        F.round(F.get("coefficients", F.lit(1)), 7).alias("coef_error"), F.round("intercept", 6).alias("intercept"),
        F.round("r2", 7).alias("r2"), *[F.round(c, 6).alias(c) for c in ("residual_std", "residual_p50_abs", "residual_p95_abs")], "candidate")


@query("relation_months", "WITH " + WIDE_SQL + REL + """
SELECT 'material_balance' AS relation, series_id, month, count(*) AS n, round(1 - sum(res * res) / (var_pop(y) * count(*)), 7) AS r2
FROM rs GROUP BY 2, 3 HAVING count(*) >= 10
""")
def relation_months(spark, sf):
    _, monthly, _ = _relation(spark, sf)
    return monthly.withColumn("r2", F.round("r2", 7))


@query("relation_worst", "WITH " + WIDE_SQL + REL + """
SELECT 'material_balance' AS relation, series_id, CAST(rk AS INTEGER) AS rank, pos, round(res, 6) AS residual
FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(res) DESC, pos) AS rk FROM rs) WHERE rk <= 5
""")
def relation_worst(spark, sf):
    _, _, worst = _relation(spark, sf)
    return worst.withColumn("residual", F.round("residual", 6))


@query("delay_pairs", "WITH " + PLANTED_SQL + moments_sql("planted", ("view", "leak_1", "leak_2", "delayed"), ("view", "leak_1", "leak_2", "delayed"), -12, 12) + """,
src(f, s, i) AS (VALUES ('view', 'load', 0), ('leak_1', 'scenario', 1), ('leak_2', 'scenario', 2), ('delayed', 'other', 3))
SELECT series_id, field AS left_field, a.s AS left_source, target AS right_field, b.s AS right_source, "offset" AS right_offset,
  CASE WHEN "offset" > 0 THEN 'red' ELSE 'review' END AS risk
FROM (SELECT *, row_number() OVER (PARTITION BY series_id, field, target ORDER BY abs(round(correlation, 9)) DESC, "offset") AS rk FROM mo
  WHERE pairs >= 20) JOIN src a ON a.f = field JOIN src b ON b.f = target WHERE rk = 1 AND abs(correlation) >= 0.9 AND a.i < b.i AND a.s <> b.s
""")
def delay_pairs_query(spark, sf):
    wide = planted(spark, sf).select("series_id", "pos", "view", "leak_1", "leak_2", "delayed")
    sources = {"view": "load", "leak_1": "scenario", "leak_2": "scenario", "delayed": "other"}
    return delay_pairs(wide, sources, 12).drop("correlation")


@query("segments", "WITH " + GRID_SQL + f""",
c AS (SELECT series_id, field, pos, coalesce(abs(value - lag(value) OVER ({BY_FIELD})) > 20.0, false)::INT AS changed FROM grid),
r AS (SELECT *, sum(changed) OVER ({BY_FIELD} ROWS UNBOUNDED PRECEDING) AS run FROM c),
l AS (SELECT series_id, field, run, count(*) AS length, sum(changed) AS changed FROM r GROUP BY 1, 2, 3)
SELECT series_id, field, {sig_sql("1 - sum(changed) / sum(length)")} AS stable_fraction, CAST(sum(changed) AS BIGINT) AS change_points,
  max(length) AS longest_constant_run, quantile_cont(length::DOUBLE, 0.5) AS median_constant_run FROM l GROUP BY 1, 2
""")
def segments(spark, sf):
    return segment_statistics(hourly_grid(spark, sf), 20.0).withColumn("stable_fraction", sig("stable_fraction", "stable_fraction"))


@query("setpoints", "WITH " + GRID_SQL + f""",
s AS (SELECT series_id, field, round_even(value / 5.0, 0) * 5.0 AS setpoint, count(*) AS sample_count FROM grid WHERE value IS NOT NULL GROUP BY 1, 2, 3)
SELECT series_id, field, setpoint, sample_count, {sig_sql("sample_count / total")} AS fraction, CAST(rk AS INTEGER) AS rank FROM (
  SELECT *, sum(sample_count) OVER (PARTITION BY series_id, field) AS total,
  row_number() OVER (PARTITION BY series_id, field ORDER BY sample_count DESC, setpoint) AS rk FROM s) WHERE rk <= 10
""")
def setpoints_query(spark, sf):
    return setpoints(hourly_grid(spark, sf), 5.0).withColumn("fraction", sig("fraction", "fraction"))


@query("plan_fields", """
SELECT DISTINCT event_type AS field, true AS available_at_origin, true AS allow_short, false AS allow_long, '' AS pending
FROM events WHERE event_type = 'purchase'
""")
def plan_fields_query(spark, sf):
    return plan_fields(readings(spark, sf).select("field").distinct(), registry_table(spark, RULES))

