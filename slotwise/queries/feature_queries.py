"""Lags, rolling statistics, EWMA, calendar, season deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions.clock import calendar
from slotwise.operators.features import ewma, lag_features, rolling_features, season_deltas
from slotwise.queries.base import BY_FIELD, GRID_SQL, hourly_grid, query, rounded, sig_sql, sigs, table


@query("lag_diff", "WITH " + GRID_SQL + f"""
SELECT series_id, field, pos, round(value - lag(value, 1) OVER w, 6) AS diff_1, round(value - lag(value, 4) OVER w, 6) AS diff_4,
       round(value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w, 6) AS accel,
       round(lag(value, 1) OVER w, 6) AS lag_1, round(lag(value, 24) OVER w, 6) AS lag_24,
       round(lag(value, 168) OVER w, 6) AS lag_168
FROM grid WINDOW w AS ({BY_FIELD})
""")
def lag_diff(spark, sf):
    names = ["diff_1", "diff_4", "accel", "lag_1", "lag_24", "lag_168"]
    out = lag_features(hourly_grid(spark, sf), (1, 24, 168), block=256)
    return out.select("series_id", "field", "pos", *rounded(names))


def _rolling_sql(windows, stats) -> str:
    rules = {"mean": "avg(value)", "std": "stddev_pop(value)", "min": "min(value)", "max": "max(value)",
             "slope": "regr_slope(value, pos - base)", "q10": "quantile_cont(value, 0.1)", "q90": "quantile_cont(value, 0.9)", "median": "quantile_cont(value, 0.5)"}
    cells = []
    for w in windows:
        frame = f"OVER ({BY_FIELD} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        for s in stats:
            cells.append(sig_sql(f"CASE WHEN count(value) {frame} >= {max(2, w // 2)} THEN {rules[s]} {frame} END") + f" AS roll_{w}_{s}")
    return ",\n".join(cells)


@query("rolling_stats", "WITH " + GRID_SQL + ", g2 AS (SELECT *, min(pos) OVER () AS base FROM grid)\nSELECT series_id, field, pos,\n"
       + _rolling_sql((4, 8, 24), ("mean", "std", "min", "max")) + "\nFROM g2")
def rolling_stats(spark, sf):
    out = rolling_features(hourly_grid(spark, sf), (4, 8, 24), ("mean", "std", "min", "max"))
    names = [f"roll_{w}_{s}" for w in (4, 8, 24) for s in ("mean", "std", "min", "max")]
    return out.select("series_id", "field", "pos", *sigs(names))


@query("rolling_slope_quantiles", "WITH " + GRID_SQL + ", g2 AS (SELECT *, min(pos) OVER () AS base FROM grid)\nSELECT series_id, field, pos,\n"
       + _rolling_sql((8, 24), ("slope", "q10", "q90")) + "\nFROM g2")
def rolling_slope_quantiles(spark, sf):
    out = rolling_features(hourly_grid(spark, sf), (8, 24), ("slope", "q10", "q90"), block=128)
    names = [f"roll_{w}_{s}" for w in (8, 24) for s in ("slope", "q10", "q90")]
    return out.select("series_id", "field", "pos", *sigs(names))


@query("rolling_quantiles_long", "WITH " + GRID_SQL + "\nSELECT series_id, field, pos,\n"
       + _rolling_sql((96, 672), ("q10", "median", "q90")) + "\nFROM grid")
def rolling_quantiles_long(spark, sf):
    out = rolling_features(hourly_grid(spark, sf), (96, 672), ("q10", "median", "q90"), block=256)
    names = [f"roll_{w}_{s}" for w in (96, 672) for s in ("q10", "median", "q90")]
    return out.select("series_id", "field", "pos", *sigs(names))


@query("ewma", "WITH RECURSIVE " + GRID_SQL + """,
obs AS (
  SELECT series_id, field, pos, value, row_number() OVER w AS k,
         pos - lag(pos) OVER w AS gap
  FROM grid WHERE value IS NOT NULL WINDOW w AS (PARTITION BY series_id, field ORDER BY pos)),
step AS (
  SELECT series_id, field, pos, k, value AS mean FROM obs WHERE k = 1
  UNION ALL
  SELECT o.series_id, o.field, o.pos, o.k,
         (pow(7.0 / 9.0, o.gap) * s.mean + (2.0 / 9.0) * o.value) / (pow(7.0 / 9.0, o.gap) + 2.0 / 9.0)
  FROM step s JOIN obs o ON o.series_id = s.series_id AND o.field = s.field AND o.k = s.k + 1),
filled AS (
  SELECT g.series_id, g.field, g.pos,
         last_value(s.mean IGNORE NULLS) OVER w AS mean, last_value(s.k IGNORE NULLS) OVER w AS k
  FROM grid g LEFT JOIN step s USING (series_id, field, pos)
  WINDOW w AS (PARTITION BY g.series_id, g.field ORDER BY g.pos ROWS UNBOUNDED PRECEDING))
SELECT series_id, field, pos, round(CASE WHEN k >= 2 THEN mean END, 6) AS ewma FROM filled
""")
def ewma_query(spark, sf):
    return ewma(hourly_grid(spark, sf)).select("series_id", "field", "pos", *rounded(["ewma"]))


@query("season_deltas", "WITH " + GRID_SQL + f"""
SELECT series_id, field, pos, round(value - lag(value, 24) OVER w, 6) AS same_slot_day_delta,
       round(value - lag(value, 168) OVER w, 6) AS same_slot_week_delta
FROM grid WINDOW w AS ({BY_FIELD})
""")
def season_deltas_query(spark, sf):
    out = season_deltas(hourly_grid(spark, sf), {"day": 24, "week": 168})
    return out.select("series_id", "field", "pos", *rounded(["same_slot_day_delta", "same_slot_week_delta"]))


@query("calendar", """
SELECT event_id, round(sin(2 * pi() * m / 1440), 9) AS feat_time_day_sin, round(cos(2 * pi() * m / 1440), 9) AS feat_time_day_cos,
  round(sin(2 * pi() * (d * 1440 + m) / 10080), 9) AS feat_time_week_sin,
  round(cos(2 * pi() * (d * 1440 + m) / 10080), 9) AS feat_time_week_cos,
  CAST(hour(ts) AS INTEGER) AS feat_time_hour, CAST(minute(ts) AS INTEGER) AS feat_time_minute,
  CAST(m // 15 AS INTEGER) AS feat_time_slot, CAST(month(ts) AS INTEGER) AS feat_time_month,
  CAST(d AS INTEGER) AS feat_time_dayofweek, CAST(d >= 5 AS INTEGER) AS feat_time_is_weekend
FROM (SELECT event_id, ts, hour(ts) * 60 + minute(ts) AS m, isodow(ts) - 1 AS d FROM events)
""")
def calendar_query(spark, sf):
    parts = calendar("ts")
    waves = {n for n in parts if n.endswith(("_sin", "_cos"))}
    return table(spark, sf, "events").select(
        "event_id", *[(F.round(c, 9) if n in waves else c).alias(n) for n, c in parts.items()])


@query("calendar_target", """
SELECT event_id, h AS horizon, CAST(hour(t) AS INTEGER) AS target_hour, CAST(minute(t) AS INTEGER) AS target_minute,
  CAST(month(t) AS INTEGER) AS target_month, CAST(isodow(t) - 1 AS INTEGER) AS target_dayofweek,
  round(sin(2 * pi() * (hour(t) * 60 + minute(t)) / 1440), 9) AS target_day_sin,
  CAST(month(t) <> month(ts) AS INTEGER) AS month_change, CAST(isodow(ts) >= 6 AS INTEGER) AS weekend
FROM (SELECT event_id, ts, h, ts + to_minutes(CAST(15 * h AS INTEGER)) AS t FROM events, unnest([1, 4, 96]) AS x(h))
""")
def calendar_target(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts", F.explode(F.array(*map(F.lit, (1, 4, 96)))).alias("horizon"))
    zero = F.lit(0)
    rows = rows.withColumn("t", F.col("ts") + F.make_dt_interval(zero, zero, F.col("horizon") * 15))
    parts = calendar("t", prefix="target_")
    keep = ("target_hour", "target_minute", "target_month", "target_dayofweek")
    return rows.select(
        "event_id", "horizon", *[parts[n].alias(n) for n in keep],
        F.round(parts["target_day_sin"], 9).alias("target_day_sin"),
        (F.month("t") != F.month("ts")).cast("int").alias("month_change"),
        (F.weekday("ts") >= 5).cast("int").alias("weekend"))
