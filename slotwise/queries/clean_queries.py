"""Missing runs, fills, outlier flags, the cleaning report."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.operators.clean import (
    CleanRule, OutlierRule, clean, cleaning_report, constant_runs, drop_empty_fields, flag_outliers, missing_and_fill,
)
from slotwise.queries.base import BY_FIELD, GRID_SQL, hourly_grid, query, rounded

SEEN = f"""
seen AS (
  SELECT *, min(pos) OVER (PARTITION BY series_id, field) AS start,
    last_value(value IGNORE NULLS) OVER ({BY_FIELD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_v,
    last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS)
      OVER ({BY_FIELD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_p
  FROM grid)
"""


@query("missing_run", "WITH " + GRID_SQL + "," + SEEN + """
SELECT series_id, field, pos, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS missing,
       CAST(pos - coalesce(last_p, start - 1) AS INTEGER) AS missing_run
FROM seen
""")
def missing_run(spark, sf):
    return missing_and_fill(hourly_grid(spark, sf)).select("series_id", "field", "pos", "missing", "missing_run")


@query("ffill_limit", "WITH " + GRID_SQL + "," + f"""
f AS (SELECT series_id, field, pos,
  last_value(value IGNORE NULLS) OVER ({BY_FIELD} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS filled FROM grid)
SELECT series_id, field, pos, round(filled, 6) AS filled FROM f
""")
def ffill_limit(spark, sf):
    return missing_and_fill(hourly_grid(spark, sf), limit=2).select("series_id", "field", "pos", *rounded(["filled"]))


@query("ffill_unlimited", "WITH " + GRID_SQL + "," + SEEN + """
SELECT series_id, field, pos, round(last_v, 6) AS filled FROM seen
""")
def ffill_unlimited(spark, sf):
    return missing_and_fill(hourly_grid(spark, sf), block=128).select(
        "series_id", "field", "pos", *rounded(["filled"]))


def _quartiles(window: int, least: int) -> str:
    frame = f"OVER ({BY_FIELD} ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
    return f"""
  CASE WHEN count(value) {frame} >= {least} THEN quantile_cont(value, 0.25) {frame} END AS q1,
  CASE WHEN count(value) {frame} >= {least} THEN quantile_cont(value, 0.5) {frame} END AS q2,
  CASE WHEN count(value) {frame} >= {least} THEN quantile_cont(value, 0.75) {frame} END AS q3
"""


IQR_SQL = "WITH " + GRID_SQL + f""",
q AS (SELECT *, {_quartiles(96, 24)} FROM grid),
m AS (SELECT *, coalesce(q3 - q1 > 0 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)), false) AS bad
      FROM q)
"""
IQR = OutlierRule("iqr", 96, 24, 1.5)


@query("iqr_flag", IQR_SQL + """
SELECT series_id, field, pos, CAST(bad AS INTEGER) AS outlier, round(CASE WHEN bad THEN q2 ELSE value END, 6) AS robust
FROM m
""")
def iqr_flag(spark, sf):
    return flag_outliers(hourly_grid(spark, sf), IQR).select(
        "series_id", "field", "pos", "outlier", *rounded(["robust"]))


@query("hampel_flag", "WITH " + GRID_SQL + f""",
a AS (SELECT *, lag(value) OVER ({BY_FIELD}) AS history,
  CASE WHEN count(value) OVER ({BY_FIELD} ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) >= 12
    THEN quantile_cont(value, 0.5) OVER ({BY_FIELD} ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) END AS med FROM grid),
b AS (SELECT *, abs(history - med) AS dev FROM a),
c AS (SELECT *,
  CASE WHEN count(dev) OVER ({BY_FIELD} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) >= 12
    THEN 1.4826 * quantile_cont(dev, 0.5) OVER ({BY_FIELD} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) END AS sc FROM b),
d AS (SELECT *, coalesce(sc > 0 AND (value < med - 3 * sc OR value > med + 3 * sc), false) AS bad FROM c)
SELECT series_id, field, pos, CAST(bad AS INTEGER) AS outlier, round(CASE WHEN bad THEN med ELSE value END, 6) AS robust
FROM d
""")
def hampel_flag(spark, sf):
    rule = OutlierRule("hampel", 48, 12, 3.0)
    return flag_outliers(hourly_grid(spark, sf), rule, block=256).select(
        "series_id", "field", "pos", "outlier", *rounded(["robust"]))


CLEAN_SQL = IQR_SQL + f""",
f AS (SELECT *, min(pos) OVER (PARTITION BY series_id, field) AS start,
  last_value(value IGNORE NULLS) OVER ({BY_FIELD} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS filled,
  last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS)
    OVER ({BY_FIELD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_p
  FROM m),
cleaned AS (
  SELECT series_id, field, pos, value, CAST(bad AS INTEGER) AS outlier, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS missing,
    pos - coalesce(last_p, start - 1) AS missing_run, filled,
    coalesce(CASE WHEN bad THEN q2 ELSE value END, filled) AS robust
  FROM f)
"""
CLEAN = CleanRule(IQR, "ffill", 8)


@query("clean_causal", CLEAN_SQL + """
SELECT series_id, field, pos, outlier, missing, round(filled, 6) AS filled, round(robust, 6) AS robust FROM cleaned
""")
def clean_causal(spark, sf):
    return drop_empty_fields(clean(hourly_grid(spark, sf), CLEAN)).select(
        "series_id", "field", "pos", "outlier", "missing", *rounded(["filled", "robust"]))


@query("cleaning_report", CLEAN_SQL + """
SELECT series_id, field, count(*) AS slots, CAST(sum(outlier) AS BIGINT) AS outliers,
       CAST(sum(missing) AS BIGINT) AS missing_before, count(*) - count(filled) AS missing_after,
       CAST(max(missing_run) AS INTEGER) AS longest_gap, count(filled) = 0 AS dropped
FROM cleaned GROUP BY 1, 2
""")
def cleaning_report_query(spark, sf):
    return cleaning_report(clean(hourly_grid(spark, sf), CLEAN))


@query("constant_runs", "WITH " + GRID_SQL + f""",
c AS (SELECT series_id, field, pos, value,
  coalesce(abs(value - lag(value) OVER ({BY_FIELD})) > 5.0, false)::INT AS changed FROM grid),
r AS (SELECT *, sum(changed) OVER ({BY_FIELD} ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT series_id, field, CAST(run AS BIGINT) AS run, count(value) AS length, CAST(min(pos) AS BIGINT) AS first_pos
FROM r GROUP BY 1, 2, 3
""")
def constant_runs_query(spark, sf):
    return constant_runs(hourly_grid(spark, sf), 5.0, block=200).groupBy("series_id", "field", "run").agg(
        F.count("value").alias("length"), F.min("pos").alias("first_pos"))
