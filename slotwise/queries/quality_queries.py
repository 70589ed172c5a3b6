"""Input-matrix quality and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.operators.clean import CleanRule, OutlierRule
from slotwise.plans.contracts import (
    bundle_rules, count_rules, forecast_frame_rules, input_frame_rules, missing_origins, origin_difference, plan_frame_rules,
)
from slotwise.plans.forecast import forecast, pivot_forecast
from slotwise.plans.quality import (
    assemble_input, fill_from_training, outlier_counts, profile, prune_features, quality_report, repair_scoring, signatures,
    winsorise, with_history,
)
from slotwise.queries.base import (
    BY_FIELD, BY_SITE, GRID_SQL, HOUR, WIDE_SQL, hourly_grid, hourly_wide, query, sig, sig_sql, table,
)
from slotwise.queries.forecast_queries import MEAN

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_KEYS = ("l_orderkey", "l_linenumber")


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE_KEYS, *NUMBERS)


LONG_LINES = "cells AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM lineitem" for c in NUMBERS) + ")"


@query("profile", "WITH " + LONG_LINES + f"""
SELECT "column", count(*) AS rows, count(*) - count(v) AS nonfinite, {sig_sql("avg(v)")} AS mean, {sig_sql("stddev_pop(v)")} AS std,
  min(v) AS low, max(v) AS high, count(DISTINCT v) AS distinct_values, {sig_sql("quantile_cont(v, 0.25)")} AS q1,
  {sig_sql("quantile_cont(v, 0.75)")} AS q3, {sig_sql("quantile_cont(v, 0.5)")} AS median
FROM cells GROUP BY 1
""")
def profile_query(spark, sf):
    out = profile(lines(spark, sf), NUMBERS, LINE_KEYS)
    return out.select(*[sig(c) if c in ("mean", "std", "q1", "q3", "median") else c for c in out.columns])


def _order_bounds(extra: str = "") -> str:
    return f"""
r AS (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY "column") AS n FROM cells),
o AS (SELECT "column", max(n) AS n,
  max(v) FILTER (k = floor((n - 1) * 0.25)) AS a1, max(v) FILTER (k = ceil((n - 1) * 0.25)) AS b1,
  max(v) FILTER (k = floor((n - 1) * 0.75)) AS a3, max(v) FILTER (k = ceil((n - 1) * 0.75)) AS b3 FROM r GROUP BY 1),
q AS (SELECT "column", a1 + (b1 - a1) * ((n - 1) * 0.25 - floor((n - 1) * 0.25)) AS l1, a3 + (b3 - a3) * ((n - 1) * 0.75 - floor((n - 1) * 0.75)) AS l3,
  a1, b1, a3, b3, (a1 + b1) / 2 AS m1, (a3 + b3) / 2 AS m3,
  CASE WHEN (n - 1) * 0.25 - floor((n - 1) * 0.25) < 0.5 OR ((n - 1) * 0.25 - floor((n - 1) * 0.25) = 0.5 AND floor((n - 1) * 0.25) % 2 = 0) THEN a1 ELSE b1 END AS n1,
  CASE WHEN (n - 1) * 0.75 - floor((n - 1) * 0.75) < 0.5 OR ((n - 1) * 0.75 - floor((n - 1) * 0.75) = 0.5 AND floor((n - 1) * 0.75) % 2 = 0) THEN a3 ELSE b3 END AS n3
  FROM o),
z AS (SELECT "column", avg(v) AS mu, stddev_pop(v) AS sd FROM cells GROUP BY 1)"""


def _out(a: str, b: str) -> str:
    return f"(v < {a} - 1.5 * ({b} - {a}) OR v > {b} + 1.5 * ({b} - {a}))"


# totals per order are the skewed column of the matrix
ORDER_CELLS = """cells AS (SELECT 'total' AS "column", v FROM (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1)
  UNION ALL SELECT 'orders', n::DOUBLE FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
  UNION ALL SELECT 'largest', m FROM (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1))"""
CUSTOMER_NUMBERS = ("total", "orders", "largest")


def customers(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).cast("double").alias("orders"), F.max("o_totalprice").alias("largest"))


@query("iqr_variants", "WITH " + ORDER_CELLS + "," + _order_bounds() + f"""
SELECT "column", count(*) FILTER ({_out("l1", "l3")}) AS iqr_linear, count(*) FILTER ({_out("a1", "a3")}) AS iqr_lower,
  count(*) FILTER ({_out("b1", "b3")}) AS iqr_higher, count(*) FILTER ({_out("m1", "m3")}) AS iqr_midpoint,
  count(*) FILTER ({_out("n1", "n3")}) AS iqr_nearest,
  count(*) FILTER ({_out("l1", "l3")} OR {_out("a1", "a3")} OR {_out("b1", "b3")} OR {_out("m1", "m3")} OR {_out("n1", "n3")}) AS iqr_any,
  count(*) FILTER (sd > 0 AND abs(v - mu) > 2 * sd) AS zscore
FROM cells JOIN q USING ("column") JOIN z USING ("column") GROUP BY 1
""")
def iqr_variants(spark, sf):
    return outlier_counts(customers(spark, sf), CUSTOMER_NUMBERS, zscore=2.0, keys=["o_custkey"])


@query("dup_columns", "WITH " + LONG_LINES + """
SELECT "column", constant, duplicate_of FROM (
  SELECT "column", count(DISTINCT v) <= 1 AS constant, NULL AS duplicate_of FROM cells GROUP BY 1
  UNION ALL SELECT 'qty_copy', false, 'l_quantity' UNION ALL SELECT 'same', true, NULL)
""")
def dup_columns(spark, sf):
    matrix = lines(spark, sf).withColumns({"qty_copy": F.col("l_quantity") + 0, "same": F.lit(5.0)})
    return quality_report(matrix, (*NUMBERS, "qty_copy", "same"), keys=LINE_KEYS, interpolations=("linear",)).select(
        "column", "constant", "duplicate_of")


@query("column_signatures", "WITH " + LONG_LINES + """SELECT "column", count(v) AS filled FROM cells GROUP BY 1""")
def column_signatures(spark, sf):
    return signatures(lines(spark, sf), NUMBERS, LINE_KEYS).select("column", "filled")


@query("prune_features", "WITH " + WIDE_SQL + """
SELECT 'view,click' AS kept, 'empty' AS all_nonfinite, 'flat' AS "constant", 'view_copy' AS duplicate,
  count(*) AS rows FROM wide
""")
def prune_features_query(spark, sf):
    wide = hourly_wide(spark, sf).withColumns({
        "view_copy": F.col("view"), "flat": F.lit(1.0), "empty": F.lit(float("nan"))})
    found = prune_features(wide, ["view", "view_copy", "click", "flat", "empty"])
    text = lambda names: F.lit(",".join(names))
    return wide.agg(F.count(F.lit(1)).alias("rows")).select(
        text(found.kept).alias("kept"), text(found.all_nonfinite).alias("all_nonfinite"), text(found.constant).alias("constant"),
        text(found.duplicate).alias("duplicate"), "rows")


SPLIT_SQL = GRID_SQL + """,
cut AS (SELECT series_id, hi - 95 AS s FROM span),
train AS (SELECT g.* FROM grid g JOIN cut USING (series_id) WHERE pos < s),
scoring AS (SELECT g.* FROM grid g JOIN cut USING (series_id) WHERE pos >= s),
med AS (SELECT field, quantile_cont(value, 0.5) AS med FROM train WHERE value IS NOT NULL GROUP BY 1)
"""


def halves(spark, sf):
    grid = hourly_grid(spark, sf)
    ends = grid.groupBy("series_id").agg((F.max("pos") - 95).alias("_s"))
    marked = grid.join(ends, "series_id")
    return marked.where("pos < _s").drop("_s"), marked.where("pos >= _s").drop("_s")


@query("history_union", "WITH " + SPLIT_SQL + f"""
SELECT series_id, field, pos, {sig_sql("value")} AS value FROM (
  SELECT t.series_id, t.field, t.pos, t.value FROM train t JOIN cut USING (series_id) WHERE pos >= s - 48 UNION ALL SELECT series_id, field, pos, value FROM scoring)
""")
def history_union(spark, sf):
    training, scoring = halves(spark, sf)
    return with_history(training, scoring, 48).select("series_id", "field", "pos", sig("value"))


REPAIR_SQL = SPLIT_SQL + f""",
ctx AS (SELECT t.series_id, t.field, t.pos, t.value FROM train t JOIN cut USING (series_id) WHERE pos >= s - 200 UNION ALL SELECT * FROM scoring),
q AS (SELECT *, CASE WHEN count(value) OVER p >= 12 THEN quantile_cont(value, 0.25) OVER p END AS q1,
  CASE WHEN count(value) OVER p >= 12 THEN quantile_cont(value, 0.5) OVER p END AS q2,
  CASE WHEN count(value) OVER p >= 12 THEN quantile_cont(value, 0.75) OVER p END AS q3
  FROM ctx WINDOW p AS ({BY_FIELD} ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, coalesce(q3 - q1 > 0 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)), false) AS bad FROM q),
ro AS (SELECT *, last_value(value IGNORE NULLS) OVER ({BY_FIELD}) AS filled, CASE WHEN bad THEN q2 ELSE value END AS r0 FROM m),
r1 AS (SELECT *, coalesce(r0, filled) AS robust FROM ro),
r2 AS (SELECT *, last_value(robust IGNORE NULLS) OVER ({BY_FIELD}) AS carried FROM r1),
rep AS (SELECT r2.series_id, r2.pos, r2.field, coalesce(carried, med) AS value, bad::INT AS outlier, (r2.value IS NULL)::INT AS was_missing
  FROM r2 JOIN cut USING (series_id) JOIN med USING (field) WHERE pos >= s)
"""
REPAIR = CleanRule(OutlierRule("iqr", 48, 12, 1.5))


def _repaired(spark, sf):
    training, scoring = halves(spark, sf)
    return repair_scoring(training, scoring, scoring.select("series_id", "pos"), REPAIR, 200)


@query("repair_scoring", "WITH " + REPAIR_SQL + f"SELECT series_id, pos, field, {sig_sql('value')} AS value FROM rep")
def repair_scoring_query(spark, sf):
    repaired, _ = _repaired(spark, sf)
    return repaired.select("series_id", "pos", "field", sig("value"))


@query("repair_counts", "WITH " + REPAIR_SQL + """
SELECT field, CAST(sum(was_missing) AS BIGINT) AS missing_repairs, CAST(sum(outlier) AS BIGINT) AS outlier_repairs FROM rep GROUP BY 1
""")
def repair_counts(spark, sf):
    _, counts = _repaired(spark, sf)
    return counts


@query("fill_from_training", "WITH " + SPLIT_SQL + f""",
w AS (SELECT series_id, field, pos, coalesce(last_value(value IGNORE NULLS) OVER ({BY_FIELD}), med) AS v FROM scoring JOIN med USING (field))
SELECT series_id, pos, {sig_sql("max(v) FILTER (field = 'click')")} AS click, {sig_sql("max(v) FILTER (field = 'view')")} AS view
FROM w GROUP BY 1, 2
""")
def fill_from_training_query(spark, sf):
    from slotwise.operators.grid import widen

    training, scoring = (widen(part, ["click", "view"]) for part in halves(spark, sf))
    return fill_from_training(scoring, training, ["click", "view"]).select("series_id", "pos", sig("click"), sig("view"))


def _wins_sql(passes: int) -> str:
    out = """c0 AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1)"""
    for i in range(1, passes + 1):
        out += f""",
f{i} AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM c{i - 1}),
h{i} AS (SELECT count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS hits FROM c{i - 1}, f{i}),
c{i} AS (SELECT o_custkey, CASE WHEN hits > 0 THEN least(greatest(v, q1 - (q3 - q1)), q3 + (q3 - q1)) ELSE v END AS v FROM c{i - 1}, f{i}, h{i})"""
    return out


@query("winsorise", "WITH " + _wins_sql(10) + f"SELECT o_custkey, {sig_sql('v')} AS total FROM c10")
def winsorise_query(spark, sf):
    mended, _ = winsorise(customers(spark, sf).withColumn("flat", F.lit(1.0)), ("total", "flat"), zscore=9.0, keys=["o_custkey"])
    return mended.select("o_custkey", sig("total"))


@query("winsorise_log", "WITH " + _wins_sql(10) + """
SELECT * FROM (SELECT 0 AS "pass", 'flat' AS "column", 'constant' AS action, CAST(0 AS BIGINT) AS cells
""" + "".join(f"UNION ALL SELECT {i}, 'total', 'winsorised', hits FROM h{i} WHERE hits > 0\n" for i in range(1, 11)) + ")")
def winsorise_log(spark, sf):
    _, log = winsorise(customers(spark, sf).withColumn("flat", F.lit(1.0)), ("total", "flat"), zscore=9.0, keys=["o_custkey"])
    return log


@query("input_contract", "WITH " + WIDE_SQL + f""",
s AS (SELECT *, lag(pos) OVER ({BY_SITE}) AS prev, (click IS NULL)::INT + (view IS NULL)::INT AS bad FROM wide)
SELECT series_id, min(pos) AS lo, max(pos) AS hi, count(*) AS rows, count(*) FILTER (pos = prev) AS repeated,
  count(*) FILTER (pos - prev > 1) AS holes, CAST(sum(bad) AS BIGINT) AS non_finite,
  CASE WHEN count(*) FILTER (pos = prev) = 0 AND count(*) FILTER (pos - prev > 1) = 0 AND sum(bad) = 0 THEN 'passed' ELSE 'failed' END AS status
FROM s GROUP BY 1
""")
def input_contract(spark, sf):
    return input_frame_rules(hourly_wide(spark, sf), ["click", "view"])


@query("origin_difference", "WITH " + GRID_SQL + """,
f AS (SELECT DISTINCT series_id, pos FROM grid WHERE value IS NOT NULL AND field = 'click'),
o AS (SELECT DISTINCT series_id, pos FROM grid WHERE value IS NOT NULL AND field = 'view')
SELECT series_id, pos, 'missing' AS problem FROM o WHERE (series_id, pos) NOT IN (SELECT (series_id, pos) FROM f)
UNION ALL SELECT series_id, pos, 'unexpected' FROM f WHERE (series_id, pos) NOT IN (SELECT (series_id, pos) FROM o)
""")
def origin_difference_query(spark, sf):
    present = hourly_grid(spark, sf).where("value IS NOT NULL")
    return origin_difference(present.where("field = 'click'"), present.where("field = 'view'"))


@query("missing_origins", "WITH " + GRID_SQL + """,
f AS (SELECT DISTINCT series_id, pos FROM grid WHERE value IS NOT NULL AND field = 'click')
SELECT DISTINCT g.series_id, g.pos FROM grid g LEFT JOIN f ON f.series_id = g.series_id AND f.pos = g.pos WHERE f.pos IS NULL
""")
def missing_origins_query(spark, sf):
    grid = hourly_grid(spark, sf)
    return missing_origins(grid.select("series_id", "pos").distinct(), grid.where("value IS NOT NULL AND field = 'click'"))


def _wide_forecast(spark, sf):
    grid = hourly_grid(spark, sf).where(F.col("field").isin("click", "view"))
    tidy = forecast(grid, [MEAN], (1, 2)).withColumnRenamed("mean_8", "y_pred")
    from slotwise.functions.slots import slot_start

    wide = pivot_forecast(tidy, ("click", "view"), (1, 2), 60)
    return wide.select("series_id", F.date_format(slot_start("pos", HOUR), "yyyy-MM-dd HH:mm:ss").alias("datetime"),
                       *[F.col(f"`{c}`") for c in wide.columns[2:]])


from slotwise.queries.forecast_queries import STATE_SQL as _STATE  # noqa: E402

_FRAME_SQL = "WITH " + _STATE + """,
w AS (SELECT series_id, pos, max(mean8) FILTER (field = 'click') AS c, max(mean8) FILTER (field = 'view') AS v FROM hist
  WHERE field IN ('click', 'view') GROUP BY 1, 2),
n AS (SELECT count(*) FILTER (c IS NULL OR v IS NULL) AS nf, count(*) FILTER (c > 80) AS cc, count(*) FILTER (c > v + 1e-6 OR c IS NULL OR v IS NULL) AS pt FROM w),
k AS (SELECT * FROM (SELECT 'time_format' AS "check", CAST(0 AS BIGINT) AS broken UNION ALL SELECT 'non_finite', nf FROM n UNION ALL SELECT 'negative', 0
  UNION ALL SELECT 'capacity_click', cc FROM n UNION ALL SELECT 'part_over_total', pt FROM n UNION ALL SELECT 'unique_origin', 0
  UNION ALL SELECT 'empty', CAST((SELECT count(*) = 0 FROM w) AS BIGINT)))
"""


@query("forecast_contract", _FRAME_SQL + """SELECT "check", broken, CASE WHEN broken = 0 THEN 'passed' ELSE 'failed' END AS status FROM k""")
def forecast_contract(spark, sf):
    return forecast_frame_rules(_wide_forecast(spark, sf), ("click", "view"), (1, 2), 60, {"click": 80.0}, "click", "view")


@query("forecast_contract_planted", """
WITH w0 AS (SELECT * FROM w), gone AS (SELECT count(*) AS n FROM w WHERE pos % 7 = 0),
f AS (SELECT 'origins' AS "check", n AS broken FROM gone
UNION ALL SELECT 'negative', count(*) FILTER (pos % 7 <> 0 AND c - 20 < -1e-6) FROM w
UNION ALL SELECT 'capacity_click', count(*) FILTER (pos % 7 <> 0 AND c - 20 > 30 + 1e-6) FROM w)
SELECT "check", broken, CASE WHEN broken = 0 THEN 'passed' ELSE 'failed' END AS status FROM f
""".replace("WITH w0 AS (SELECT * FROM w),", _FRAME_SQL.rsplit("n AS (", 1)[0]))
def forecast_contract_planted(spark, sf):
    """Every seventh origin is missing, and all click forecasts are 20 too low."""
    whole = _wide_forecast(spark, sf)
    clicks = [c for c in whole.columns if c.startswith("click")]
    hour = F.unix_timestamp("datetime", "yyyy-MM-dd HH:mm:ss") / HOUR
    faulty = whole.where(hour % 7 != 0).withColumns({c: F.col(f"`{c}`") - 20 for c in clicks})
    rules = forecast_frame_rules(faulty, ("click", "view"), (1, 2), 60, {"click": 30.0}, "click", "view", origins=whole)
    return rules.where(F.col("check").isin("origins", "negative", "capacity_click"))


@query("plan_contract", "WITH " + WIDE_SQL + """
SELECT 'non_finite' AS "check", count(*) FILTER (click IS NULL OR view IS NULL) AS broken,
  CASE WHEN count(*) FILTER (click IS NULL OR view IS NULL) = 0 THEN 'passed' ELSE 'failed' END AS status FROM wide
UNION ALL SELECT 'negative', count(*) FILTER (click - 20 < 0), CASE WHEN count(*) FILTER (click - 20 < 0) = 0 THEN 'passed' ELSE 'failed' END FROM wide
UNION ALL SELECT 'no_time', count(*) FILTER (pos IS NULL), CASE WHEN count(*) FILTER (pos IS NULL) = 0 THEN 'passed' ELSE 'failed' END FROM wide
UNION ALL SELECT 'unique_time', count(*) - count(DISTINCT (series_id, pos)), CASE WHEN count(*) = count(DISTINCT (series_id, pos)) THEN 'passed' ELSE 'failed' END FROM wide
UNION ALL SELECT 'empty', (count(*) = 0)::BIGINT, CASE WHEN count(*) > 0 THEN 'passed' ELSE 'failed' END FROM wide
""")
def plan_contract(spark, sf):
    wide = hourly_wide(spark, sf)
    return plan_frame_rules(wide.select("series_id", F.col("pos").alias("datetime"), (F.col("click") - 20).alias("opt_a"), F.col("view").alias("opt_b")))


@query("bundle_contract", _FRAME_SQL + """
SELECT 'short' AS "table", "check", broken, CASE WHEN broken = 0 THEN 'passed' ELSE 'failed' END AS status FROM k
UNION ALL SELECT 'orders', 'negative', count(*) FILTER (o_totalprice < 0), 'passed' FROM orders
""")
def bundle_contract(spark, sf):
    short = forecast_frame_rules(_wide_forecast(spark, sf), ("click", "view"), (1, 2), 60, {"click": 80.0}, "click", "view")
    return bundle_rules({"short": short, "orders": count_rules(table(spark, sf, "orders"), {"negative": F.col("o_totalprice") < 0})})


@query("model_input", "WITH " + WIDE_SQL + f"""
SELECT series_id, pos, {sig_sql("click")} AS click, {sig_sql("view")} AS view, {sig_sql(f"lag(click) OVER ({BY_SITE})")} AS feat_lag_click
FROM wide
""")
def model_input(spark, sf):
    from slotwise.operators.blocks import with_halo

    wide = hourly_wide(spark, sf)
    features = with_halo(wide, ["series_id"], lambda rows, w: rows.select("*", F.lag("click").over(w).alias("feat_lag_click")), back=1)
    out = assemble_input(wide.select("series_id", "pos", "click", "view"), features.select("series_id", "pos", "feat_lag_click"))
    return out.select("series_id", "pos", *[sig(c) for c in ("click", "view", "feat_lag_click")])

