"""Binning, alignment, combination, load quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from slotwise.functions.slots import slot_start
from slotwise.operators.grid import align, collapse, lengthen, outer_align, resample, resample_variants
from slotwise.plans.contracts import validate_targets
from slotwise.queries.base import DAY, GRID_SQL, HOUR, TARGETS, hourly_grid, query, readings, rounded, table
from slotwise.sources.tables import FieldSpec, TableSpec, bind_fields, forecast_origins, load_aligned, table_quality


@query("resample_right", """
SELECT event_type AS field, make_timestamp(k * 3600000000) AS ts, avg_v AS mean_value, sum_v AS sum_value,
       min_v AS min_value, max_v AS max_value, first_v AS first_value, last_v AS last_value
FROM (SELECT event_type, CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) AS k,
             round(avg(value), 6) AS avg_v, round(sum(value), 6) AS sum_v, min(value) AS min_v, max(value) AS max_v,
             arg_min(value, event_id) AS first_v, arg_max(value, event_id) AS last_v
      FROM events GROUP BY 1, 2)
""")
def resample_right(spark, sf):
    rows = readings(spark, sf).select(
        "field", "ts", "event_id", *[F.col("value").alias(f"{m}_value") for m in ("mean", "sum", "min", "max", "first", "last")])
    methods = {f"{m}_value": m for m in ("mean", "sum", "min", "max", "first", "last")}
    out = resample(rows, ["field"], "ts", methods, HOUR, ordinal="event_id")
    return out.select("field", slot_start("pos", HOUR).alias("ts"), *rounded(["mean_value", "sum_value"]),
                      "min_value", "max_value", "first_value", "last_value")


@query("resample_variants", """
WITH v AS (
  SELECT event_type AS field, value, unnest([
    {'label': 'left', 'closed': 'left', 'pos': CAST(floor(epoch_us(ts) / 900000000.0) AS BIGINT)},
    {'label': 'left', 'closed': 'right', 'pos': CAST(ceil(epoch_us(ts) / 900000000.0) AS BIGINT) - 1},
    {'label': 'right', 'closed': 'left', 'pos': CAST(floor(epoch_us(ts) / 900000000.0) AS BIGINT) + 1},
    {'label': 'right', 'closed': 'right', 'pos': CAST(ceil(epoch_us(ts) / 900000000.0) AS BIGINT)}]) AS s
  FROM events)
SELECT field, s.label AS label, s.closed AS closed, s.pos AS pos, round(avg(value), 6) AS value
FROM v GROUP BY 1, 2, 3, 4
""")
def resample_variants_query(spark, sf):
    out = resample_variants(readings(spark, sf), ["field"], "ts", {"value": "mean"}, 900)
    return out.select("field", "label", "closed", "pos", *rounded(["value"]))


@query("dup_collapse", """
SELECT l_returnflag AS flag, l_shipdate AS ts, round(avg(l_quantity), 6) AS mean_qty, sum(l_quantity) AS sum_qty,
       min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price,
       arg_min(l_discount, l_orderkey * 10 + l_linenumber) AS first_discount,
       arg_max(l_tax, l_orderkey * 10 + l_linenumber) AS last_tax,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS median_price
FROM (SELECT l_returnflag, l_shipdate, l_quantity, l_extendedprice,
             l_orderkey, l_linenumber,
             first_value(l_discount) OVER w AS l_discount, first_value(l_tax) OVER w2 AS l_tax
      FROM lineitem
      WINDOW w AS (PARTITION BY l_returnflag, l_shipdate, l_orderkey, l_linenumber ORDER BY l_discount),
             w2 AS (PARTITION BY l_returnflag, l_shipdate, l_orderkey, l_linenumber ORDER BY l_tax DESC))
GROUP BY 1, 2
""")
def dup_collapse(spark, sf):
    # equal ordinals are settled by the value, so that first and last are single-valued
    order = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("mean_qty"), F.col("l_quantity").alias("sum_qty"),
        F.col("l_extendedprice").alias("min_price"), F.col("l_extendedprice").alias("max_price"),
        F.col("l_discount").alias("first_discount"), F.col("l_tax").alias("last_tax"),
        F.col("l_extendedprice").alias("median_price"), order["o"].alias("o"))
    first = rows.withColumn("ord", F.struct("o", "first_discount"))
    out = collapse(first, ["flag", "ts"], {
        "mean_qty": "mean", "sum_qty": "sum", "min_price": "min", "max_price": "max",
        "first_discount": "first", "median_price": "median"}, "ord")
    last = collapse(rows.withColumn("ord", F.struct("o", "last_tax")), ["flag", "ts"], {"last_tax": "last"}, "ord")
    return out.join(last, ["flag", "ts"]).select(
        "flag", "ts", *rounded(["mean_qty"]), "sum_qty", "min_price", "max_price", "first_discount", "last_tax",
        *rounded(["median_price"]))


@query("densify_grid", "WITH " + GRID_SQL + """
SELECT series_id, field, pos, round(value, 6) AS value, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS missing
FROM grid
""")
def densify_grid(spark, sf):
    return hourly_grid(spark, sf).select(
        "series_id", "field", "pos", *rounded(["value"]), F.col("value").isNull().cast("int").alias("missing"))


ORDERS_SPEC = TableSpec("orders", "o_orderdate", (
    FieldSpec("order_value", ("o_totalprice",), aggregate="sum"),
    FieldSpec("order_mean", ("o_totalprice",), aggregate="mean")))
LINES_SPEC = TableSpec("lineitem", "l_shipdate", (
    FieldSpec("ship_qty", ("l_quantity",), aggregate="sum"),
    FieldSpec("ship_price", ("l_extendedprice",), aggregate="max")))
LATE_LINES_SPEC = TableSpec("late", "l_shipdate", (FieldSpec("late_price", ("l_extendedprice",), aggregate="min"),))


@query("align_tables", """
WITH o AS (SELECT CAST(ceil(epoch_us(o_orderdate) / 86400000000.0) AS BIGINT) AS pos,
                  sum(o_totalprice) AS s, avg(o_totalprice) AS m FROM orders GROUP BY 1),
l AS (SELECT CAST(ceil(epoch_us(l_shipdate) / 86400000000.0) AS BIGINT) AS pos,
             sum(l_quantity) AS q, max(l_extendedprice) AS p FROM lineitem GROUP BY 1),
b AS (SELECT (SELECT min(pos) FROM o) AS olo, (SELECT max(pos) FROM o) AS ohi,
             (SELECT min(pos) FROM l) AS llo, (SELECT max(pos) FROM l) AS lhi),
g AS (SELECT unnest(generate_series(least(olo, llo), greatest(ohi, lhi))) AS pos FROM b),
wide AS (
  SELECT g.pos, b.*, o.m, o.s, l.q, l.p FROM g CROSS JOIN b LEFT JOIN o USING (pos) LEFT JOIN l USING (pos))
SELECT field, pos, round(value, 6) AS value, gap_inserted FROM (
  SELECT 'order_value' AS field, pos, CASE WHEN pos BETWEEN olo AND ohi THEN coalesce(s, 0) ELSE s END AS value,
         CASE WHEN pos BETWEEN olo AND ohi OR pos BETWEEN llo AND lhi THEN 0 ELSE 1 END AS gap_inserted FROM wide
  UNION ALL SELECT 'order_mean', pos, m,
         CASE WHEN pos BETWEEN olo AND ohi OR pos BETWEEN llo AND lhi THEN 0 ELSE 1 END FROM wide
  UNION ALL SELECT 'ship_qty', pos, CASE WHEN pos BETWEEN llo AND lhi THEN coalesce(q, 0) ELSE q END,
         CASE WHEN pos BETWEEN olo AND ohi OR pos BETWEEN llo AND lhi THEN 0 ELSE 1 END FROM wide
  UNION ALL SELECT 'ship_price', pos, p,
         CASE WHEN pos BETWEEN olo AND ohi OR pos BETWEEN llo AND lhi THEN 0 ELSE 1 END FROM wide)
""")
def align_tables(spark, sf):
    def daily(source, spec, methods):
        rows = source.select(F.lit("plant").alias("series_id"), F.col(spec.time_column).alias("ts"),
                             *[F.col(f.sources[0]).alias(f.name) for f in spec.fields])
        return lengthen(resample(rows, ["series_id"], "ts", methods, DAY), list(methods))

    orders = daily(table(spark, sf, "orders"), ORDERS_SPEC, {"order_value": "sum", "order_mean": "mean"})
    lines = daily(table(spark, sf, "lineitem"), LINES_SPEC, {"ship_qty": "sum", "ship_price": "max"})
    out = align({"orders": orders, "lineitem": lines}, ["order_value", "ship_qty"])
    return out.select("field", "pos", F.round("value", 6).alias("value"), "gap_inserted")


@query("load_tables", """
WITH o AS (SELECT CAST(ceil(epoch_us(o_orderdate) / 604800000000.0) AS BIGINT) AS pos, avg(v) AS order_mean
           FROM (SELECT o_orderdate, avg(o_totalprice) AS v FROM orders GROUP BY 1) GROUP BY 1),
l AS (SELECT CAST(ceil(epoch_us(l_shipdate) / 604800000000.0) AS BIGINT) AS pos, min(l_extendedprice) AS late_price
      FROM lineitem GROUP BY 1),
g AS (SELECT unnest(generate_series(least((SELECT min(pos) FROM o), (SELECT min(pos) FROM l)),
                                    greatest((SELECT max(pos) FROM o), (SELECT max(pos) FROM l)))) AS pos)
SELECT 'order_mean' AS field, pos, round(order_mean, 5) AS value FROM g LEFT JOIN o USING (pos)
UNION ALL SELECT 'late_price', pos, round(late_price, 5) FROM g LEFT JOIN l USING (pos)
""")
def load_tables(spark, sf):
    mean_only = TableSpec("orders", "o_orderdate", (FieldSpec("order_mean", patterns=(r"o_total.*",)),))
    out = load_aligned(
        spark, [(mean_only, f"{sf}/orders.parquet"), (LATE_LINES_SPEC, f"{sf}/lineitem.parquet"),
                (TableSpec("absent", "ts", required=False), f"{sf}/absent.parquet")], 7 * DAY)
    return out.select("field", "pos", F.round("value", 5).alias("value"))


@query("align_outer", """
WITH o AS (SELECT o_orderdate AS ts, round(sum(o_totalprice), 2) AS order_value FROM orders GROUP BY 1),
l AS (SELECT l_shipdate AS ts, sum(l_quantity) AS ship_qty FROM lineitem GROUP BY 1)
SELECT ts, order_value, ship_qty FROM o FULL OUTER JOIN l USING (ts)
""")
def align_outer(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("ts")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("order_value"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("ts")).agg(
        F.sum("l_quantity").alias("ship_qty"))
    return outer_align([orders, lines], ["ts"])


@query("combine_sources", "WITH " + GRID_SQL + """,
wide AS (SELECT series_id, pos, max(value) FILTER (field = 'click') AS a, max(value) FILTER (field = 'error') AS b,
                max(value) FILTER (field = 'view') AS c FROM grid GROUP BY 1, 2)
SELECT series_id, pos,
  CASE WHEN coalesce(a, b, c) IS NOT NULL THEN round(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0), 6) END AS total,
  round((coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 6) AS mean_ab,
  round(coalesce(c, a), 6) AS first_ca
FROM wide
""")
def combine_sources(spark, sf):
    from slotwise.operators.grid import widen

    wide = widen(hourly_grid(spark, sf), ["click", "error", "view"])
    bound = bind_fields(wide, [
        FieldSpec("total", ("click",), ("error", "v.*"), "sum"),
        FieldSpec("mean_ab", ("click", "error"), combine="mean"),
        FieldSpec("first_ca", ("view", "click", "absent"), combine="first")])
    return wide.select("series_id", "pos", *[F.round(c, 6).alias(n) for n, c in bound.items()])


@query("load_quality", """
WITH m AS (SELECT l_returnflag AS series_id, l_shipdate AS ts, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT 'lineitem' AS "table", series_id, CAST(sum(n) AS BIGINT) AS input_rows, CAST(0 AS BIGINT) AS invalid_rows,
       CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows, count(DISTINCT epoch_us(ts)) AS filled_slots,
       CAST((max(epoch_us(ts)) - min(epoch_us(ts))) / 86400000000 + 1 AS BIGINT) AS output_rows
FROM m GROUP BY 2
""")
def load_quality(spark, sf):
    return table_quality(table(spark, sf, "lineitem"), TableSpec("lineitem", "l_shipdate", series="l_returnflag"), DAY)


@query("target_presence", "WITH " + GRID_SQL + """
SELECT series_id, field, count(value) AS present, CASE WHEN count(value) > 0 THEN 'passed' ELSE 'failed' END AS status
FROM grid WHERE field IN ('click', 'view') GROUP BY 1, 2
""")
def target_presence(spark, sf):
    return validate_targets(hourly_grid(spark, sf), TARGETS)


@query("origins_tail", "WITH " + GRID_SQL + """
SELECT series_id, pos FROM (SELECT DISTINCT series_id, pos FROM grid) JOIN span USING (series_id) WHERE pos > hi - 96
""")
def origins_tail(spark, sf):
    return forecast_origins(hourly_grid(spark, sf), last=96)


@query("numeric_text", """
SELECT event_id, TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS number,
       TRY_CAST(event_type AS DOUBLE) AS unreadable, TRY_STRPTIME(CAST(ts AS VARCHAR)[1:19], '%Y-%m-%d %H:%M:%S') AS moment
FROM events
""")
def numeric_text(spark, sf):
    from slotwise.functions.numbers import to_number
    from slotwise.sources.tables import parse_time

    rows = table(spark, sf, "events").select(
        "event_id", F.regexp_extract("props", r"(\d+)", 1).alias("text"), "event_type",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"))
    return rows.select("event_id", to_number("text").alias("number"), to_number("event_type").alias("unreadable"),
                       parse_time(rows, "stamp").alias("moment"))

