"""Registry of the queries and the shared views they start from.

The driver's tables are read as an industrial feed: ``events`` are raw readings of five
fields (event types) on four sites (a user's number modulo four names the site; every
row belongs to one of them). ``orders`` and ``lineitem`` are daily sources.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators.grid import densify, resample, widen

HOUR = 3600
DAY = 86400
FIELDS = ("click", "error", "purchase", "signup", "view")
TARGETS = ("click", "view")


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(name, run, sql)
        return run

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """(series_id, field, ts, value, event_id): the raw feed."""
    site = F.concat(F.lit("site_"), (F.col("user_id") % 4).cast("string"))
    return table(spark, sf, "events").select(
        site.alias("series_id"), F.col("event_type").alias("field"), "ts", "value", "event_id")


def hourly_bins(spark: SparkSession, sf: str) -> DataFrame:
    return resample(readings(spark, sf), ["series_id", "field"], "ts", {"value": "mean"}, HOUR)


def hourly_grid(spark: SparkSession, sf: str) -> DataFrame:
    """(series_id, field, pos, value) on every hour; empty hours are null."""
    return densify(hourly_bins(spark, sf))


def hourly_wide(spark: SparkSession, sf: str) -> DataFrame:
    return widen(hourly_grid(spark, sf), FIELDS)


GRID_SQL = """
raw AS (
  SELECT 'site_' || CAST(user_id % 4 AS VARCHAR) AS series_id, event_type AS field, ts, value, event_id
  FROM events),
bins AS (
  SELECT series_id, field, CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) AS pos, avg(value) AS value
  FROM raw GROUP BY 1, 2, 3),
span AS (SELECT series_id, min(pos) AS lo, max(pos) AS hi FROM bins GROUP BY 1),
slots AS (
  SELECT f.series_id, f.field, unnest(generate_series(lo, hi)) AS pos
  FROM (SELECT DISTINCT series_id, field FROM bins) f JOIN span USING (series_id)),
grid AS (
  SELECT s.series_id, s.field, s.pos, b.value
  FROM slots s LEFT JOIN bins b USING (series_id, field, pos))
"""

WIDE_SQL = GRID_SQL + """,
wide AS (
  SELECT series_id, pos,
""" + ",\n".join(f"    max(value) FILTER (field = '{f}') AS {f}" for f in FIELDS) + """
  FROM grid GROUP BY 1, 2)
"""

BY_FIELD = "PARTITION BY series_id, field ORDER BY pos"
BY_SITE = "PARTITION BY series_id ORDER BY pos"


def rounded(columns, digits: int = 6) -> list:
    return [F.round(c, digits).alias(c) for c in columns]


def sig(c, name: str | None = None):
    """Single-precision view of a computed double.

    Aggregates differ in the last bits between engines; decimal rounding would split exact ties
    such as 0.xxxx5, so values are compared to 24 bits (noise around zero removed first).
    """
    column = F.col(c) if isinstance(c, str) else c
    out = F.round(column, 9).cast("float").cast("double")
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def sigs(columns) -> list:
    return [sig(c) for c in columns]


def sig_sql(expression: str) -> str:
    return f"round({expression}, 9)::FLOAT::DOUBLE"
