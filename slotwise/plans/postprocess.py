"""Physical limits of forecasts: floor, capacity, ramp along the horizon, part below total."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.functions.numbers import at_least
from slotwise.plans.metrics import summarize


def _near(a, b):
    return F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)


def apply_limits(
    tidy: DataFrame, capacities: Mapping[str, float] | None = None, ramp: float | None = None,
    part: str | None = None, total: str | None = None, non_negative: bool = True, current: str = "current",
    origin: Sequence[str] = ("series_id", "pos"), target: str = "field", horizon: str = "horizon",
) -> DataFrame:
    """Adds ``y_limited`` and one 0/1 column per rule that moved the row.

    One group of an (origin, target) is its horizons: a handful of rows. The ramp rule clamps each
    step to the previous *clamped* step, so it folds along the sorted horizons of that group.
    """
    floored = at_least("y_pred", 0.0) if non_negative else F.col("y_pred")
    rows = tidy.withColumn("_p", floored).withColumn(
        "hit_non_negative", F.coalesce((F.col("y_pred") < 0) & F.lit(non_negative), F.lit(False)).cast("int"))
    cap = F.lit(None).cast("double")
    for name, limit in (capacities or {}).items():
        cap = F.when(F.col(target) == name, F.lit(float(limit))).otherwise(cap)
    rows = rows.withColumn("_cap", cap)
    rows = rows.withColumn("hit_capacity", F.coalesce(F.col("_p") > F.col("_cap"), F.lit(False)).cast("int"))
    rows = rows.withColumn("_p", F.when(F.col("_p").isNotNull(), F.least("_p", "_cap"))).drop("_cap")
    if ramp is not None:
        rows = _ramp(rows, float(ramp), current, [*origin, target], horizon)
    else:
        rows = rows.withColumn("hit_ramp", F.lit(0))
    if part and total:
        per = Window.partitionBy(*origin, horizon)
        ceiling = F.max(F.when(F.col(target) == total, F.col("_p"))).over(per)
        rows = rows.withColumn("_total", ceiling)
        over = F.coalesce((F.col(target) == part) & (F.col("_p") > F.col("_total")), F.lit(False))
        rows = rows.withColumn("hit_consistency", over.cast("int")).withColumn(
            "_p", F.when(over, F.col("_total")).otherwise(F.col("_p"))).drop("_total")
    else:
        rows = rows.withColumn("hit_consistency", F.lit(0))
    return rows.withColumnRenamed("_p", "y_limited").withColumn(
        "changed", (~F.coalesce(_near(F.col("y_pred"), F.col("y_limited")), F.col("y_pred").isNull())).cast("int"))


def _ramp(rows: DataFrame, limit: float, current: str, keys: Sequence[str], horizon: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(horizon).alias("_h"), F.struct(*rest).alias("row")))).alias("_steps"))
    start = F.struct(F.get("_steps", F.lit(0))["row"][current].alias("prev"), F.array().cast("array<double>").alias("out"))

    def clamp(acc, s):
        p = s["row"]["_p"]
        low, high = acc["prev"] - limit, acc["prev"] + limit
        moved = F.when(p.isNull() | acc["prev"].isNull(), p).otherwise(F.least(F.greatest(p, low), high))
        return F.struct(F.coalesce(moved, acc["prev"]).alias("prev"), F.concat(acc["out"], F.array(moved)).alias("out"))

    folded = grouped.withColumn("_out", F.aggregate("_steps", start, clamp)["out"])
    spread = folded.select(*keys, F.posexplode("_steps").alias("_i", "_s"), "_out")
    out = spread.select(*keys, "_s.row.*", F.get("_out", F.col("_i")).alias("_clamped"))
    return out.withColumn("hit_ramp", (~F.coalesce(_near(F.col("_p"), F.col("_clamped")), F.lit(True))).cast("int")).drop(
        "_p").withColumnRenamed("_clamped", "_p")


def adjustment_counts(limited: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    names = ("non_negative", "capacity", "ramp", "consistency")
    return limited.groupBy(*by).agg(
        *[F.sum(f"hit_{n}").alias(n) for n in names], F.sum("changed").alias("adjusted_cells"))


def first_fold_limits(tidy: DataFrame, fold: str = "fold", keys: Sequence[str] = ("series_id", "field", "pos", "horizon"), **limits) -> DataFrame:
    """Limits on overlapping folds: the first fold's forecast of an origin stands for all its folds."""
    order = Window.partitionBy(*keys).orderBy(fold)
    first = tidy.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
    limited = apply_limits(first, **limits).select(*keys, "y_limited")
    return tidy.join(limited, list(keys))


def before_after(tidy: DataFrame, limited: str = "y_limited", **options) -> DataFrame:
    """Metrics of the raw and of the limited forecast, told apart by ``stage``."""
    arms = F.explode(F.array(
        F.struct(F.lit("before").alias("stage"), F.col("y_pred").alias("p")),
        F.struct(F.lit("after").alias("stage"), F.col(limited).alias("p"))))
    long = tidy.withColumn("_a", arms).select("field", "horizon", "y_true", "_a.stage", F.col("_a.p").alias("y_pred"))
    return summarize(long, ["stage"], **options)
