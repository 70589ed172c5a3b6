"""Causal cleaning on the long grid: every rule looks at the current slot and the past only.

Cleaning adds columns. The raw ``value`` (and so every label) is never overwritten.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.operators.blocks import carry_last, with_halo
from slotwise.operators.order_windows import RankIndex, by_block, frame

KEYS = ("series_id", "field")
MAD_SCALE = 1.4826  # fixed value: MAD of a normal variable to its standard deviation


@dataclass(frozen=True)
class OutlierRule:
    method: str = "iqr"
    window: int = 96
    min_periods: int | None = None
    multiplier: float = 4.0
    enabled: bool = True

    @property
    def needed(self) -> int:
        return self.min_periods if self.min_periods is not None else max(4, self.window // 4)


@dataclass(frozen=True)
class CleanRule:
    outliers: OutlierRule = OutlierRule()
    fill: str = "ffill"
    limit: int | None = None


def missing_and_fill(
    grid: DataFrame, method: str = "ffill", limit: int | None = None, keys: Sequence[str] = KEYS,
    block: int | None = None,
) -> DataFrame:
    """Adds ``missing``, ``missing_run`` and ``filled``; one carried (value, slot) pair serves all three."""
    if method not in ("ffill", "none"):
        raise ValueError(f"only causal fills are allowed, not {method!r}")
    seen = F.when(F.col("value").isNotNull(), F.struct(F.col("value").alias("v"), F.col("pos").alias("p")))
    # before the first reading the run counts from the first slot of the series
    rows = carry_last(grid, keys, seen, "_last", block=block, first="_start")
    age = F.col("pos") - F.coalesce(F.col("_last.p"), F.col("_start") - 1)
    near = F.lit(True) if limit is None else age <= limit
    filled = F.col("value") if method == "none" else F.when(near, F.col("_last.v"))
    return rows.select(
        *grid.columns,
        F.col("value").isNull().cast("int").alias("missing"),
        age.cast("int").alias("missing_run"),
        filled.alias("filled"),
    )


def flag_outliers(
    grid: DataFrame, rule: OutlierRule = OutlierRule(), keys: Sequence[str] = KEYS, block: int | None = None,
) -> DataFrame:
    """Adds ``outlier`` and ``robust`` (past median where flagged, else the raw value).

    The order statistics of every frame come from a rank index per block, so a slot's cost hardly depends on the window.
    """
    if rule.method not in ("iqr", "hampel"):
        raise ValueError(f"unknown outlier method {rule.method!r}")
    if not rule.enabled:
        return grid.withColumn("outlier", F.lit(0)).withColumn("robust", F.col("value"))
    bounds, back = (_iqr, rule.window) if rule.method == "iqr" else (_hampel, 2 * rule.window + 1)

    def work(columns, n):
        value = columns["value"]
        median, low, high, valid = bounds(value, n, rule)
        with np.errstate(invalid="ignore"):
            flag = valid & ((value < low) | (value > high))
        return {"outlier": flag.astype(np.int32), "robust": np.where(flag, median, value)}

    return by_block(grid, keys, work, ["value"], [("outlier", T.IntegerType()), ("robust", T.DoubleType())], back, block=block)


def _iqr(value: np.ndarray, n: int, rule: OutlierRule):
    index, past = RankIndex(value), frame(n, rule.window)
    enough = index.count(*past) >= rule.needed
    q1, median, q3 = (np.where(enough, index.percentile(*past, p), np.nan) for p in (0.25, 0.5, 0.75))
    spread = q3 - q1
    return median, q1 - rule.multiplier * spread, q3 + rule.multiplier * spread, spread > 0


def _hampel(value: np.ndarray, n: int, rule: OutlierRule):
    # the row at slot i carries history_i = value(i-1) and its own rolling median; the MAD is the
    # median of |history_j - median_j| over the last ``window`` rows j, the current one included
    index, past = RankIndex(value), frame(n, rule.window)
    median = np.where(index.count(*past) >= rule.needed, index.percentile(*past, 0.5), np.nan)
    away = RankIndex(np.abs(np.concatenate([[np.nan], value[:-1]]) - median))
    here = frame(n, rule.window - 1, 0)
    scale = MAD_SCALE * np.where(away.count(*here) >= rule.needed, away.percentile(*here, 0.5), np.nan)
    return median, median - rule.multiplier * scale, median + rule.multiplier * scale, scale > 0


def clean(
    grid: DataFrame, rule: CleanRule = CleanRule(), keys: Sequence[str] = KEYS, block: int | None = None,
) -> DataFrame:
    """Flags first (on the raw column), then the fill, then the robust copy's own holes."""
    flagged = flag_outliers(grid, rule.outliers, keys, block)
    filled = missing_and_fill(flagged, rule.fill, rule.limit, keys, block)
    return filled.withColumn("robust", F.coalesce("robust", "filled"))


def drop_empty_fields(cleaned: DataFrame, column: str = "filled") -> DataFrame:
    """Fields of a series that hold nothing even after filling leave together with their flags."""
    usable = cleaned.groupBy(*KEYS).agg(F.count(column).alias("_n")).where("_n > 0").select(*KEYS)
    return cleaned.join(usable, list(KEYS), "left_semi")


def cleaning_report(cleaned: DataFrame) -> DataFrame:
    """Outliers and missing cells before and after, one row per series and field."""
    return cleaned.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("slots"),
        F.sum("outlier").alias("outliers"),
        F.sum("missing").alias("missing_before"),
        F.count_if(F.col("filled").isNull()).alias("missing_after"),
        F.max("missing_run").alias("longest_gap"),
        (F.count("filled") == 0).alias("dropped"),
    )


def constant_runs(grid: DataFrame, tolerance: float, keys: Sequence[str] = KEYS, block: int | None = None) -> DataFrame:
    """Run number per slot: a run ends where the value moves by more than ``tolerance``."""
    from slotwise.operators.blocks import running_total

    moved = with_halo(
        grid, keys,
        lambda rows, w: rows.withColumn(
            "changed",
            F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)) > tolerance, F.lit(False)).cast("int")),
        back=1, block=block)
    return running_total(moved, keys, F.col("changed"), "run", block=block)

