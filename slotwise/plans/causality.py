"""Checks that no plan looks ahead: change the future, nothing up to the cut may move."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.operators.features import least_count
from slotwise.plans.contracts import require_zero, same_rows

# fixed values: affine changes applied to the future of features and of forecasts
FEATURE_CHANGE = (-7.0, 1_000_003.0)
FORECAST_CHANGE = (-11.0, 9_999_991.0)


def change_future(grid: DataFrame, cut: DataFrame, change: tuple[float, float], columns: Sequence[str] = ("value",),
                  key: str = "series_id") -> DataFrame:
    """Readings after a series' cut slot (key, cut) replaced by factor * x + offset."""
    factor, offset = change
    later = F.col("pos") > F.col("cut")
    return grid.join(cut, key).withColumns({
        c: F.when(later, F.col(c) * factor + offset).otherwise(F.col(c)) for c in columns}).drop("cut")


def moved_rows(build: Callable[[DataFrame], DataFrame], grid: DataFrame, cut: DataFrame, change=FEATURE_CHANGE,
               columns: Sequence[str] = ("value",), key: str = "series_id", through: str = "pos") -> DataFrame:
    """Result rows up to the cut that differ between the true and the changed future."""
    upto = lambda df: df.join(cut, key).where(F.col(through) <= F.col("cut")).drop("cut")
    return same_rows(upto(build(grid)), upto(build(change_future(grid, cut, change, columns, key))))


def require_causal(build, grid: DataFrame, cut: DataFrame, change=FEATURE_CHANGE, **options) -> None:
    require_zero(moved_rows(build, grid, cut, change, **options), "a later reading changes an earlier result")


def require_causal_forecast(build, grid: DataFrame, cut: DataFrame, **options) -> None:
    """As ``require_causal`` with the stronger change used on forecasts."""
    require_zero(moved_rows(build, grid, cut, FORECAST_CHANGE, **options), "a later reading changes a forecast")


def shifted_mean_gap(features: DataFrame, grid: DataFrame, window: int, column: str, tolerance: float = 1e-9,
                     keys: Sequence[str] = ("series_id", "field")) -> DataFrame:
    """Rows whose rolling mean differs from one recomputed out of the slots strictly before.

    The recomputation sends every reading to the ``window`` slots after it and sums there, a route
    that shares nothing with the row frames under test.
    """
    sent = grid.where(F.col("value").isNotNull()).select(
        *keys, "value", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + window)).alias("pos"))
    again = sent.groupBy(*keys, "pos").agg(F.avg("value").alias("_again"), F.count("value").alias("_n"))
    joined = features.select(*keys, "pos", column).join(again, [*keys, "pos"], "left")
    expected = F.when(F.col("_n") >= least_count(window), F.col("_again"))
    near = F.abs(F.col(column) - expected) <= tolerance * (1 + F.abs(expected))
    equal = (F.col(column).isNull() & expected.isNull()) | F.coalesce(near, F.lit(False))
    return joined.where(~equal)
