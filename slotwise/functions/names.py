"""Naming of wide forecast columns: <target>_t+<minutes>_pred."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: pattern of a wide forecast column
FORECAST_COLUMN = r"^(.+)_t\+(\d+)_pred$"


def forecast_column(target: str, horizon: int, step_minutes: int = 15) -> str:
    return f"{target}_t+{horizon * step_minutes}_pred"


def forecast_columns(targets, horizons, step_minutes: int = 15) -> list[str]:
    """Target-major order, horizons ascending as given."""
    return [forecast_column(t, h, step_minutes) for t in targets for h in horizons]


def split_forecast_column(name: str, step_minutes: int = 15) -> tuple[str, int]:
    match = re.fullmatch(FORECAST_COLUMN, name)
    minutes = int(match.group(2)) if match else 0
    if minutes <= 0 or minutes % step_minutes:
        raise ValueError(f"not a forecast column on a {step_minutes} minute grid: {name}")
    return match.group(1), minutes // step_minutes


def forecast_column_expr(target: Column, horizon: Column, step_minutes: int = 15) -> Column:
    return F.concat(target, F.lit("_t+"), (horizon * step_minutes).cast("string"), F.lit("_pred"))


def target_of(name: Column) -> Column:
    return F.regexp_extract(name, FORECAST_COLUMN, 1)


def horizon_of(name: Column, step_minutes: int = 15) -> Column:
    minutes = F.regexp_extract(name, FORECAST_COLUMN, 2).try_cast("int")
    on_grid = (minutes > 0) & (minutes % step_minutes == 0)
    return F.when(on_grid, F.floor(minutes / step_minutes).cast("int"))
