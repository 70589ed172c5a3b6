"""Calendar encodings, tariff and hour bins of a timestamp column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def minute_of_day(ts: Column | str) -> Column:
    return F.hour(_col(ts)) * 60 + F.minute(_col(ts))


def calendar(ts: Column | str, step_minutes: int = 15, prefix: str = "feat_time_") -> dict[str, Column]:
    """Cyclic and plain encodings; Monday is 0 and the weekend starts at 5."""
    ts = _col(ts)
    minute = minute_of_day(ts)
    weekday = F.weekday(ts)
    day = minute * F.lit(2 * math.pi / 1440)
    week = (weekday * 1440 + minute) * F.lit(2 * math.pi / 10080)
    parts = {
        "day_sin": F.sin(day), "day_cos": F.cos(day),
        "week_sin": F.sin(week), "week_cos": F.cos(week),
        "hour": F.hour(ts), "minute": F.minute(ts),
        "slot": F.floor(minute / step_minutes).cast("int"),
        "month": F.month(ts), "dayofweek": weekday,
        "is_weekend": (weekday >= 5).cast("int"),
    }
    return {prefix + name: column for name, column in parts.items()}


# fixed values: tariff hours (peak 8-11 and 17-22, valley before 7 and from 23)
PEAK_HOURS = [(8, 11), (17, 22)]
VALLEY_BEFORE = 7
VALLEY_FROM = 23


def tariff(ts: Column | str, peak: float = 1.0, flat: float = 0.65, valley: float = 0.35) -> Column:
    hour = F.hour(_col(ts))
    is_peak = F.lit(False)
    for start, stop in PEAK_HOURS:
        is_peak = is_peak | ((hour >= start) & (hour < stop))
    is_valley = (hour < VALLEY_BEFORE) | (hour >= VALLEY_FROM)
    return F.when(is_peak, F.lit(peak)).when(is_valley, F.lit(valley)).otherwise(F.lit(flat))


def hour_bin(ts: Column | str, size: int) -> Column:
    if size <= 0 or 24 % size:
        raise ValueError("hour bin size must divide 24")
    return F.floor(F.hour(_col(ts)) / size).cast("int")
