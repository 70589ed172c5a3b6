"""The tumbling resample and label maturation on unbounded input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions.slots import slot_of, slot_start


def stream_bins(
    rows: DataFrame, keys: Sequence[str], step_seconds: int, watermark: str, ts: str = "ts", value: str = "value",
) -> DataFrame:
    """Right-labelled bins (keys, bin_end, mean, total, n), emitted once the watermark has passed the bin.

    A right-closed bin is the left-closed bin of the reading moved by the smallest time unit.
    """
    # event time must keep its time zone type for the watermark
    moved = rows.withColumn("_t", F.col(ts).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND"))
    window = F.window("_t", f"{step_seconds} seconds")
    binned = moved.withWatermark("_t", watermark).groupBy(*keys, window).agg(
        F.avg(value).alias("mean"), F.sum(value).alias("total"), F.count(value).alias("n"))
    return binned.select(*keys, F.col("window.end").cast("timestamp_ntz").alias("bin_end"), "mean", "total", "n")


def mature_labels(
    forecasts: DataFrame, readings: DataFrame, keys: Sequence[str], step_seconds: int, watermark: str,
) -> DataFrame:
    """Stream-stream join of forecasts with the reading of their target slot.

    ``forecasts``: (keys, origin ts, horizon, y_pred); ``readings``: (keys, ts, value) already binned.
    """
    asked = forecasts.withColumn("target_ts", slot_start(
        slot_of("origin", step_seconds, "left", "left") + F.col("horizon"), step_seconds).cast("timestamp")).withWatermark("target_ts", watermark)
    told = readings.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("ts").cast("timestamp").alias("_ts"),
                           F.col("value").alias("y_true")).withWatermark("_ts", watermark)
    same = F.col("target_ts") == F.col("_ts")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return asked.join(told, same).select(*keys, "origin", "horizon", "target_ts", "y_pred", "y_true",
                                         (F.col("y_true") - F.col("y_pred")).alias("error"))
