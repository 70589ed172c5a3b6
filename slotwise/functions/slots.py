"""Slot arithmetic: a slot number is whole steps since 1970-01-01, no window needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
VARIANTS = [(label, closed) for label in ("left", "right") for closed in ("left", "right")]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a zone-free timestamp (independent of the session zone)."""
    seconds = (_col(ts).cast("timestamp_ntz") - F.expr(EPOCH)).cast("interval second")
    return (seconds.cast("decimal(18,6)") * 1_000_000).cast("bigint")


def slot_floor(ts: Column | str, step_seconds: int) -> Column:
    """Number of the left-closed slot [k*step, (k+1)*step) that holds ``ts``."""
    us, step = micros(ts), F.lit(step_seconds * 1_000_000).cast("bigint")
    return ((us - F.pmod(us, step)) / step).cast("bigint")


def slot_ceil(ts: Column | str, step_seconds: int) -> Column:
    """Right edge number of the right-closed slot ((k-1)*step, k*step] that holds ``ts``."""
    us, step = micros(ts), F.lit(step_seconds * 1_000_000).cast("bigint")
    return ((us + F.pmod(-us, step)) / step).cast("bigint")


def slot_of(ts: Column | str, step_seconds: int, label: str = "right", closed: str = "right") -> Column:
    """Slot number under one of the four boundary variants.

    ``closed`` chooses which edge belongs to the bin, ``label`` which edge names it.
    """
    if label not in ("left", "right") or closed not in ("left", "right"):
        raise ValueError("label and closed must be left or right")
    if closed == "right":
        right_edge = slot_ceil(ts, step_seconds)
        return right_edge if label == "right" else right_edge - 1
    left_edge = slot_floor(ts, step_seconds)
    return left_edge if label == "left" else left_edge + 1


def slot_start(pos: Column | str, step_seconds: int) -> Column:
    """Zone-free timestamp of a slot number."""
    seconds = (_col(pos) * step_seconds).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.expr(EPOCH) + F.make_dt_interval(zero, zero, zero, seconds)
