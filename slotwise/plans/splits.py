"""Time folds as columns: every grid row is told in which folds it is a validation origin.

Positions inside a series are plain arithmetic (slot minus first slot), and the folds that
hold a slot follow from its position, so no join against a fold table is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.functions.slots import slot_ceil


@dataclass(frozen=True)
class Rolling:
    """Folds walking forward from the start; ``mode`` expanding or rolling."""

    folds: int
    initial: int
    validation: int
    step: int
    mode: str = "expanding"
    train: int | None = None


@dataclass(frozen=True)
class Recent:
    """Complete folds counted back from the end."""

    folds: int = 10
    validation: int = 192
    step: int = 192
    train: int | None = None


@dataclass(frozen=True)
class MonthStart:
    """Train up to a month's end, validate the slots right after it."""

    months: Sequence[str]
    validation: int = 192


def splitter(settings: dict) -> Rolling | Recent | MonthStart:
    """Fold rule out of plain settings (``kind`` chooses the rule)."""
    options = dict(settings)
    kind = options.pop("kind", options.get("mode", "expanding"))
    if kind in ("expanding", "rolling"):
        return Rolling(**{**options, "mode": kind})
    if kind == "recent":
        return Recent(**options)
    if kind == "month_start":
        return MonthStart(**options)
    raise ValueError(f"unknown split kind {kind!r}")


def _check(rule) -> None:
    sizes = [v for k, v in vars(rule).items() if k in ("folds", "initial", "validation", "step")]
    if min(sizes) <= 0 or (isinstance(rule, Rolling) and rule.mode not in ("expanding", "rolling")):
        raise ValueError("fold sizes must be positive and the mode expanding or rolling")


def spans(grid: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    return grid.groupBy(*keys).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def fold_table(
    grid: DataFrame, rule: Rolling | Recent | MonthStart, max_horizon: int,
    keys: Sequence[str] = ("series_id",), step_seconds: int = 900,
) -> DataFrame:
    """(keys, fold, train_start, train_end, valid_start, valid_end) in slots; too short a series fails."""
    _check(rule)
    ends = spans(grid, keys)
    first, last = F.col("first_pos"), F.col("last_pos")
    if isinstance(rule, MonthStart):
        starts = F.array(*[
            F.struct(F.lit(i).alias("fold"),
                     slot_ceil(F.to_timestamp_ntz(F.lit(f"{m}-01 00:00:00")), step_seconds).alias("valid_start"))
            for i, m in enumerate(rule.months)])
        rows = ends.withColumn("_s", F.explode(starts)).select(*ends.columns, "_s.fold", "_s.valid_start")
        rows = rows.withColumn("train_start", first)
    else:
        rows = ends.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(rule.folds - 1))))
        if isinstance(rule, Rolling):
            valid_start = first + rule.initial + F.col("fold") * rule.step
        else:
            back = (rule.folds - 1 - F.col("fold")) * rule.step
            valid_start = last - max_horizon - rule.validation + 1 - back
        rows = rows.withColumn("valid_start", valid_start)
        width = rule.train or (rule.initial if isinstance(rule, Rolling) else None)
        limited = (isinstance(rule, Rolling) and rule.mode == "rolling") or (isinstance(rule, Recent) and rule.train)
        start = F.greatest(first, F.col("valid_start") - width) if limited else first
        rows = rows.withColumn("train_start", start)
    rows = rows.withColumn("train_end", F.col("valid_start") - 1).withColumn(
        "valid_end", F.col("valid_start") + rule.validation - 1)
    fits = (F.col("valid_end") + max_horizon <= last) & (F.col("train_end") >= first)
    refuse = F.raise_error(F.lit("series too short for the folds asked for")).cast("boolean")
    return rows.where(F.when(fits, F.lit(True)).otherwise(refuse)).select(
        *keys, "fold", "train_start", "train_end", "valid_start", "valid_end")


def add_folds(
    rows: DataFrame, rule: Rolling | Recent | MonthStart, folds: DataFrame, keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """One copy of every validation-origin row per fold that holds it.

    The fold list of a series is short and travels as one array, so the join key is the series
    alone and each row meets exactly one fold-list row.
    """
    listed = folds.groupBy(*keys).agg(F.collect_list(
        F.struct("fold", "train_start", "train_end", "valid_start", "valid_end")).alias("_folds"))
    holding = F.filter("_folds", lambda f: F.col("pos").between(f["valid_start"], f["valid_end"]))
    out = rows.join(listed, list(keys)).withColumn("_fold", F.explode(holding))
    return out.select(*rows.columns, "_fold.fold", "_fold.train_start", "_fold.train_end")


def split_integrity(folds: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Overlapping validation origins between folds and folds whose training reaches into validation.

    Ranges are compared by their ends: a fold adds the slots past the furthest end of the folds that start before it, and
    all its other slots were held already.
    """
    before = Window.partitionBy(*keys).orderBy("valid_start", "valid_end", "fold").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("valid_end").over(before), F.col("valid_start") - 1)
    fresh = F.greatest(F.lit(0), F.col("valid_end") - F.greatest("_reached", F.col("valid_start") - 1))
    return folds.withColumn("_reached", reached).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"),
        F.count_if(F.col("train_end") >= F.col("valid_start")).alias("training_overlaps"),
        F.sum(F.col("valid_end") - F.col("valid_start") + 1 - fresh).alias("overlapping_origins")).withColumn(
        "status", F.when(F.expr("overlapping_origins = 0 AND training_overlaps = 0"), "passed").otherwise("failed"))
