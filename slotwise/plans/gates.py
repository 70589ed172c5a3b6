"""Gates: does a candidate beat the incumbent on enough folds, for every column at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.numbers import ape_floor, finite
from slotwise.operators.blocks import beside

CELL = ("field", "horizon")


def reasons(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that are broken, in order."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def fold_gains(
    wide: DataFrame, candidates: Sequence[str], baseline: str, cell: Sequence[str] = CELL, fold: str = "fold",
) -> DataFrame:
    """(cell, candidate, fold, gain): mean floored error of the baseline minus that of the candidate.

    A (cell, candidate, fold) without a usable row is left out.
    """
    return all_fold_gains(wide, candidates, baseline, cell, fold).where("gain IS NOT NULL")


def all_fold_gains(
    wide: DataFrame, candidates: Sequence[str], baseline: str, cell: Sequence[str] = CELL, fold: str = "fold",
) -> DataFrame:
    """The same with a null gain where nothing can be compared."""
    usable = lambda c: finite("y_true").isNotNull() & finite(baseline).isNotNull() & finite(c).isNotNull()
    arms = F.array(*[
        F.struct(F.lit(c).alias("candidate"), F.when(usable(c), ape_floor("y_true", baseline)).alias("b"),
                 F.when(usable(c), ape_floor("y_true", c)).alias("c")) for c in candidates])
    long = wide.select(*cell, fold, F.explode(arms).alias("_a"))
    return long.groupBy(*cell, F.col("_a.candidate").alias("candidate"), fold).agg(
        F.avg("_a.b").alias("baseline_mape"), F.avg("_a.c").alias("candidate_mape")).withColumn(
            "gain", F.col("baseline_mape") - F.col("candidate_mape"))


def column_gate(
    wide: DataFrame, candidates: Sequence[str], baseline: str = "last_value", cell: Sequence[str] = CELL,
    fold: str = "fold", minimum_mean_gain: float = 0.0, maximum_worst_degradation: float = 0.01,
    minimum_non_degraded_folds: int = 5,
) -> DataFrame:
    """Per cell and candidate; the mean gain must exceed (not just reach) its minimum.

    A cell without a usable pair fails.
    """
    gains = all_fold_gains(wide, candidates, baseline, cell, fold)
    out = gains.groupBy(*cell, "candidate").agg(
        F.avg("gain").alias("mean_gain"), F.min("gain").alias("worst_gain"),
        F.count_if(F.col("gain") >= 0).alias("non_degraded_folds"), F.count("gain").alias("total_folds"))
    needed = F.least(F.lit(minimum_non_degraded_folds), F.col("total_folds"))
    listed = reasons(
        ("nothing comparable", F.col("total_folds") == 0),
        ("mean not improved", F.col("mean_gain") <= minimum_mean_gain),
        ("too few folds held", F.col("non_degraded_folds") < needed),
        ("worst fold degraded", F.col("worst_gain") < -maximum_worst_degradation))
    return out.withColumn("reasons", listed).withColumn("passed", F.size("reasons") == 0)


def candidate_gate(
    baseline: DataFrame, candidate: DataFrame, by: Sequence[str] = (), target: str = "field", fold: str = "fold",
    horizon: str = "horizon", minimum_mean_gain: float = 0.001, maximum_worst_degradation: float = 0.015,
    minimum_improved_folds: int = 3,
) -> DataFrame:
    """Whole-candidate gate over folds and targets; here the mean gain may equal its minimum.

    Both inputs are tidy (fold, target, horizon [, series_id, pos, target_pos], y_true, y_pred). Fails if
    nothing can be compared; groups of ``by`` without a common row fail as well.
    """
    keys = [fold, target, horizon] + [
        c for c in ("series_id", "pos", "target_pos", *by) if c in baseline.columns and c in candidate.columns]
    left = baseline.select(*keys, ape_floor("y_true", "y_pred").alias("_b"))
    right = candidate.select(*keys, ape_floor("y_true", "y_pred").alias("_c"))
    joined = left.join(right, keys)
    gain = F.avg("_b") - F.avg("_c")
    folds = joined.groupBy(*by, fold).agg(gain.alias("gain")).groupBy(*by).agg(
        F.avg("gain").alias("mean_gain"), F.min("gain").alias("worst_gain"),
        F.count_if(F.col("gain") > 0).alias("improved_folds"), F.count("gain").alias("total_folds"))
    targets = joined.groupBy(*by, target).agg(gain.alias("gain")).groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(target, "gain")))).alias("target_gains"),
        F.min("gain").alias("worst_target_gain"))
    if by:
        seen = baseline.select(*by).unionByName(candidate.select(*by)).distinct()
        out = seen.join(folds, list(by), "left").join(targets, list(by), "left")
        out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("improved_folds", "total_folds")})
    else:
        out = beside(folds, targets)
    needed = F.least(F.lit(minimum_improved_folds), F.col("total_folds"))
    listed = reasons(
        ("nothing comparable", (F.col("total_folds") == 0) | F.col("mean_gain").isNull()),
        ("mean gain too small", F.col("mean_gain") < minimum_mean_gain),
        ("a target degraded", F.col("worst_target_gain") < 0),
        ("too few folds improved", F.col("improved_folds") < needed),
        ("worst fold degraded", F.col("worst_gain") < -maximum_worst_degradation))
    return out.withColumn("reasons", listed).withColumn("passed", F.size("reasons") == 0)


def two_window_gate(gates: DataFrame, window: str = "validation_type", by: Sequence[str] = ()) -> DataFrame:
    """One verdict out of the gate rows of both windows: all must pass, the worst fold of either counts."""
    said = F.transform("reasons", lambda r: F.concat(F.col(window), F.lit(": "), r))
    return gates.withColumn("_said", said).groupBy(*by).agg(
        F.bool_and("passed").alias("passed"), F.avg("mean_gain").alias("mean_gain"),
        F.min("worst_gain").alias("worst_gain"), F.sum("improved_folds").alias("improved_folds"),
        F.array_sort(F.flatten(F.collect_list("_said"))).alias("reasons"))


def residual_gate(gains: DataFrame, by: Sequence[str] = (), threshold: float = 0.0001, require_all: bool = True) -> DataFrame:
    """All folds, or more than half of them, must gain at least ``threshold``."""
    out = gains.groupBy(*by).agg(
        F.min("gain").alias("minimum_fold_gain"), F.count_if(F.col("gain") >= threshold).alias("folds_held"),
        F.count(F.lit(1)).alias("folds"))
    allowed = F.col("minimum_fold_gain") >= threshold if require_all else F.col("folds_held") > F.col("folds") / 2
    return out.withColumn("allowed", F.coalesce(allowed, F.lit(False)))
