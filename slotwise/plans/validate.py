"""Validation jobs: rolling validation, several split schemes, review bundles, reachability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions.slots import slot_start
from slotwise.operators.blocks import beside
from slotwise.plans.forecast import Model, forecast
from slotwise.plans.metrics import coverage, fold_statistics, horizon_gain, largest_errors, score, summarize
from slotwise.plans.postprocess import apply_limits
from slotwise.plans.splits import add_folds, fold_table
from slotwise.sources.tables import training_only


def rolling_validation(
    grid: DataFrame, models: Sequence[Model], rule, horizons: Sequence[int], label: str = "label",
    series: Sequence[str] = ("series_id",), step_seconds: int = 900, carry: Sequence[str] = (),
) -> DataFrame:
    """Tidy out-of-sample table of all models and folds in one job (the fold is a column).

    ``grid`` holds the model input as ``value`` and the raw truth as ``label``; scoring rows are refused.
    """
    if "source" in grid.columns:
        grid = training_only(grid).drop("source")
    folds = fold_table(grid, rule, max(horizons), series, step_seconds)
    origins = add_folds(grid.select(*series, "pos").distinct(), rule, folds, series)
    return forecast(grid, models, horizons, origins, label=label, carry=carry)


def schemes(grid: DataFrame, models: Sequence[Model], rules: Mapping[str, object], horizons: Sequence[int], **options) -> DataFrame:
    """Validation under several split schemes, told apart by ``validation_type``."""
    out = None
    for name, rule in rules.items():
        part = rolling_validation(grid, models, rule, horizons, **options).withColumn("validation_type", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def scheme_gains(tidy: DataFrame, model: str, baseline: str, by: Sequence[str] = ("validation_type", "fold")) -> DataFrame:
    """Overall error of a model and the baseline per scheme and fold, and the gain."""
    def overall(column: str) -> DataFrame:
        return summarize(tidy.withColumn("y_pred", F.col(column)), by).where("scope = 'overall'").select(
            *by, F.col("mape").alias(f"mape_{column}"), "sample_count")

    joined = overall(model).join(overall(baseline).drop("sample_count"), list(by))
    return joined.withColumn("gain", F.col(f"mape_{baseline}") - F.col(f"mape_{model}"))


def detailed(tidy: DataFrame, baseline: DataFrame, worst: int = 50) -> dict[str, DataFrame]:
    """The whole review bundle of one forecast (needs condition columns beside the predictions)."""
    per_fold = summarize(tidy, ["fold"])
    return {
        "fold_metrics": per_fold,
        "aggregate_metrics": fold_statistics(per_fold),
        "condition_metrics": summarize(tidy, ["condition"]),
        "horizon_curve": summarize(tidy).where("scope = 'target_horizon'"),
        "baseline_gain": horizon_gain(tidy, baseline),
        "coverage": coverage(tidy),
        "worst_errors": largest_errors(tidy, worst, ["field", "fold", "pos", "horizon"]),
    }


def reachability(
    metrics: DataFrame, alignment: DataFrame, model: str = "model", baseline: str = "last_value", stable: float = 99.5,
    leading: float = 99.9, alignment_gain: float = 1.0,
) -> DataFrame:
    """One row: baseline score, best model, gain under a wrong alignment, and what follows from them."""
    overall = metrics.where("scope = 'overall'")
    head = overall.agg(
        (100 * F.max(F.when(F.col(model) == baseline, F.col("score_1_mape")))).alias("baseline_score_percent"),
        F.min_by(model, F.struct("mape", model)).alias("best_model"),
        (100 * F.min_by("score_1_mape", F.struct("mape", model))).alias("best_score_percent"))
    shift = alignment.agg(
        (F.max(F.when(F.col("label_offset_steps") != 0, F.col("score_percent")))
         - F.max(F.when(F.col("label_offset_steps") == 0, F.col("score_percent")))).alias("wrong_alignment_gain"))
    notes = F.array_compact(F.array(
        F.when(F.col("baseline_score_percent") >= stable, "series barely moves"),
        F.when(F.col("best_score_percent") < leading, "leading range not reached by legal models"),
        F.when(F.col("wrong_alignment_gain") >= alignment_gain, "check origin and target columns")))
    return beside(head, shift).withColumn("notes", notes)


def local_scores(tidy: DataFrame, by: str = "validation_type", **options) -> DataFrame:
    """Score, folds and pairs per validation window."""
    sizes = tidy.groupBy(by).agg(F.count_distinct("fold").alias("folds"), F.count(F.lit(1)).alias("prediction_pairs"))
    return score(tidy, [by], **options).join(sizes, by)


def predict_tables(
    tidy: DataFrame, targets: Sequence[str], short: int, long: int, step_minutes: int = 15, **limits,
) -> dict[str, DataFrame]:
    """Raw and limited forecasts, the limited one also cut to the short horizon; wide sink layout."""
    from slotwise.plans.forecast import pivot_forecast

    limited = apply_limits(tidy, **limits)
    wide = lambda df, upto, column: pivot_forecast(
        df.where(F.col("horizon") <= upto), targets, range(1, upto + 1), step_minutes, column)
    return {"raw": wide(limited, long, "y_pred"), "long": wide(limited, long, "y_limited"), "short": wide(limited, short, "y_limited")}


def with_clock(tidy: DataFrame, step_seconds: int) -> DataFrame:
    """Origin and target times with the month-change and weekend flags of a prediction row."""
    timed = tidy.withColumns({"origin": slot_start("pos", step_seconds), "target_ts": slot_start("target_pos", step_seconds)})
    return timed.withColumns({
        "month_change": (F.month("origin") != F.month("target_ts")).cast("int"),
        "weekend": (F.weekday("origin") >= 5).cast("int")})
