"""Error metrics of tidy predictions: grouping sets, scores, fold statistics, error groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.functions.numbers import ape_floor, ape_official, finite
from slotwise.operators.blocks import beside
from slotwise.operators.order_stats import exact_quantiles

# fixed values: the name of all targets, and the risk classes of labels ahead, behind and in place
ALL = "__all__"
ALIGNMENT_RISKS = ("red_future_diagnostic_only", "amber_wrong_alignment", "official_alignment")
BUNDLE = ("sample_count", "mape", "score_1_mape", "near_zero_count", "zero_count", "mae", "rmse", "bias")


def usable_pair(y: str = "y_true", p: str = "y_pred") -> Column:
    return finite(y).isNotNull() & finite(p).isNotNull()


def bundle(y: str = "y_true", p: str = "y_pred", near_zero: float = 1e-6) -> list[Column]:
    """Aggregates over usable pairs; the percentage error keeps its infinities."""
    ok = usable_pair(y, p)
    truth, guess = F.col(y), F.col(p)
    mape = F.avg(F.when(ok, ape_official(truth, guess)))
    return [
        F.count_if(ok).alias("sample_count"),
        mape.alias("mape"),
        (1.0 - mape).alias("score_1_mape"),
        F.count_if(ok & (F.abs(truth) <= near_zero)).alias("near_zero_count"),
        F.count_if(ok & (truth == 0)).alias("zero_count"),
        F.avg(F.when(ok, F.abs(guess - truth))).alias("mae"),
        F.sqrt(F.avg(F.when(ok, (guess - truth) * (guess - truth)))).alias("rmse"),
        F.avg(F.when(ok, guess - truth)).alias("bias"),
    ]


def summarize(
    tidy: DataFrame, by: Sequence[str] = (), near_zero: float = 1e-6, step_minutes: int = 15,
    target: str = "field", horizon: str = "horizon", y: str = "y_true", p: str = "y_pred",
) -> DataFrame:
    """Four grains in one aggregation: target and horizon, target, horizon, overall."""
    cols = [*by, target, horizon]
    sets = [[*by, target, horizon], [*by, target], [*by, horizon], [*by]]
    grouped = tidy.groupingSets(sets, *cols).agg(
        F.grouping(target).alias("_gt"), F.grouping(horizon).alias("_gh"),
        *bundle(y, p, near_zero), F.count_if(~usable_pair(y, p)).alias("_bad"))
    scope = (
        F.when((F.col("_gt") == 0) & (F.col("_gh") == 0), "target_horizon")
        .when(F.col("_gt") == 0, "target").when(F.col("_gh") == 0, "horizon").otherwise("overall"))
    steps = F.when(F.col("_gh") == 0, F.col(horizon)).otherwise(F.lit(-1))
    return grouped.where("sample_count > 0").select(
        *by, scope.alias("scope"),
        F.when(F.col("_gt") == 0, F.col(target)).otherwise(F.lit(ALL)).alias(target),
        steps.alias("horizon_steps"),
        F.when(F.col("_gh") == 0, F.col(horizon) * step_minutes).otherwise(F.lit(-1)).alias("horizon_minutes"),
        *BUNDLE,
        F.when(scope == "overall", F.col("_bad")).otherwise(F.lit(0)).alias("excluded_non_finite_pairs"))


def score(
    tidy: DataFrame, by: Sequence[str] = (), target_weights: Mapping[str, float] | None = None,
    horizon_weights: Mapping[int, float] | None = None, percent: bool = False, display_scale: float = 1.0,
    data_score: float | None = None, mix: tuple[float, float] | None = None,
    target: str = "field", horizon: str = "horizon",
) -> DataFrame:
    """Weighted mean over (target, horizon) cells of 1 - MAPE, with the cells as a map."""
    scale = 100.0 if percent else display_scale
    ok = usable_pair()
    cells = tidy.groupBy(*by, target, horizon).agg(
        F.avg(F.when(ok, ape_official("y_true", "y_pred"))).alias("_mape"), F.count_if(ok).alias("_n")).where("_n > 0")
    weight = _lookup(F.col(target), target_weights) * _lookup(F.col(horizon), horizon_weights)
    scored = cells.withColumn("_w", weight).withColumn("_s", 1.0 - F.col("_mape"))
    name = F.concat(F.col(target), F.lit("_h"), F.col(horizon).cast("string"))
    part = F.struct(name.alias("cell"), (F.col("_s") * scale).alias("score"))
    out = scored.groupBy(*by).agg(
        F.when(F.sum("_w") > 0, F.sum(F.col("_s") * F.col("_w")) / F.sum("_w") * scale).alias("prediction_score"),
        F.map_from_entries(F.array_sort(F.collect_list(part))).alias("components"))
    final = F.col("prediction_score")
    if mix is not None:
        if data_score is None:
            raise ValueError("a mixed score needs a data score")
        final = final * mix[0] + data_score * mix[1]
    return out.select(*by, "prediction_score", final.alias("final_score"), "components")


def _lookup(key: Column, weights: Mapping | None) -> Column:
    out = F.lit(1.0)
    for name, weight in (weights or {}).items():
        out = F.when(key == name, F.lit(float(weight))).otherwise(out)
    return out


def fold_statistics(fold_metrics: DataFrame, by: Sequence[str] = (), target: str = "field") -> DataFrame:
    """Mean, spread and worst over folds of every metric cell; one fold has spread 0."""
    keys = [*by, "scope", target, "horizon_steps", "horizon_minutes"]
    spread = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    return fold_metrics.groupBy(*keys).agg(
        F.avg("mape").alias("mape_mean"), spread("mape").alias("mape_std"), F.max("mape").alias("mape_worst"),
        F.avg("score_1_mape").alias("score_mean"), spread("score_1_mape").alias("score_std"),
        F.min("score_1_mape").alias("score_worst"), F.avg("mae").alias("mae_mean"), F.avg("rmse").alias("rmse_mean"),
        F.avg("bias").alias("bias_mean"), F.count_distinct("fold").alias("folds"))


def horizon_gain(tidy: DataFrame, baseline: DataFrame, by: Sequence[str] = (), target: str = "field") -> DataFrame:
    """Horizon curve of a forecast beside the curve of a baseline."""
    curve = summarize(tidy, by, target=target).where("scope = 'target_horizon'")
    base = summarize(baseline, by, target=target).where("scope = 'target_horizon'").select(
        *by, target, "horizon_steps", F.col("mape").alias("baseline_mape"), F.col("score_1_mape").alias("baseline_score"))
    return curve.join(base, [*by, target, "horizon_steps"], "left").withColumns({
        "mape_gain": F.col("baseline_mape") - F.col("mape"),
        "score_gain": F.col("score_1_mape") - F.col("baseline_score")})


def coverage(tidy: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of conditions, months, weekend rows, month changes, gaps, starts and stops."""
    totals = tidy.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.array_sort(F.collect_set(F.date_format("origin", "yyyy-MM"))).alias("months"),
        F.count_if(F.col("weekend") == 1).alias("weekend_rows"),
        F.count_if(F.col("month_change") == 1).alias("month_change_rows"),
        F.count_if(F.col("missing") > 0).alias("high_missing_rows"),
        F.sum("startup").alias("startup_rows"), F.sum("shutdown").alias("shutdown_rows"))
    per = tidy.groupBy(*by, "condition").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("condition", "n")))).alias("conditions"))
    return totals.join(per, list(by)) if by else beside(totals, per)


def floored_means(tidy: DataFrame, sets: Sequence[Sequence[str]], name: str = "mean_ape") -> DataFrame:
    """Mean floored error per grain (fold, target, target and horizon ...) in one aggregation."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    return tidy.groupingSets([list(s) for s in sets], *cols).agg(
        F.avg(ape_floor("y_true", "y_pred")).alias(name), F.count(F.lit(1)).alias("rows"),
        F.grouping_id(*cols).alias("grain"))


def largest_errors(tidy: DataFrame, count: int, ties: Sequence[str] = ()) -> DataFrame:
    """Report of the worst rows: percentage error first, then absolute error; undefined errors last."""
    pct = ape_official("y_true", "y_pred")
    rated = tidy.withColumn("absolute_percentage_error", F.when(~F.isnan(pct), pct)).withColumn(
        "absolute_error", F.abs(F.col("y_true") - F.col("y_pred")))
    return rated.orderBy(F.col("absolute_percentage_error").desc_nulls_last(),
                         F.col("absolute_error").desc_nulls_last(), *ties).limit(count)


def tail_errors(tidy: DataFrame, keys: Sequence[str] = ("field", "horizon"), share: float = 0.95) -> DataFrame:
    """Rows whose floored error reaches their group's percentile."""
    rated = tidy.withColumn("ape", ape_floor("y_true", "y_pred"))
    limits = exact_quantiles(rated, keys, F.col("ape"), {"threshold": share}).drop("n")
    return rated.join(limits, list(keys)).where(F.col("ape") >= F.col("threshold"))


def error_groups(tidy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples, mean and 95th percentile of the floored error per group."""
    rated = tidy.withColumn("ape", ape_floor("y_true", "y_pred"))
    means = rated.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.avg("ape").alias("mean_mape"))
    # groups may hold null keys (a flag that is not known), hence the null-safe join
    tails = exact_quantiles(rated.withColumn("_key", F.struct(*keys)), ["_key"], F.col("ape"), {"p95_mape": 0.95})
    return means.withColumn("_key", F.struct(*keys)).join(tails.drop("n"), "_key", "left").drop("_key")


def best_by(metrics: DataFrame, keys: Sequence[str], model: str = "model") -> DataFrame:
    """Best strategy per key: least MAPE, then RMSE, then name."""
    order = Window.partitionBy(*keys).orderBy("mape", "rmse", model)
    return metrics.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def alignment(wide: DataFrame, labels: DataFrame, prediction: str = "last_value", offsets: Sequence[int] = (-2, -1, 0, 1, 2),
              keys: Sequence[str] = ("series_id", "field"), step_minutes: int = 15) -> DataFrame:
    """Score of a forecast against labels moved by a few slots; only offset 0 may select a model."""
    moved = labels.where(F.col("label").isNotNull()).withColumn(
        "offset", F.explode(F.array(*[F.lit(o) for o in offsets]))).select(
        *keys, "offset", (F.col("pos") - F.col("offset")).alias("target_pos"), F.col("label").alias("_y"))
    pairs = wide.where(finite(prediction).isNotNull()).join(moved, [*keys, "target_pos"])
    out = pairs.groupBy("offset").agg(*bundle("_y", prediction))
    ahead, behind, right = ALIGNMENT_RISKS
    risk = F.when(F.col("offset") > 0, ahead).when(F.col("offset") < 0, behind).otherwise(right)
    return out.select(
        F.col("offset").alias("label_offset_steps"), (F.col("offset") * step_minutes).alias("label_offset_minutes"),
        "sample_count", "mape", "score_1_mape", (F.col("score_1_mape") * 100).alias("score_percent"),
        "near_zero_count", risk.alias("risk"), (F.col("offset") == 0).alias("used_for_model_selection"))
