"""Leakage audit and relation discovery over the aligned grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.functions.slots import slot_start
from slotwise.operators.blocks import beside, running_total, with_halo
from slotwise.operators.clean import constant_runs
from slotwise.operators.correlate import (
    complete_row, finite_row, lag_moments, least_squares, least_squares_direct, shift_risk, with_residual,
)
from slotwise.operators.order_stats import exact_quantiles

SITE = ("series_id",)
# fixed values: kinds of findings
COPY_KIND = "affine_or_shifted_copy"
AHEAD_KIND = "future_target_high_correlation"
COMBINED_KIND = "multivariate_linear_combination"


def lag_table(moments: DataFrame, step_minutes: int = 15) -> DataFrame:
    return moments.withColumns({
        "offset_minutes": F.col("offset") * step_minutes, "absolute_correlation": F.abs("correlation"),
        "risk": shift_risk(F.col("offset"))})


def _best(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.round(F.abs("correlation"), 9).desc_nulls_last(), "offset")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def copies(moments: DataFrame, targets: Sequence[str], correlation: float = 0.995, residual: float = 0.01,
           keys: Sequence[str] = SITE) -> DataFrame:
    """Fields that reproduce a target, shifted or not, up to an affine map.

    The share of the target's spread a line leaves over is sqrt(1 - r^2), so the moments suffice.
    """
    near = moments.where((F.abs("correlation") >= correlation) & ~F.col("field").isin(list(targets)))
    left = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("correlation") * F.col("correlation")))
    found = _best(near, [*keys, "field", "target"]).withColumn("residual_ratio", left)
    return found.where(F.col("residual_ratio") <= residual).withColumns({
        "kind": F.lit(COPY_KIND), "risk": F.when(F.col("offset") > 0, "red").otherwise("amber")})


def future_correlations(moments: DataFrame, targets: Sequence[str], correlation: float = 0.995,
                        keys: Sequence[str] = SITE) -> DataFrame:
    """Fields highly correlated with a later target value."""
    ahead = moments.where(
        (F.col("offset") > 0) & (F.abs("correlation") >= correlation) & ~F.col("field").isin(list(targets)))
    return _best(ahead, [*keys, "field", "target"]).withColumns({
        "kind": F.lit(AHEAD_KIND), "risk": F.lit("red")})


def multivariate_fit(wide: DataFrame, fields: Sequence[str], target: str, train_share: float = 0.7,
                     keys: Sequence[str] = SITE, block: int | None = None) -> DataFrame:
    """Out-of-time fit of a target by all other fields: early part fits, late part judges. ``combinations`` tells which are copies.

    (keys, target, rows, test_rows, r2, residual_ratio, intercept, coefficients). Rows with a value that is not finite don't count.
    """
    complete = wide.select(*keys, "pos", *fields, F.col(target).alias("_y")).where(finite_row([*fields, "_y"]))
    numbered = running_total(complete, keys, F.lit(1).cast("bigint"), "_k", block=block)
    sizes = complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    # an exact decimal share: 90 * 0.7 is just under 63 in doubles, and a row would change sides
    cut = F.greatest(F.lit(20), F.floor(F.col("rows") * F.lit(Decimal(str(train_share)))))
    split = numbered.join(sizes.where(F.col("rows") >= max(30, 2 * len(fields))), list(keys)).withColumn(
        "_train", F.col("_k") <= cut)
    fit = least_squares_direct(split.where("_train"), keys, fields, "_y").drop("n")
    tested = with_residual(split.where("NOT _train"), fit, keys, fields, "_y")
    out = tested.groupBy(*keys).agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("test_rows"),
        F.sum(F.col("residual") * F.col("residual")).alias("_sse"), (F.var_pop("_y") * F.count("_y")).alias("_sst"),
        F.first("intercept").alias("intercept"), F.first("coefficients").alias("coefficients"))
    return out.where("test_rows >= 10").select(
        *keys, F.lit(target).alias("target"), "rows", "test_rows",
        (1 - F.col("_sse") / F.greatest("_sst", F.lit(1e-12))).alias("r2"),
        (F.sqrt(F.col("_sse") / F.col("test_rows")) / F.greatest(F.sqrt(F.col("_sst") / F.col("test_rows")), F.lit(1e-12))).alias("residual_ratio"),
        "intercept", "coefficients")


def combinations(fit: DataFrame, r2: float = 0.995) -> DataFrame:
    """``fit`` with ``candidate``, and kind and risk of the targets that the fields make up in the late part too."""
    copy = F.coalesce(F.col("r2") >= r2, F.lit(False))
    return fit.withColumns({
        "candidate": copy, "kind": F.when(copy, F.lit(COMBINED_KIND)), "risk": F.when(copy, F.lit("amber"))})


def strongest(fit: DataFrame, fields: Sequence[str], count: int = 8) -> DataFrame:
    """The fields with the largest coefficients, as JSON (a report of at most ``count`` entries)."""
    names = F.array(*[F.lit(f) for f in fields])
    ranked = F.array_sort(F.transform(
        F.arrays_zip(F.col("coefficients").alias("c"), names.alias("f")),
        lambda p: F.struct((-F.abs(p["c"])).alias("o"), p["f"].alias("f"), p["c"].alias("c"))))
    top = F.slice(ranked, 1, count)
    return fit.withColumn("features", F.to_json(F.transform(top, lambda p: p["f"]))).withColumn(
        "weights", F.to_json(F.map_from_entries(F.transform(top, lambda p: F.struct(p["f"], p["c"])))))


def suspicious_names(names: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Names holding a keyword; words about the future or the label weigh heavier."""
    low = F.lower("name")
    hits = F.array_compact(F.array(*[F.when(low.contains(k.lower()), F.lit(k.lower())) for k in keywords]))
    # fixed values: keywords that make a name a red risk
    grave = F.arrays_overlap("matched", F.array(F.lit("future"), F.lit("label"), F.lit("target")))
    return names.withColumn("matched", hits).where(F.size("matched") > 0).withColumn(
        "risk", F.when(grave, "red").otherwise("amber"))


def boundary_sensitivity(variants: DataFrame, label: str = "right", closed: str = "right",
                         keys: Sequence[str] = ("series_id", "field")) -> DataFrame:
    """Mean absolute difference of every boundary variant from the reference one on common slots."""
    base = variants.where((F.col("label") == label) & (F.col("closed") == closed)).select(
        *keys, "pos", F.col("value").alias("_ref"))
    per = variants.join(base, [*keys, "pos"]).groupBy("label", "closed", "field").agg(
        F.avg(F.abs(F.col("value") - F.col("_ref"))).alias("_d"), F.count(F.lit(1)).alias("_n"))
    return per.groupBy("label", "closed").agg(
        F.sum("_n").alias("common_rows"), F.avg("_d").alias("mean_absolute_difference")).withColumn(
            "reference", (F.col("label") == label) & (F.col("closed") == closed))


def first_findings(findings: DataFrame, keys: Sequence[str] = ("field", "target", "kind", "offset"),
                   order: Sequence[str] = ("priority",)) -> DataFrame:
    """De-duplicated findings, the first by a stated order kept."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return findings.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def check_summary(checks: Mapping[str, DataFrame]) -> DataFrame:
    """One row per check from its offending rows: (check, offending, status)."""
    out = None
    for name, offenders in checks.items():
        part = offenders.agg(F.count(F.lit(1)).alias("offending")).select(F.lit(name).alias("check"), "offending")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("status", F.when(F.col("offending") == 0, "passed").otherwise("failed"))


@dataclass(frozen=True)
class Relation:
    name: str
    target: str
    fields: Sequence[str]


def with_change(wide: DataFrame, column: str, out: str, keys: Sequence[str] = SITE, block: int | None = None) -> DataFrame:
    return with_halo(wide, keys, lambda rows, w: rows.withColumn(out, F.col(column) - F.lag(column).over(w)), back=1, block=block)


def linear_relation(
    wide: DataFrame, relation: Relation, threshold: float = 0.98, step_seconds: int = 900, keys: Sequence[str] = SITE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, monthly fit, five worst rows) of one linear relation per series."""
    fields, target = list(relation.fields), relation.target
    rows = wide.select(*keys, "pos", *dict.fromkeys([*fields, target]))
    fit = least_squares(rows, keys, fields, target).where(F.col("n") >= max(30, 5 * len(fields)))
    left = with_residual(rows, fit, keys, fields, target).withColumn(
        "month", F.date_format(slot_start("pos", step_seconds), "yyyy-MM"))
    square, absolute = F.col("residual") * F.col("residual"), F.abs("residual")
    r2 = lambda: 1 - F.sum(square) / F.greatest(F.var_pop(target) * F.count(target), F.lit(1e-12))
    whole = left.groupBy(*keys).agg(
        r2().alias("r2"), F.avg("residual").alias("residual_mean"), F.stddev_pop("residual").alias("residual_std"))
    tails = exact_quantiles(left, keys, absolute, {"residual_p50_abs": 0.5, "residual_p95_abs": 0.95}).drop("n")
    monthly = left.groupBy(*keys, "month").agg(r2().alias("r2"), F.count(F.lit(1)).alias("n")).where("n >= 10")
    stable = monthly.groupBy(*keys).agg(
        F.to_json(F.array_sort(F.collect_list(F.when(F.col("r2") >= threshold, F.col("month"))))).alias("stable_months"))
    named = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.col("coefficients"))
    summary = (
        fit.join(whole, list(keys)).join(tails, list(keys)).join(stable, list(keys), "left")
        .select(*keys, F.lit(relation.name).alias("relation"), F.lit(target).alias("target"), "n",
                F.to_json(named).alias("coefficients_json"), "coefficients", "intercept", "r2", "residual_mean", "residual_std",
                "residual_p50_abs", "residual_p95_abs", "stable_months", (F.col("r2") >= threshold).alias("candidate")))
    order = Window.partitionBy(*keys).orderBy(absolute.desc(), "pos")
    worst = left.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select(
        F.lit(relation.name).alias("relation"), *keys, "rank", "pos", "residual")
    return summary, monthly.select(F.lit(relation.name).alias("relation"), *keys, "month", "n", "r2"), worst


def delay_pairs(
    wide: DataFrame, sources: Mapping[str, str], reach: int = 12, least: float = 0.90, least_pairs: int = 20,
    keys: Sequence[str] = SITE,
) -> DataFrame:
    """Best offset per pair of fields from different source tables, strong pairs only."""
    fields = [f for f in wide.columns if sources.get(f)]
    moments = lag_moments(wide, fields, fields, -reach, reach, keys, least_pairs)
    origin = lambda c: F.coalesce(*[F.when(F.col(c) == f, F.lit(sources[f])) for f in fields])
    place = lambda c: F.coalesce(*[F.when(F.col(c) == f, F.lit(i)) for i, f in enumerate(fields)])
    pairs = moments.withColumns({"left_source": origin("field"), "right_source": origin("target")}).where(
        (place("field") < place("target")) & (F.col("left_source") != F.col("right_source")) & F.col("correlation").isNotNull())
    best = _best(pairs, [*keys, "field", "target"]).where(F.abs("correlation") >= least)
    return best.select(
        *keys, F.col("field").alias("left_field"), "left_source", F.col("target").alias("right_field"), "right_source",
        F.col("offset").alias("right_offset"), "correlation",
        F.when(F.col("offset") > 0, "red").otherwise("review").alias("risk"))


def segment_statistics(grid: DataFrame, tolerance: float = 0.05, keys: Sequence[str] = ("series_id", "field"),
                       block: int | None = None) -> DataFrame:
    """Share of unchanged slots, change points, longest and median constant run."""
    runs = constant_runs(grid, tolerance, keys, block).groupBy(*keys, "run").agg(
        F.count(F.lit(1)).alias("length"), F.sum("changed").alias("changed"))
    whole = runs.groupBy(*keys).agg(
        (1 - F.sum("changed") / F.sum("length")).alias("stable_fraction"), F.sum("changed").alias("change_points"),
        F.max("length").alias("longest_constant_run"))
    middle = exact_quantiles(runs, keys, F.col("length").cast("double"), {"median_constant_run": 0.5}).drop("n")
    return whole.join(middle, list(keys))


def setpoints(grid: DataFrame, step: float = 1.0, count: int = 10, keys: Sequence[str] = ("series_id", "field")) -> DataFrame:
    """The values a series rests on most often, rounded to ``step``, with their share."""
    rounded = grid.where(F.col("value").isNotNull()).groupBy(*keys, (F.rint(F.col("value") / step) * step).alias("setpoint")).agg(
        F.count(F.lit(1)).alias("sample_count"))
    total = rounded.groupBy(*keys).agg(F.sum("sample_count").alias("_all"))
    order = Window.partitionBy(*keys).orderBy(F.desc("sample_count"), "setpoint")
    top = rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    return top.join(total, list(keys)).select(
        *keys, "setpoint", "sample_count", (F.col("sample_count") / F.col("_all")).alias("fraction"), "rank")


def plan_fields(fields: DataFrame, registry: DataFrame) -> DataFrame:
    return fields.join(registry.where("is_plan"), "field").select(
        "field", "available_at_origin", "allow_short", "allow_long", "pending")


def relation_summary(summaries: DataFrame, delays: DataFrame) -> DataFrame:
    """Counts of fitted relations, of those strong enough, and of delay candidates."""
    fitted = summaries.agg(F.count(F.lit(1)).alias("linear_relations"), F.count_if("candidate").alias("candidate_relations"))
    return beside(fitted, delays.agg(F.count(F.lit(1)).alias("delay_candidates")))
