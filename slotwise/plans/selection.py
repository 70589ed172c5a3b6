"""Fold subsets, fold coverage, candidate ordering and the diverse shortlist."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.functions.numbers import ape_floor
from slotwise.operators.blocks import beside
from slotwise.session import cut_lineage


def fold_subset(tidy: DataFrame, kind: str, count: int, fold: str = "fold") -> DataFrame:
    """``count`` folds spread evenly over those present, renamed ``<kind>_<fold>``."""
    folds = tidy.select(fold).distinct()
    total = Window.partitionBy()
    ranked = folds.withColumns({
        "_i": F.row_number().over(Window.orderBy(fold)) - 1, "_n": F.count(F.lit(1)).over(total)})
    k = F.least(F.lit(count), F.col("_n"))
    spots = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(
        k > 1, F.floor(i * (F.col("_n") - 1) / F.greatest(k - 1, F.lit(1)))).otherwise(F.lit(0)).cast("int"))
    kept = ranked.where(F.array_contains(spots, F.col("_i"))).select(fold)
    return tidy.join(kept, fold, "left_semi").withColumn("validation_type", F.lit(kind)).withColumn(
        fold, F.concat(F.lit(f"{kind}_"), F.col(fold).cast("string")))


def combine_windows(recent: DataFrame, cross_month: DataFrame, recent_folds: int, cross_folds: int) -> DataFrame:
    return fold_subset(recent, "recent", recent_folds).unionByName(fold_subset(cross_month, "cross_month", cross_folds))


def fold_coverage(tidy: DataFrame, recent_folds: int, cross_folds: int, fold: str = "fold") -> DataFrame:
    """Folds missing from or unexpected in a selection table; no rows means full coverage."""
    names = [f"recent_{i}" for i in range(recent_folds)] + [f"cross_month_{i}" for i in range(cross_folds)]
    spark: SparkSession = tidy.sparkSession
    expected = spark.createDataFrame([(n,) for n in names], "fold string")
    found = tidy.select(F.col(fold).alias("fold")).distinct()
    return expected.subtract(found).withColumn("problem", F.lit("missing")).unionByName(
        found.subtract(expected).withColumn("problem", F.lit("unexpected")))


def order_candidates(
    tidy: DataFrame, model: str = "model", shares: tuple[float, float, float, float] = (0.55, 0.10, 0.30, 0.05),
) -> DataFrame:
    """Weighted sum of recent mean, recent worst, cross-month mean and cross-month worst fold error."""
    folds = tidy.groupBy(model, "validation_type", "fold").agg(F.avg(ape_floor("y_true", "y_pred")).alias("mape"))
    pick = lambda kind, agg: agg(F.when(F.col("validation_type") == kind, F.col("mape")))
    out = folds.groupBy(model).agg(
        pick("recent", F.avg).alias("recent_mape"), pick("recent", F.max).alias("recent_worst_mape"),
        pick("cross_month", F.avg).alias("cross_month_mape"), pick("cross_month", F.max).alias("cross_month_worst_mape"))
    a, b, c, d = shares
    metric = (a * F.col("recent_mape") + b * F.col("recent_worst_mape") + c * F.col("cross_month_mape")
              + d * F.col("cross_month_worst_mape"))
    return out.withColumn("selection_metric", metric).orderBy("selection_metric", model)


def search_objective(tidy: DataFrame, model: str = "model", mean_share: float = 0.8) -> DataFrame:
    """Objective of a candidate: mean fold error mixed with the worst fold error."""
    folds = tidy.groupBy(model, "fold").agg(F.avg(ape_floor("y_true", "y_pred")).alias("mape"))
    return folds.groupBy(model).agg(
        (mean_share * F.avg("mape") + (1 - mean_share) * F.max("mape")).alias("objective"))


def diverse_shortlist(
    trials: DataFrame, top_k: int, preferred: Sequence[str] = (),
) -> DataFrame:
    """Shortlist of candidates from a trial table.

    ``trials``: number, value, parameterization, strategy, target_mape map, column_mape map. Taken
    in this order until ``top_k``: the best, the best per target (hardest target first), the best of
    each preferred parameterization, winners of most columns, the best of each family, the rest.
    """
    # one row per candidate, read by every tier below: stored once
    ranked = cut_lineage(trials.where(F.col("value").isNotNull()))
    rank = F.struct("value", "number")
    best = ranked.agg(F.min_by(F.col("number"), rank).alias("number"), F.min_by(F.col("target_mape"), rank).alias("_hard"))
    tiers = [best.select("number", F.lit(0).alias("tier"), F.lit(0.0).alias("major"), F.lit("").alias("minor"))]
    targets = ranked.select("number", "value", F.explode("target_mape").alias("target", "mape")).groupBy("target").agg(
        F.min_by("number", F.struct("mape", "value", "number")).alias("number"))
    tiers.append(beside(targets, best.select("_hard")).select(
        "number", F.lit(1).alias("tier"), (-F.coalesce(F.col("_hard")[F.col("target")], F.lit(0.0))).alias("major"),
        F.col("target").alias("minor")))
    for place, name in enumerate(preferred):
        tiers.append(ranked.where(F.col("parameterization") == name).agg(
            F.min_by(F.col("number"), rank).alias("number")).where("number IS NOT NULL").select(
                "number", F.lit(2).alias("tier"), F.lit(float(place)).alias("major"), F.lit("").alias("minor")))
    columns = ranked.select("number", "value", F.explode("column_mape").alias("column", "mape")).groupBy("column").agg(
        F.min_by(F.struct("number", "value"), F.struct("mape", "value", "number")).alias("w"))
    wins = columns.groupBy("w.number", "w.value").agg(F.count(F.lit(1)).alias("wins"))
    order = lambda *c: F.row_number().over(Window.orderBy(*c)).cast("double")
    tiers.append(wins.select("number", F.lit(3).alias("tier"), order(F.desc("wins"), "value", "number").alias("major"), F.lit("").alias("minor")))
    family = ranked.groupBy("parameterization", "strategy").agg(F.min(rank).alias("b"))
    tiers.append(family.select(F.col("b.number").alias("number"), F.lit(4).alias("tier"), F.col("b.value").alias("major"), F.lit("").alias("minor")))
    tiers.append(ranked.select("number", F.lit(5).alias("tier"), F.col("value").alias("major"), F.lit("").alias("minor")))
    stacked = tiers[0]
    for part in tiers[1:]:
        stacked = stacked.unionByName(part)
    first = stacked.groupBy("number").agg(F.min(F.struct("tier", "major", "minor")).alias("place"))
    chosen = first.orderBy("place", "number").limit(top_k)
    return chosen.join(ranked.select("number", "value"), "number").select(
        "number", "value", F.col("place.tier").alias("tier")).orderBy("value", "number")


def trial_table(tidy: DataFrame, parameterization: Mapping[str, str], strategy: Mapping[str, str]) -> DataFrame:
    """Trial rows (number, value, maps of errors) out of long tidy predictions of several candidates."""
    rated = tidy.withColumn("ape", ape_floor("y_true", "y_pred"))
    per_target = rated.groupBy("model", "field").agg(F.avg("ape").alias("m")).groupBy("model").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "m")))).alias("target_mape"))
    name = F.concat("field", F.lit("_h"), F.col("horizon").cast("string"))
    per_column = rated.groupBy("model", name.alias("column")).agg(F.avg("ape").alias("m")).groupBy("model").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "m")))).alias("column_mape"))
    value = search_objective(tidy).withColumnRenamed("objective", "value")
    look = lambda table: F.coalesce(*[F.when(F.col("model") == k, F.lit(v)) for k, v in table.items()], F.lit("unknown"))
    out = value.join(per_target, "model").join(per_column, "model").withColumns({
        "parameterization": look(parameterization), "strategy": look(strategy)})
    return out.withColumn("number", F.row_number().over(Window.orderBy("model")) - 1)


def join_candidates(parts: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per key with a column per candidate; unequal coverage or a repeated key fails.

    Long union plus one aggregation instead of a join per candidate.
    """
    stacked = None
    for name, df in parts.items():
        part = df.select(*keys, "y_true", F.lit(name).alias("_m"), F.col("y_pred").alias("_p"))
        stacked = part if stacked is None else stacked.unionByName(part)
    cells = [F.max(F.when(F.col("_m") == n, F.col("_p"))).alias(n) for n in parts]
    counts = [F.count_if(F.col("_m") == n) for n in parts]
    uneven = F.lit(False)
    for c in counts:
        uneven = uneven | (c != 1)
    out = stacked.groupBy(*keys).agg(
        F.max("y_true").alias("y_true"), *cells, uneven.alias("_uneven"),
        F.coalesce(F.max("y_true") - F.min("y_true"), F.lit(0.0)).alias("_spread"))
    refuse = F.raise_error(F.lit("candidates do not cover the same keys once with equal labels")).cast("boolean")
    return out.where(F.when(F.col("_uneven") | (F.col("_spread") != 0), refuse).otherwise(F.lit(True))).drop("_uneven", "_spread")


def compare_challenger(joined: DataFrame, incumbent: str, challenger: str, by: Sequence[str]) -> DataFrame:
    a, b = F.avg(ape_floor("y_true", incumbent)), F.avg(ape_floor("y_true", challenger))
    return joined.where(F.col("y_true").isNotNull()).groupBy(*by).agg(
        a.alias("incumbent_mape"), b.alias("challenger_mape"), (a - b).alias("mape_gain"),
        (100 * (a - b)).alias("score_gain"), F.count(F.lit(1)).alias("rows"))


def method_scores(long: DataFrame, by: Sequence[str], cell: Sequence[str] = ("field", "horizon")) -> DataFrame:
    """100 * (1 - mean over cells of the mean floored error) per method and group."""
    cells = list(dict.fromkeys([*by, *cell]))
    per = long.where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()).groupBy(*cells).agg(
        F.avg(ape_floor("y_true", "y_pred")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*by).agg((100 * (1 - F.avg("_m"))).alias("score"), F.sum("_n").alias("rows"))
