"""Choosing between candidate forecasts row by row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.clock import minute_of_day
from slotwise.functions.numbers import ape_floor
from slotwise.session import cut_lineage


def oracle(wide: DataFrame, models: Sequence[str], out: str = "best") -> DataFrame:
    """Upper bound: the candidate with the least error in hindsight, the earlier one on a tie."""
    rated = F.array(*[
        F.struct(ape_floor("y_true", m).alias("e"), F.lit(i).alias("i"), F.col(m).alias("p")) for i, m in enumerate(models)])
    return wide.withColumn(out, F.array_min(rated)["p"])


def blend_shares(wide: DataFrame, incumbent: str, challenger: str, shares: Sequence[float]) -> DataFrame:
    """One copy of each row per share of the challenger."""
    spread = wide.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    return spread.withColumn("y_pred", (1 - F.col("share")) * F.col(incumbent) + F.col("share") * F.col(challenger))


def pick_least(models: Sequence[str], expected: Column) -> Column:
    """Prediction of the candidate with the least expected error."""
    pairs = F.arrays_zip(expected.alias("e"), F.array(*[F.lit(i) for i in range(len(models))]).alias("i"))
    best = F.array_min(F.transform(pairs, lambda p: F.struct(p["e"].alias("e"), p["i"].alias("i"))))["i"]
    return F.get(F.array(*[F.col(m) for m in models]), best)


def softmax_blend(models: Sequence[str], expected: Column, temperature: float) -> Column:
    """Candidates weighted by exp(-expected / temperature)."""
    least = F.array_min(expected)
    raw = F.transform(expected, lambda e: F.exp((least - e) / max(temperature, 1e-6)))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    terms = F.zip_with(F.array(*[F.col(m) for m in models]), raw, lambda p, w: p * w)
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / total


def router_features(wide: DataFrame, models: Sequence[str], anchor: str = "last_value", origin: str = "origin",
                    target: str = "target_ts") -> DataFrame:
    """Cyclic times, scaled candidates, their distance to the first one, spread, range and direction."""
    scale = F.greatest(F.abs(F.col(anchor)), F.lit(1.0))
    values = F.array(*[F.col(m) for m in models])
    n = len(models)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    variance = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / n
    ordered = F.array_sort(values)
    median = (F.get(ordered, F.lit((n - 1) // 2)) + F.get(ordered, F.lit(n // 2))) / 2
    added: dict[str, Column] = {}
    for name, ts in (("origin", F.col(origin)), ("target", F.col(target))):
        day, week = minute_of_day(ts) * (2 * 3.141592653589793 / 1440), F.weekday(ts) * (2 * 3.141592653589793 / 7)
        added |= {f"{name}_day_sin": F.sin(day), f"{name}_day_cos": F.cos(day),
                  f"{name}_week_sin": F.sin(week), f"{name}_week_cos": F.cos(week)}
    for m in models:
        added[f"pred_{m}"] = F.col(m) / scale
        added[f"delta_{m}"] = (F.col(m) - F.col(models[0])) / scale
    added |= {
        "candidate_std": F.sqrt(variance) / scale,
        "candidate_range": (F.array_max(values) - F.array_min(values)) / scale,
        "candidate_direction": (median - F.col(models[0])) / scale,
    }
    return wide.withColumn("_mean", mean).withColumns(added).drop("_mean")


def candidate_errors(wide: DataFrame, models: Sequence[str]) -> Column:
    return F.array(*[ape_floor("y_true", m) for m in models])


def route_by_error(
    train: DataFrame, held: DataFrame, names: Sequence[str], models: Sequence[str], learner, model_share: float = 0.5,
    temperature: float = 0.02, soft: bool = True, out: str = "routed",
) -> DataFrame:
    """A regression of every candidate's error, mixed with its mean error, decides or blends.

    The error is learnt as log(1 + 50 e), as in a robust regression of a heavy-tailed loss.
    """
    from slotwise.plans.learned import ml_stages

    train = cut_lineage(train.withColumn("weight", F.lit(1.0)))
    priors = train.agg(*[F.avg(ape_floor("y_true", m)).alias(m) for m in models]).first()
    scored, expected = held, []
    for m in models:
        mine = train.withColumn("response", F.log1p(50 * ape_floor("y_true", m)))
        fitted = ml_stages(names, learner()).fit(mine)
        scored = fitted.transform(scored).withColumn(f"_e_{m}", F.expm1("_predicted") / 50).select(*scored.columns, f"_e_{m}")
        expected.append(model_share * F.greatest(F.col(f"_e_{m}"), F.lit(0.0)) + (1 - model_share) * F.lit(float(priors[m])))
    rows = scored.withColumn("_expected", F.array(*expected))
    chosen = softmax_blend(models, F.col("_expected"), temperature) if soft else pick_least(models, F.col("_expected"))
    return rows.withColumn(out, chosen).drop("_expected", *[f"_e_{m}" for m in models])


def route_by_winner(
    train: DataFrame, held: DataFrame, names: Sequence[str], models: Sequence[str], seed: int = 42, trees: int = 20,
    depth: int = 3, soft: bool = True, out: str = "routed",
) -> DataFrame:
    """A classifier of the best candidate, rows weighted by the margin to the second best."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    from slotwise.operators.order_stats import exact_quantiles
    from slotwise.plans.learned import ml_stages

    errors = candidate_errors(train, models)
    ordered = F.array_sort(errors)
    rows = train.withColumns({
        "response": (F.array_position(errors, F.array_min(errors)) - 1).cast("double"),
        "_margin": F.greatest(F.get(ordered, F.lit(1)) - F.get(ordered, F.lit(0)), F.lit(1e-4))})
    rows = cut_lineage(rows.where(F.col("response") >= 0))
    middle = exact_quantiles(rows.withColumn("_one", F.lit(1)), ["_one"], F.col("_margin"), {"m": 0.5}).first()["m"]
    rows = rows.withColumn("weight", F.least(F.greatest(F.col("_margin") / middle, F.lit(0.25)), F.lit(8.0)))
    learner = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="vector", labelCol="response",
                                     weightCol="weight", predictionCol="_predicted", probabilityCol="_probability")
    scored = ml_stages(names, learner).fit(rows).transform(held).withColumn("_share", vector_to_array("_probability"))
    values = F.array(*[F.col(m) for m in models])
    if soft:
        terms = F.zip_with(values, F.col("_share"), lambda v, p: v * F.coalesce(p, F.lit(0.0)))
        chosen = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    else:
        chosen = F.get(values, F.col("_predicted").cast("int"))
    return scored.withColumn(out, chosen).select(*held.columns, out)


def stack_ratio(
    train: DataFrame, held: DataFrame, names: Sequence[str], learner, anchor: str = "last_value", clip: tuple[float, float] | None = None,
    share: float = 1.0, scaled: bool = False, out: str = "routed",
) -> DataFrame:
    """Learn truth over anchor and multiply it back.

    With ``clip`` and ``share`` the learnt ratio is limited and only that share of its distance to 1
    is applied (a residual around an incumbent); without them it is a plain stack.
    """
    from slotwise.plans.learned import ml_stages

    size = F.greatest(F.abs(F.col(anchor)), F.lit(1.0))
    rows = train.where(F.col("y_true").isNotNull()).withColumns({
        "response": F.col("y_true") / size, "_w": size / F.greatest(F.abs("y_true"), F.lit(1.0))})
    rows = cut_lineage(rows)
    mean = rows.agg(F.avg("_w")).first()[0]
    fitted = ml_stages(names, learner(), scaled).fit(rows.withColumn("weight", F.col("_w") / mean))
    scored = fitted.transform(held)
    ratio = F.col("_predicted")
    if clip:
        ratio = 1 + share * (F.least(F.greatest(ratio, F.lit(clip[0])), F.lit(clip[1])) - 1)
    return scored.withColumn(out, ratio * size).select(*held.columns, out)


def cross_fit(wide: DataFrame, run, fold: str = "fold") -> DataFrame:
    """Each fold predicted by ``run(train, held)`` fitted on the other folds."""
    wide = cut_lineage(wide)
    parts = None
    for row in wide.select(fold).distinct().orderBy(fold).collect():
        held = wide.where(F.col(fold) == row[fold])
        done = run(wide.where(F.col(fold) != row[fold]), held)
        parts = done if parts is None else parts.unionByName(done)
    return parts
