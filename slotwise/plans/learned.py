"""Learned forecasts on pyspark.ml: training sets, weights, augmentation, boosted, linear and forest models.

A training set is one DataFrame for all targets and horizons. Fits are distributed; the driver only
loops over the few targets (and, in the direct form, horizons) that each need their own model.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.functions.clock import calendar
from slotwise.functions.numbers import finite, mape_weight, safe_ratio
from slotwise.functions.slots import slot_start
from slotwise.operators.blocks import join_small, with_halo
from slotwise.operators.features import adjacent_pairs, lag_columns, rolling_columns
from slotwise.operators.order_stats import exact_quantiles, ranked_mass
from slotwise.operators.states import mixing_state, state_flags
from slotwise.plans.forecast import _at, with_trajectories
from slotwise.session import cut_lineage

KEYS = ("series_id", "field")
CELL = ("field", "horizon")
LEAST_ROWS = 20  # fixed value: rows a training cell needs
RESPONSES = ("absolute", "delta", "residual", "ratio")


def feature_frame(
    grid: DataFrame, lags: Sequence[int] = (1, 4), windows: Sequence[int] = (4, 8), statistics: Sequence[str] = ("mean", "std"),
    online_above: float = 1.0, stable_within: float = 2.0, step_seconds: int = 900, block: int | None = None,
) -> tuple[DataFrame, list[str]]:
    """Causal features of every slot (keys, pos, value, feat_...) and their names."""
    def compute(rows: DataFrame, w) -> DataFrame:
        return rows.withColumns(
            lag_columns("value", w, lags) | rolling_columns("value", w, windows, statistics)
            | state_flags("value", w, online_above, stable_within, max(1, step_seconds // 60)))

    # one window, one sort and one shuffle for every feature
    rows = with_halo(grid, KEYS, compute, back=max([*lags, *windows, 4]), block=block)
    raw = ["current", "diff_1", "diff_4", "accel", *[f"lag_{k}" for k in lags],
           *[f"roll_{w}_{s}" for w in windows for s in statistics], "startup", "shutdown", "ramp_up", "ramp_down", "stable"]
    out = rows.select(*grid.columns, "online", *["startup", "shutdown", "ramp_up", "ramp_down", "stable"],
                      *[F.col(c).cast("double").alias(f"feat_{c}") for c in raw])
    return out, [f"feat_{c}" for c in raw]


def with_target_clock(rows: DataFrame, step_seconds: int) -> tuple[DataFrame, list[str]]:
    """Horizon and calendar of the target slot as features."""
    parts = calendar(slot_start(F.col("pos") + F.col("horizon"), step_seconds), max(1, step_seconds // 60), "feat_target_time_")
    numeric = {n: c.cast("double") for n, c in parts.items()}
    numeric["feat_horizon_steps"] = F.col("horizon").cast("double")
    return rows.withColumns(numeric), list(numeric)


def training_set(
    features: DataFrame, horizons: Sequence[int], train_end: Column, response: str = "absolute", label: str = "value",
    base: str | None = None, window: int | None = None, half_life: float | None = None, floor_quantile: float = 0.01,
    weighted: bool = True, block: int | None = None,
) -> DataFrame:
    """(keys, pos, horizon, features..., actual, response, weight) with labels not later than ``train_end``.

    ``window`` and ``half_life`` are in slots. Weights are 1/|label| above the 1% quantile of the cell's
    labels, halved every ``half_life`` of age, with mean 1 per (target, horizon).
    """
    if response not in RESPONSES or (response == "residual" and not base):
        raise ValueError(f"unknown response {response!r} or missing baseline column")
    rows = with_trajectories(features, [], max(horizons), label, KEYS, block).withColumn(
        "horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    rows = rows.withColumn("actual", finite(_at("_future", F.col("pos") + F.col("horizon")))).drop("_future")
    rules = {
        "absolute": F.col("actual"), "delta": F.col("actual") - F.col("value"),
        "residual": F.col("actual") - F.col(base) if base else None, "ratio": safe_ratio("actual", "value") - 1}
    rows = rows.withColumn("response", finite(rules[response])).withColumn("_end", train_end)
    inside = F.col("pos") + F.col("horizon") <= F.col("_end")
    if window is not None:
        inside = inside & (F.col("pos") >= F.col("_end") - window)
    # floors, means and the set itself read these rows: stored once
    rows = cut_lineage(rows.where(inside & F.col("response").isNotNull()))
    size = F.abs("actual")
    floors = exact_quantiles(rows, list(CELL), F.when(size > 0, size), {"_floor": floor_quantile}).drop("n")
    rows = join_small(rows, floors, CELL, "left")
    floor = F.greatest(F.coalesce("_floor", F.lit(1.0)), F.lit(1e-6))
    raw = mape_weight("actual", floor, F.col("_end") - F.col("pos"), half_life) if weighted else mape_weight(
        F.lit(1.0), 1.0, F.col("_end") - F.col("pos"), half_life)
    rows = rows.withColumn("weight", raw)
    means = rows.groupBy(*CELL).agg(F.avg("weight").alias("_mean"), F.count(F.lit(1)).alias("_rows"))
    refuse = F.raise_error(F.lit("too few training rows in a target and horizon")).cast("boolean")
    out = join_small(rows, means, CELL).where(F.when(F.col("_rows") < LEAST_ROWS, refuse).otherwise(F.lit(True)))
    return out.withColumn("weight", F.col("weight") / F.col("_mean")).drop("_floor", "_mean", "_rows", "_end")


def mixing_pairs(training: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Training rows with their predecessor one slot earlier in the same operating state."""
    tagged = training.withColumn("_state", mixing_state())
    return adjacent_pairs(tagged, [*KEYS, "horizon"], "_state", carry=carry)


def mixup(
    training: DataFrame, names: Sequence[str], ratio: float, seed: int = 42, least: float = 0.70, most: float = 0.90,
) -> DataFrame:
    """Training rows plus round(n * ratio) blends of neighbouring rows per target and horizon.

    Pairs are drawn by the order of a seeded hash and the share comes from another hash, so a rerun
    or a lost executor draws the same rows. A feature that is missing on one side is taken from the other.
    """
    if not 0 < ratio <= 1 or not 0.5 <= least <= most < 1:
        raise ValueError("mixup ratio or shares out of range")
    # pairs, counts and the final union all read the training rows: stored once
    training = cut_lineage(training)
    carried = [*names, "response", "weight"]
    pairs = mixing_pairs(training, carried)
    unit = lambda salt: F.pmod(F.xxhash64(*KEYS, "pos", "horizon", F.lit(seed), F.lit(salt)), F.lit(1_000_003)) / 1_000_003.0
    drawn = pairs.withColumns({"_draw": F.xxhash64(*KEYS, "pos", "horizon", F.lit(seed)), "_share": least + (most - least) * unit("share")})
    counts = training.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.rint(F.col("_n") * ratio).cast("bigint")
    # the rank of the k-th smallest draw is an exact quantile of the hash, so no cell is gathered in one task
    sizes = drawn.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_pairs")).join(counts, list(CELL)).withColumn(
        "_take", F.least(wanted, F.col("_pairs")))
    cut = join_small(ranked_mass(drawn, list(CELL), F.col("_draw")), sizes, CELL).where(F.col("lo") < F.col("_take")).groupBy(*CELL).agg(
        F.max("value").alias("_last"))
    chosen = join_small(drawn, cut, CELL).where(F.col("_draw") <= F.col("_last"))

    def blend(c: str) -> Column:
        mine, other = F.col(c), F.col(f"prev_{c}")
        return F.coalesce(F.col("_share") * mine + (1 - F.col("_share")) * other, mine, other)

    columns = [*KEYS, "pos", "horizon", *names]
    mixed = chosen.select(*KEYS, "pos", "horizon", *[blend(c).alias(c) for c in (*names, "response", "weight")], F.lit(True).alias("augmented"))
    whole = training.select(*columns, "response", "weight", F.lit(False).alias("augmented")).unionByName(mixed)
    means = whole.groupBy(*CELL).agg(F.avg("weight").alias("_mean"))
    return join_small(whole, means, CELL).withColumn("weight", F.col("weight") / F.col("_mean")).drop("_mean")


def boosted(seed: int = 42, trees: int = 20, depth: int = 3, rate: float = 0.1, least_rows: int = 5, share: float = 0.85):
    """Boosted trees under absolute error."""
    return GBTRegressor(lossType="absolute", maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=least_rows,
                        subsamplingRate=share, seed=seed, featuresCol="vector", labelCol="response", weightCol="weight", predictionCol="_predicted")


def ridge(alpha: float = 1.0):
    return LinearRegression(regParam=alpha, elasticNetParam=0.0, solver="normal", standardization=False, featuresCol="vector",
                            labelCol="response", weightCol="weight", predictionCol="_predicted")


def forest(seed: int = 42, trees: int = 20, depth: int = 5):
    """Bagged trees; thresholds are searched, not drawn at random as in extremely randomised trees."""
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="vector", labelCol="response",
                                 weightCol="weight", predictionCol="_predicted")


def ml_stages(names: Sequence[str], learner, scaled: bool = False) -> Pipeline:
    """Median imputation, optional scaling, learner."""
    filled = [f"_{n}" for n in names]
    stages = [Imputer(inputCols=list(names), outputCols=filled, strategy="median")]
    if scaled:
        stages += [VectorAssembler(inputCols=filled, outputCol="_raw"),
                   StandardScaler(inputCol="_raw", outputCol="vector", withMean=True, withStd=True)]
    else:
        stages.append(VectorAssembler(inputCols=filled, outputCol="vector"))
    return Pipeline(stages=[*stages, learner])


CELLS = "response string, names array<string>, target string, horizon int, constant double, number int"


@dataclass
class Learned:
    """Fitted models per target (and horizon in the direct form) with constant fallbacks."""

    response: str
    names: list[str]
    models: dict[tuple[str, int | None], PipelineModel] = field(default_factory=dict)
    constants: dict[tuple[str, int | None], float] = field(default_factory=dict)

    def predict(self, rows: DataFrame, base: str | None = None, out: str = "y_pred") -> DataFrame:
        """``rows``: (keys, pos, horizon, value, features...)."""
        back = {"absolute": lambda p: p, "delta": lambda p: p + F.col("value"), "ratio": lambda p: F.col("value") * (1 + p),
                "residual": lambda p: p + F.col(base)}[self.response]
        parts = []
        for (target, horizon), fitted in {**self.constants, **self.models}.items():
            mine = rows.where(F.col("field") == target)
            if horizon is not None:
                mine = mine.where(F.col("horizon") == horizon)
            if isinstance(fitted, float):
                scored = mine.withColumn("_predicted", F.lit(fitted))
            else:
                scored = fitted.transform(mine).select(*rows.columns, "_predicted")
            parts.append(scored.withColumn(out, back(F.col("_predicted"))).drop("_predicted"))
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    def save(self, spark: SparkSession, folder: str) -> None:
        """Pipelines by number under ``models``, and a table ``cells`` with all the rest (one row per target and horizon)."""
        folder, rows = folder.rstrip("/"), []
        for (target, horizon), value in self.constants.items():
            rows.append((self.response, self.names, target, horizon, value, None))
        for number, ((target, horizon), fitted) in enumerate(self.models.items()):
            fitted.write().overwrite().save(f"{folder}/models/{number}")
            rows.append((self.response, self.names, target, horizon, None, number))
        spark.createDataFrame(rows, CELLS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Learned:
        """What ``save`` has written."""
        folder = folder.rstrip("/")
        rows = spark.read.schema(CELLS).parquet(f"{folder}/cells").collect()
        if not rows:
            raise ValueError(f"no fitted cell in {folder}")
        out = Learned(rows[0]["response"], list(rows[0]["names"]))
        for r in rows:
            key = (r["target"], r["horizon"])
            if r["number"] is None:
                out.constants[key] = r["constant"]
            else:
                out.models[key] = PipelineModel.load(f"{folder}/models/{r['number']}")
        return out


def usable_features(training: DataFrame, names: Sequence[str]) -> list[str]:
    """Features with at least one value in the training rows."""
    counts = training.agg(*[F.count(finite(n)).alias(n) for n in names]).first()
    return [n for n in names if counts[n]]


def fit(
    training: DataFrame, names: Sequence[str], learner: Callable[[], object], response: str = "absolute", direct: bool = False,
    scaled: bool = False,
) -> Learned:
    """One model per target (horizon as a feature), or per target and horizon when ``direct``.

    A cell whose response never varies gets that constant.
    """
    training = cut_lineage(training)
    names = usable_features(training, names)
    keys = list(CELL) if direct else ["field"]
    cells = training.groupBy(*keys).agg(F.min("response").alias("low"), F.max("response").alias("high")).collect()
    out = Learned(response, names)
    for cell in cells:
        key = (cell["field"], cell["horizon"] if direct else None)
        if cell["low"] == cell["high"]:
            out.constants[key] = float(cell["low"])
            continue
        mine = training.where(F.col("field") == key[0])
        if direct:
            mine = mine.where(F.col("horizon") == key[1])
        out.models[key] = ml_stages(names, learner(), scaled).fit(mine)
    return out


def metadata(training: DataFrame, learned: Learned, source: str = "training") -> DataFrame:
    """One row describing a final fit."""
    return training.agg(
        F.count(F.lit(1)).alias("training_rows"), F.min("pos").alias("first_slot"), F.max(F.col("pos") + F.col("horizon")).alias("last_label_slot"),
        F.count_distinct("field").alias("targets"), F.count_distinct("horizon").alias("horizons")).withColumns({
            "data_source": F.lit(source), "response": F.lit(learned.response), "features": F.lit(len(learned.names)),
            "models": F.lit(len(learned.models)), "constants": F.lit(len(learned.constants))})


def search(
    trials: Sequence[Mapping], features: DataFrame, names: Sequence[str], horizons: Sequence[int], folds: DataFrame, step_seconds: int,
    learner: Callable[[Mapping], object], seed: int = 42,
) -> DataFrame:
    """Tidy predictions of every trial on every fold: (trial, fold, keys, pos, horizon, y_true, y_pred).

    ``trials`` is a short table of settings (response, window, half_life, mixup, learner options);
    ``folds`` (series_id, fold, train_end, valid_start, valid_end). Each fit is a distributed job.
    """
    parts, features = None, cut_lineage(features)
    numbers = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    for trial in trials:
        for number in numbers:
            here = features.join(folds.where(F.col("fold") == number), "series_id")
            train = training_set(here, horizons, F.col("train_end"), trial.get("response", "absolute"),
                                 window=trial.get("window"), half_life=trial.get("half_life"))
            train, clock = with_target_clock(train, step_seconds)
            used = [*names, *clock]
            if trial.get("mixup"):
                train = mixup(train, used, trial["mixup"], seed)
            model = fit(train, used, lambda trial=trial: learner(trial), trial.get("response", "absolute"))
            asked = with_trajectories(here, [], max(horizons), "value").where(
                F.col("pos").between(F.col("valid_start"), F.col("valid_end"))).withColumn(
                    "horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
            asked = asked.withColumn("y_true", _at("_future", F.col("pos") + F.col("horizon")))
            asked, _ = with_target_clock(asked, step_seconds)
            done = model.predict(asked.where("value IS NOT NULL")).select(
                F.lit(trial["name"]).alias("trial"), F.lit(number).alias("fold"), *KEYS, "pos", "horizon", "y_true", "y_pred")
            parts = done if parts is None else parts.unionByName(done)
    return parts


# ---- generation from gas availability ----------------------------------------------------------
def gas_components(wide: DataFrame, production: Mapping[str, Column], consumption: Mapping[str, Column],
                   holder: Mapping[str, str], minutes: float, part: str, total: str) -> DataFrame:
    """Long intermediate series per gas: production, consumption, holder change per minute; and the loads."""
    rows = with_halo(wide, ["series_id"], lambda df, w: df.withColumns({
        f"_dh_{g}": F.coalesce((F.col(c) - F.lag(c).over(w)) / minutes, F.lit(0.0)) for g, c in holder.items()}), back=1)
    named: dict[str, Column] = {}
    for g in production:
        named[f"production__{g}"], named[f"consumption__{g}"] = production[g], consumption[g]
        named[f"holder_change__{g}"] = F.col(f"_dh_{g}") if g in holder else F.lit(0.0)
    named |= {"component_one": F.col(part), "component_extra": F.col(total) - F.col(part)}
    return rows.select("series_id", "pos", *[c.cast("double").alias(n) for n, c in named.items()])


def availability(columns: DataFrame, gases: Sequence[str]) -> list[Column]:
    """Production minus consumption minus holder change, floored at zero."""
    raw = lambda g: F.col(f"production__{g}") - F.col(f"consumption__{g}") - F.col(f"holder_change__{g}")
    return [F.when(raw(g).isNotNull(), F.greatest(raw(g), F.lit(0.0))).alias(f"available__{g}") for g in gases]


def nonnegative_fit(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Least squares with non-negative coefficients from centred moments, by enumerating support sets."""
    k, best, best_loss = len(cross), np.zeros(len(cross)), 0.0
    for size in range(1, k + 1):
        for support in combinations(range(k), size):
            idx = np.array(support)
            part, *_ = np.linalg.lstsq(gram[np.ix_(idx, idx)], cross[idx], rcond=None)
            if part.min() < 0:
                continue
            loss = part @ gram[np.ix_(idx, idx)] @ part - 2 * cross[idx] @ part
            if loss < best_loss - 1e-12 * (1 + abs(best_loss)):
                best = np.zeros(k)
                best[idx], best_loss = part, loss
    return best


def fit_load_map(components: DataFrame, gases: Sequence[str], horizons: Sequence[int], block: int | None = None) -> DataFrame:
    """(component, horizon, rows, intercept, coefficients): load h slots ahead from the load now and the
    gas available h slots ahead; coefficients not negative, rows weighted by 1/|label|.

    Rows are reduced to weighted moments per (component, horizon); the solve sees one row per cell.
    """
    names = ["component_one", "component_extra"]
    available = components.select("series_id", "pos", *names, *availability(components, gases))
    later = F.struct("pos", *names, *[f"available__{g}" for g in gases])
    near = with_halo(available, ["series_id"], lambda df, w: df.withColumn(
        "_later", F.collect_list(later).over(w.rowsBetween(1, max(horizons)))), ahead=max(horizons), block=block)
    rows = near.select("series_id", "pos", *names, F.explode("_later").alias("_l")).withColumn("horizon", (F.col("_l.pos") - F.col("pos")).cast("int"))
    rows = rows.where(F.col("horizon").isin([int(h) for h in horizons]))
    arms = F.explode(F.array(*[F.struct(F.lit(n).alias("component"), F.col(n).alias("x_0"), F.col(f"_l.{n}").alias("y")) for n in names]))
    rows = rows.select("horizon", arms.alias("_a"), *[F.col(f"_l.available__{g}").alias(f"x_{i + 1}") for i, g in enumerate(gases)]).select(
        "horizon", "_a.component", "_a.x_0", "_a.y", *[f"x_{i + 1}" for i in range(len(gases))])
    xs = [f"x_{i}" for i in range(len(gases) + 1)]
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in (*xs, "y")))
    cell = ["component", "horizon"]
    size = F.abs("y")
    floors = exact_quantiles(rows, cell, F.when(size > 0, size), {"_floor": 0.01}).drop("n")
    rows = join_small(rows, floors, cell, "left").withColumn("_w", mape_weight("y", F.greatest(F.coalesce("_floor", F.lit(1.0)), F.lit(1e-6))))
    sums = [F.count(F.lit(1)).alias("rows"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("y")).alias("sy")]
    sums += [F.sum(F.col("_w") * F.col(c)).alias(f"s_{i}") for i, c in enumerate(xs)]
    sums += [F.sum(F.col("_w") * F.col(c) * F.col("y")).alias(f"b_{i}") for i, c in enumerate(xs)]
    sums += [F.sum(F.col("_w") * F.col(a) * F.col(xs[j])).alias(f"g_{i}_{j}") for i, a in enumerate(xs) for j in range(i, len(xs))]
    moments = rows.groupBy(*cell).agg(*sums)
    k = len(xs)
    schema = T.StructType([T.StructField("component", T.StringType()), T.StructField("horizon", T.IntegerType()), T.StructField("rows", T.LongType()),
                           T.StructField("intercept", T.DoubleType()), T.StructField("coefficients", T.ArrayType(T.DoubleType()))])

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                if r["rows"] < LEAST_ROWS:
                    raise ValueError("too few rows for the load map")
                w, s = r["w"], np.array([r[f"s_{i}"] for i in range(k)])
                g = np.array([[r[f"g_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) - np.outer(s, s) / w
                b = np.array([r[f"b_{i}"] for i in range(k)]) - s * r["sy"] / w
                c = nonnegative_fit(g, b)
                out.append([r["component"], r["horizon"], r["rows"], float((r["sy"] - c @ s) / w), c.tolist()])
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return moments.mapInPandas(solve, schema)


def predict_loads(stage_one: DataFrame, now: DataFrame, load_map: DataFrame, gases: Sequence[str]) -> DataFrame:
    """(series_id, pos, horizon, part, total) from forecast gas series and the load at the origin.

    ``stage_one``: (series_id, pos, horizon, production__g, consumption__g, holder_change__g);
    ``now``: (series_id, pos, component_one, component_extra).
    """
    rows = stage_one.select("series_id", "pos", "horizon", *availability(stage_one, gases)).join(now, ["series_id", "pos"])
    arms = F.explode(F.array(*[F.struct(F.lit(n).alias("component"), F.col(n).alias("x")) for n in ("component_one", "component_extra")]))
    spread = rows.withColumn("_a", arms).select("series_id", "pos", "horizon", "_a.component", "_a.x", *[f"available__{g}" for g in gases])
    joined = spread.join(load_map.select("component", "horizon", "intercept", "coefficients"), ["component", "horizon"])
    value = F.col("intercept") + F.col("x") * F.get("coefficients", F.lit(0))
    for i, g in enumerate(gases):
        value = value + F.col(f"available__{g}") * F.get("coefficients", F.lit(i + 1))
    done = joined.withColumn("_y", F.when(value.isNotNull(), F.greatest(value, F.lit(0.0))))
    out = done.groupBy("series_id", "pos", "horizon").agg(
        F.max(F.when(F.col("component") == "component_one", F.col("_y"))).alias("part"),
        F.max(F.when(F.col("component") == "component_extra", F.col("_y"))).alias("_extra"))
    return out.withColumn("total", F.col("part") + F.col("_extra")).drop("_extra")


def component_forecast(wide: DataFrame, part: str, total: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Forecast the part and the remainder separately; the total is their sum.

    ``run`` maps a long grid to tidy (keys, pos, horizon, y_pred).
    """
    from slotwise.operators.grid import lengthen

    long = lengthen(wide.select("series_id", "pos", F.col(part).alias("part"), (F.col(total) - F.col(part)).alias("extra")), ["part", "extra"])
    tidy = run(long)
    out = tidy.groupBy("series_id", "pos", "horizon").agg(
        F.max(F.when(F.col("field") == "part", F.col("y_pred"))).alias("part"),
        F.max(F.when(F.col("field") == "extra", F.col("y_pred"))).alias("extra"))
    return out.withColumn("total", F.col("part") + F.col("extra"))
