"""Forecast operators as plans: origins x horizons from history only, no loop over origins.

Everything a forecast needs of the past of a slot is put on the slot once:
* statistics of the last w *valid* readings, carried forward over empty slots;
* the past seasons and the coming labels as short arrays cut out by row frames.
Then horizons are exploded and each model is one column expression.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from slotwise.operators.blocks import carry_last, running_total, with_halo

KEYS = ("series_id", "field")

# fixed values: names of the baseline types a forecast spec may use
MODEL_TYPES = (
    "last_value", "window_mean", "window_median", "linear_trend", "damped_trend", "seasonal_naive",
    "seasonal_median", "weighted_ensemble",
)


@dataclass(frozen=True)
class Model:
    """One forecast operator: a type, its parameters and, for an ensemble, its weighted members."""

    name: str
    type: str
    window: int = 8
    damping: float = 0.85
    period: int = 96
    seasons: int = 3
    members: tuple[tuple[Model, float], ...] = field(default_factory=tuple)
    clip_min: float | None = None

    def leaves(self) -> list[Model]:
        return [leaf for m, _ in self.members for leaf in m.leaves()] if self.members else [self]


def model(spec: Mapping) -> Model:
    """Forecast operator from a plain spec; nested members make an ensemble."""
    kind = spec["type"]
    if kind not in MODEL_TYPES:
        raise ValueError(f"unknown model type {kind!r}")
    options = {k: v for k, v in spec.items() if k not in ("name", "type", "members", "period_steps")}
    if "period_steps" in spec:
        options["period"] = spec["period_steps"]
    members = tuple((model(m), float(m.get("weight", 1.0))) for m in spec.get("members", ()))
    options.pop("weight", None)
    out = Model(name=spec.get("name", kind), type=kind, members=members, **options)
    if kind in ("linear_trend", "damped_trend") and out.window < 2:
        raise ValueError("a trend needs a window of at least 2")
    if out.window <= 0 or out.period <= 0 or out.seasons <= 0 or not 0 <= out.damping <= 1:
        raise ValueError(f"parameters of {out.name} are out of range")
    if kind == "weighted_ensemble" and (
            not members or min(w for _, w in members) < 0 or sum(w for _, w in members) <= 0):
        raise ValueError("ensemble weights must not be negative and must not all be zero")
    return out


def _statistics(leaves: Sequence[Model]) -> dict[str, tuple[str, int]]:
    kinds = {"window_mean": "mean", "window_median": "median", "linear_trend": "trend", "damped_trend": "trend"}
    return {f"{kinds[m.type]}_{m.window}": (kinds[m.type], m.window) for m in leaves if m.type in kinds}


def history_state(grid: DataFrame, leaves: Sequence[Model], keys: Sequence[str] = KEYS, block: int | None = None) -> DataFrame:
    """Adds ``_state`` to every slot: last reading and window statistics of the last w readings."""
    wanted = _statistics(leaves)
    if not wanted:
        last = F.when(F.col("value").isNotNull(), F.struct(F.col("value").alias("last")))
        return carry_last(grid, keys, last, "_state_now", block=block)
    readings = grid.where(F.col("value").isNotNull())
    numbered = running_total(readings, keys, F.lit(1).cast("bigint"), "_k", block=block)

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        added: dict[str, Column] = {}
        for name, (kind, size) in wanted.items():
            frame = w.rowsBetween(-(size - 1), 0)
            if kind == "mean":
                added[name] = F.avg("value").over(frame)
            elif kind == "median":
                added[name] = F.expr("percentile(value, 0.5D)").over(frame)
            else:
                slope = F.expr("regr_slope(value, _k)").over(frame)
                added[name] = F.struct(
                    F.avg("value").over(frame).alias("level"), F.avg("_k").over(frame).alias("centre"),
                    slope.alias("slope"), F.col("_k").alias("k"))
        return rows.withColumns(added) if added else rows

    reach = max([size for _, size in wanted.values()], default=1)
    valued = with_halo(numbered, keys, compute, back=reach, order="_k", block=block)
    packed = F.struct(F.col("value").alias("last"), *[F.col(n) for n in wanted])
    known = valued.select(*grid.columns, packed.alias("_state"))
    empty = grid.where(F.col("value").isNull()).withColumn("_state", F.lit(None).cast(known.schema["_state"].dataType))
    return carry_last(known.unionByName(empty), keys, F.col("_state"), "_state_now", block=block).drop("_state")


def _frames(leaves: Sequence[Model]) -> dict[int, int]:
    """Back-distances k*period whose trajectories are needed."""
    shifts: dict[int, int] = {}
    for m in leaves:
        if m.type in ("seasonal_naive", "seasonal_median"):
            for k in range(1, (m.seasons if m.type == "seasonal_median" else 1) + 1):
                shifts[k * m.period] = 1
    return shifts


def with_trajectories(rows: DataFrame, shifts: Sequence[int], max_horizon: int, label: str | None = "label",
                      keys: Sequence[str] = KEYS, block: int | None = None) -> DataFrame:
    """Arrays of (pos, value): one per season distance, and the labels after the slot."""

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        cut = lambda column, a, b: F.collect_list(F.struct("pos", F.col(column).alias("v"))).over(w.rowsBetween(a, b))
        added = {f"_s{d}": cut("value", -(d - 1), min(0, max_horizon - d)) for d in shifts}
        if label:
            added["_future"] = cut(label, 1, max_horizon)
        return df.withColumns(added) if added else df

    return with_halo(rows, keys, compute, back=max(shifts, default=0), ahead=max_horizon if label else 0, block=block)


def _at(array: str, wanted: Column) -> Column:
    first = F.get(F.col(array), F.lit(0))["pos"]
    return F.when(wanted >= first, F.get(F.col(array), (wanted - first).cast("int"))["v"])


def _expression(m: Model, h: Column) -> Column:
    state = lambda name: F.col("_state_now")[name]
    last = state("last")
    if m.type == "last_value":
        return last
    if m.type in ("window_mean", "window_median"):
        return state(f"{m.type.split('_')[1]}_{m.window}")
    if m.type in ("linear_trend", "damped_trend"):
        fit = state(f"trend_{m.window}")
        if m.type == "linear_trend":
            ahead = fit["level"] + fit["slope"] * (fit["k"] + h - fit["centre"])
        else:
            damp = m.damping
            grown = h if damp == 1.0 else (1 - F.pow(F.lit(damp), h)) / (1 - damp)
            ahead = last + fit["slope"] * grown
        return F.coalesce(ahead, last)  # a single reading has no slope
    if m.type == "seasonal_naive":
        return F.coalesce(_at(f"_s{m.period}", F.col("pos") + h - m.period), last)
    if m.type == "seasonal_median":
        seen = F.array_compact(F.array(*[
            _at(f"_s{k * m.period}", F.col("pos") + h - k * m.period) for k in range(1, m.seasons + 1)]))
        ordered = F.array_sort(seen)
        size = F.size(seen)
        low = F.get(ordered, F.floor((size - 1) / 2).cast("int"))
        high = F.get(ordered, F.floor(size / 2).cast("int"))
        return F.when(size > 0, (low + high) / 2).otherwise(last)
    total = sum(w for _, w in m.members)
    parts = [_expression(part, h) * (w / total) for part, w in m.members]
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out if m.clip_min is None else F.when(out.isNotNull(), F.greatest(out, F.lit(float(m.clip_min))))


def forecast(
    grid: DataFrame, models: Sequence[Model], horizons: Sequence[int], origins: DataFrame | None = None,
    label: str | None = None, carry: Sequence[str] = (), keys: Sequence[str] = KEYS, block: int | None = None,
) -> DataFrame:
    """Wide tidy table (keys, pos, horizon, target_pos, [y_true], one column per model).

    ``origins`` (series_id, pos [, fold...]) restricts the origins; ``label`` names the column that
    the truth is taken from; ``carry`` columns of the origin row are kept. Origins without any
    reading before them are dropped.
    """
    if not horizons or min(horizons) <= 0:
        raise ValueError("horizons must be positive")
    leaves = list({leaf.name + str(leaf): leaf for m in models for leaf in m.leaves()}.values())
    states = history_state(grid, leaves, keys, block)
    shifts, far = sorted(_frames(leaves)), max(horizons)
    rows = with_trajectories(states, shifts, far, label, keys, block) if shifts or label else states
    extra: list[str] = []
    if origins is not None:
        extra = [c for c in origins.columns if c not in rows.columns]
        on = [c for c in origins.columns if c in (*keys, "pos")]
        rows = rows.join(origins, on)
    rows = rows.where(F.col("_state_now").isNotNull()).withColumn(
        "horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    h = F.col("horizon")
    truth = [_at("_future", F.col("pos") + h).alias("y_true")] if label else []
    return rows.select(
        *keys, *extra, *carry, "pos", "horizon", (F.col("pos") + h).alias("target_pos"), *truth,
        *[_expression(m, h).alias(m.name) for m in models])


def melt(wide: DataFrame, names: Sequence[str], column: str = "model", value: str = "y_pred") -> DataFrame:
    """One row per model: long tidy predictions."""
    fixed = [c for c in wide.columns if c not in names]
    return wide.unpivot(fixed, list(names), column, value)


def pivot_forecast(tidy: DataFrame, targets: Sequence[str], horizons: Sequence[int], step_minutes: int = 15,
                   prediction: str = "y_pred", keys: Sequence[str] = ("series_id", "pos")) -> DataFrame:
    """Wide sink layout: target-major ``<target>_t+<minutes>_pred`` columns."""
    from slotwise.functions.names import forecast_column

    cells = [
        F.max(F.when((F.col("field") == t) & (F.col("horizon") == h), F.col(prediction))).alias(
            forecast_column(t, h, step_minutes))
        for t in targets for h in horizons]
    return tidy.groupBy(*keys).agg(*cells)


def unpivot_forecast(wide: DataFrame, step_minutes: int = 15, keys: Sequence[str] = ("series_id", "pos")) -> DataFrame:
    from slotwise.functions.names import horizon_of, target_of

    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("y_pred")) for c in wide.columns if c not in keys])
    long = wide.select(*keys, F.explode(cells).alias("_cell"))
    name = F.col("_cell.column")
    return long.select(*keys, target_of(name).alias("field"), horizon_of(name, step_minutes).alias("horizon"),
                       F.col("_cell.y_pred").alias("y_pred"))


def weighted_blend(long: DataFrame, weights: DataFrame, keys: Sequence[str], by: Sequence[str] = (),
                   signed: bool = False) -> DataFrame:
    """sum(w*p)/sum(w) over candidates with weights looked up by ``by`` + candidate.

    Plain weights must not be negative; ``signed`` weights (an affine blend that may extrapolate)
    must add up to one and the result is floored at zero.
    """
    joined = long.join(weights, [*by, "model"])
    if not signed:
        refuse = F.raise_error(F.lit("blend weights must not be negative")).cast("boolean")
        joined = joined.where(F.when(F.col("weight") < 0, refuse).otherwise(F.lit(True)))
    total, mixed = F.sum("weight"), F.sum(F.col("weight") * F.col("y_pred"))
    whole = F.count("y_pred") == F.count(F.lit(1))
    out = joined.groupBy(*keys).agg(total.alias("_w"), F.when(whole, mixed).alias("_p"))
    if signed:
        refuse = F.raise_error(F.lit("affine weights must add up to one")).cast("double")
        value = F.when(F.abs(F.col("_w") - 1) > 1e-9, refuse).otherwise(F.greatest(F.col("_p"), F.lit(0.0)))
    else:
        value = F.when(F.col("_w") > 0, F.col("_p") / F.col("_w"))
    return out.select(*keys, value.alias("y_pred"))
