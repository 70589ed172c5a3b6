"""Causal features on the long grid: lags, differences, shifted rolling statistics, EWMA.

A rolling frame always ends at the previous slot, so the current value is never inside.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.operators.blocks import DEFAULT_BLOCK, block_of, carry_last, running_total, with_halo
from slotwise.operators.order_windows import RankIndex, by_block, frame

KEYS = ("series_id", "field")
STATISTICS = ("mean", "std", "min", "max", "slope", "q10", "q90")
#: Statistics that need the order of the frame's values.
SHARES = {"q10": 0.1, "median": 0.5, "q90": 0.9}


def least_count(window: int) -> int:
    """Readings a window needs before it yields a value."""
    return max(2, window // 2)


def slope_of(column: str, window: WindowSpec, order: str = "pos") -> Column:
    """Least-squares slope per slot over the frame, nulls skipped."""
    return F.expr(f"regr_slope({column}, {order})").over(window)


def rolling(column: str, window: WindowSpec, size: int, statistics: Sequence[str], order: str = "pos") -> dict[str, Column]:
    """Statistics over the ``size`` slots before the current one, null below the least count.

    Quantiles re-sort every frame here, which only suits short frames; ``sliding_quantiles`` doesn't.
    """
    frame = window.rowsBetween(-size, -1)
    value = F.col(column)
    rules = {
        "mean": lambda: F.avg(value).over(frame),
        "std": lambda: F.stddev_pop(value).over(frame),
        "min": lambda: F.min(value).over(frame),
        "max": lambda: F.max(value).over(frame),
        "slope": lambda: slope_of(column, frame, order),
        **{s: lambda share=share: F.expr(f"percentile({column}, {share}D)").over(frame) for s, share in SHARES.items()},
    }
    enough = F.count(value).over(frame) >= least_count(size)
    return {name: F.when(enough, rules[name]()) for name in statistics}


def lag_columns(column: str, window: WindowSpec, lags: Sequence[int], differences: bool = True) -> dict[str, Column]:
    """lag_<k> and, with ``differences``, current, diff_1, diff_4 and accel."""
    back = lambda k: F.lag(column, k).over(window)
    out = {f"lag_{k}": back(k) for k in lags}
    if differences:
        now = F.col(column)
        out |= {"current": now, "diff_1": now - back(1), "diff_4": now - back(4), "accel": now - 2 * back(1) + back(2)}
    return out


def rolling_columns(column: str, window: WindowSpec, windows: Sequence[int], statistics: Sequence[str]) -> dict[str, Column]:
    """roll_<window>_<statistic> for every window and statistic."""
    return {
        f"roll_{size}_{name}": c for size in windows for name, c in rolling(column, window, size, statistics).items()}


def lag_features(
    grid: DataFrame, lags: Sequence[int] = (), column: str = "value", keys: Sequence[str] = KEYS,
    differences: bool = True, block: int | None = None,
) -> DataFrame:
    return with_halo(
        grid, keys, lambda rows, w: rows.withColumns(lag_columns(column, w, lags, differences)),
        back=max([*lags, 4]), block=block)


def rolling_features(
    grid: DataFrame, windows: Sequence[int], statistics: Sequence[str] = STATISTICS, column: str = "value",
    keys: Sequence[str] = KEYS, block: int | None = None,
) -> DataFrame:
    """Adds roll_<window>_<statistic>.

    Moments and extremes share one window specification and so one sort. Quantiles of all windows come from one rank index per
    block, whatever the windows' sizes.
    """
    unknown = set(statistics) - {*STATISTICS, "median"}
    if unknown:
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    moments, ranked = [s for s in statistics if s not in SHARES], [s for s in statistics if s in SHARES]
    out = with_halo(
        grid, keys, lambda rows, w: rows.withColumns(rolling_columns(column, w, windows, moments)),
        back=max(windows), block=block) if moments else grid
    if ranked:
        out = sliding_quantiles(out, {f"roll_{size}_{s}": (size, SHARES[s]) for size in windows for s in ranked}, column, keys, block)
    return out.select(*grid.columns, *[f"roll_{size}_{s}" for size in windows for s in statistics])


def sliding_quantiles(
    grid: DataFrame, wanted: dict[str, tuple[int, float]], column: str = "value", keys: Sequence[str] = KEYS, block: int | None = None,
) -> DataFrame:
    """Adds a column per name: the quantile (size, share) of the ``size`` slots before the current one, null below the least count."""

    def work(columns, n):
        index, made = RankIndex(columns[column]), {}
        for name, (size, share) in wanted.items():
            past = frame(n, size)
            made[name] = np.where(index.count(*past) >= least_count(size), index.percentile(*past, share), np.nan)
        return made

    return by_block(
        grid, keys, work, [column], [(name, T.DoubleType()) for name in wanted], max(size for size, _ in wanted.values()), block=block)


def ewma(
    grid: DataFrame, span: int = 8, column: str = "value", out: str = "ewma", least: int = 2,
    keys: Sequence[str] = KEYS, block: int | None = None,
) -> DataFrame:
    """Exponentially weighted mean without adjustment; empty slots age the weight and repeat the mean.

    A reading after g slots maps the mean m to a m + c with a = o / (o + alpha), o = (1 - alpha) ** g. Such maps compose, so
    each block of slots gives the map from its first reading to every later one, the short block table (one row per
    block and series) is run through in order, and every row applies its map to the mean its block starts with. Exact for
    every span and gap; a block never looks back.
    """
    alpha = 2.0 / (span + 1.0)
    size = block or DEFAULT_BLOCK
    narrow = grid.where(F.col(column).isNotNull()).select(
        *keys, block_of("pos", size).alias("_blk"), "pos", F.col(column).cast("double").alias("_x"))
    real = T.DoubleType()
    schema = T.StructType([*narrow.schema.fields, T.StructField("_a", real), T.StructField("_c", real)])

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        old = (1.0 - alpha) ** pdf["pos"].diff().to_numpy(dtype=float, na_value=np.nan)
        slopes, a, c = (old / (old + alpha)).tolist(), 1.0, 0.0
        rows = []
        for slope, x in zip(slopes, pdf["_x"].tolist()):
            if rows:
                a, c = slope * a, slope * c + (1.0 - slope) * x
            rows.append((a, c))
        pdf["_a"], pdf["_c"] = [r[0] for r in rows], [r[1] for r in rows]
        return pdf

    mapped = narrow.groupBy(*keys, "_blk").applyInPandas(maps, schema)
    ends = mapped.groupBy(*keys, "_blk").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.min_by("_x", "pos").alias("x"),
        F.max_by("_a", "pos").alias("a"), F.max_by("_c", "pos").alias("c"))
    start = T.StructType([*[mapped.schema[k] for k in (*keys, "_blk")], T.StructField("_m", real)])

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        means, mean, before = [], None, 0
        for first, last, x, a, c in zip(*[pdf[n].tolist() for n in ("first", "last", "x", "a", "c")]):
            if mean is None:
                mean = x
            else:
                old = (1.0 - alpha) ** (first - before)
                mean = (old * mean + alpha * x) / (old + alpha)
            means.append(mean)
            mean, before = a * mean + c, last
        pdf["_m"] = means
        return pdf[[*keys, "_blk", "_m"]]

    opening = ends.groupBy(*keys).applyInPandas(through, start)
    known = mapped.join(opening, [*keys, "_blk"]).select(*keys, "pos", (F.col("_a") * F.col("_m") + F.col("_c")).alias("_mean"))
    rows = grid.join(known, [*keys, "pos"], "left")
    seen = running_total(rows, keys, F.col(column).isNotNull().cast("int"), "_seen_readings", block=size)
    carried = carry_last(seen, keys, F.col("_mean"), "_carried", block=size)
    return carried.select(*grid.columns, F.when(F.col("_seen_readings") >= least, F.col("_carried")).alias(out))


def season_deltas(
    grid: DataFrame, periods: dict[str, int], column: str = "value", keys: Sequence[str] = KEYS,
    block: int | None = None,
) -> DataFrame:
    """Difference to the same slot one period back, e.g. {'day': 96, 'week': 672}."""
    return with_halo(
        grid, keys,
        lambda rows, w: rows.withColumns(
            {f"same_slot_{name}_delta": F.col(column) - F.lag(column, k).over(w) for name, k in periods.items()}),
        back=max(periods.values()), block=block)


def adjacent_pairs(rows: DataFrame, keys: Sequence[str], state: str, order: str = "pos",
                   carry: Sequence[str] = (), block: int | None = None) -> DataFrame:
    """Rows whose predecessor lies exactly one slot earlier in the same state; predecessor as ``prev_*``."""
    names = [order, state, *carry]

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        return df.withColumns({f"prev_{n}": F.lag(n).over(w) for n in names})

    paired = with_halo(rows, keys, compute, back=1, order=order, block=block)
    return paired.where(
        (F.col(order) - F.col(f"prev_{order}") == 1) & (F.col(state) == F.col(f"prev_{state}")))


def flag_features(cleaned: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("series_id", "pos")) -> DataFrame:
    """Missing flag, missing run, outlier flag and robust value of every field as wide features."""
    parts = {"feat_missing__": "missing", "feat_missing_run__": "missing_run", "feat_outlier__": "outlier", "feat_robust__": "robust"}
    return cleaned.groupBy(*keys).agg(*[
        F.max(F.when(F.col("field") == f, F.col(source))).alias(prefix + f) for f in fields for prefix, source in parts.items()])
