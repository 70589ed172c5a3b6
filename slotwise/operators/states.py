"""Operating-state flags, regimes and conditions of a load series.

Three rules coexist on purpose: ``regime`` (a later flag overrides), ``condition`` (the first
flag wins, then data quality) and ``mixing_state`` (states between which rows may be mixed).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from slotwise.functions.numbers import safe_ratio
from slotwise.operators.blocks import with_halo
from slotwise.operators.features import rolling

KEYS = ("series_id", "field")
FLAGS = ("online", "startup", "shutdown", "stable", "ramp_up", "ramp_down")
# fixed values: names of the regimes, in the order in which a later one overrides
REGIMES = ("stable", "ramp_up", "ramp_down", "startup", "shutdown")
# fixed values: order in which a report condition is looked for
CONDITION_ORDER = ("startup", "shutdown", "ramp_up", "ramp_down", "stable")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def state_flags(column: str, window: WindowSpec, online_above: float, stable_within: float,
                step_minutes: int) -> dict[str, Column]:
    """A missing load counts as offline; before the first slot the unit was offline."""
    load = F.col(column)
    before = F.lag(column).over(window)
    change = load - before
    online, was_online = _yes(load > online_above), _yes(before > online_above)
    flags = {
        "online": online,
        "startup": online & ~was_online,
        "shutdown": ~online & was_online,
        "stable": online & _yes(F.abs(change) <= stable_within),
        "ramp_up": _yes(change > stable_within),
        "ramp_down": _yes(change < -stable_within),
    }
    out = {name: flag.cast("int") for name, flag in flags.items()}
    out["ramp_rate"] = change / step_minutes
    return out


def add_states(grid: DataFrame, column: str = "value", online_above: float = 1.0, stable_within: float = 2.0,
               step_minutes: int = 15, keys: Sequence[str] = KEYS, block: int | None = None) -> DataFrame:
    return with_halo(
        grid, keys,
        lambda rows, w: rows.withColumns(state_flags(column, w, online_above, stable_within, step_minutes)),
        back=1, block=block)


def regime_from_flags() -> Column:
    """Later flags override: shutdown over startup over ramp_down over ramp_up over stable."""
    label = None
    for name in reversed(REGIMES[1:]):
        hit = F.coalesce(F.col(name), F.lit(0)) > 0.5
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return label.otherwise(REGIMES[0])


def add_regime(grid: DataFrame, column: str = "value", online_above: float = 1.0, stable_within: float = 2.0,
               keys: Sequence[str] = KEYS, block: int | None = None) -> DataFrame:
    """Regime of every slot out of the load up to that slot."""
    flagged = add_states(grid, column, online_above, stable_within, 1, keys, block)
    return flagged.withColumn("regime", regime_from_flags()).drop(*FLAGS, "ramp_rate")


def condition_label(missing: Column, gap_inserted: Column, month_change: Column) -> Column:
    """First state flag that is set, then missing data, then a change of month."""
    label = None
    for name in CONDITION_ORDER:
        hit = F.coalesce(F.col(name), F.lit(0)) > 0.5
        label = F.when(hit, name) if label is None else label.when(hit, name)
    scanty = (F.coalesce(missing, F.lit(0)) > 0) | (F.coalesce(gap_inserted, F.lit(0)) > 0.5)
    return label.when(scanty, "high_missing").when(month_change == 1, "month_change").otherwise("normal")


def mixing_state() -> Column:
    """State inside which neighbouring rows may be blended; ramps need the unit to be online."""
    on = F.col("online") > 0.5
    return (
        F.when(F.col("startup") > 0.5, "startup")
        .when(F.col("shutdown") > 0.5, "shutdown")
        .when(on & (F.col("ramp_up") > 0.5), "ramp_up")
        .when(on & (F.col("ramp_down") > 0.5), "ramp_down")
        .when(on, "online")
        .otherwise("offline")
    )


def load_history(grid: DataFrame, windows: Sequence[int] = (4, 8, 16, 32, 96), column: str = "value",
                 keys: Sequence[str] = KEYS, block: int | None = None) -> DataFrame:
    """Gap and relative gap to the past mean, past slope and past volatility per window."""

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        load, added = F.col(column), {}
        for size in windows:
            past = rolling(column, w, size, ("mean", "slope", "std"))
            added[f"{size}_mean_gap"] = load - past["mean"]
            added[f"{size}_relative_mean_gap"] = safe_ratio(load, past["mean"]) - 1
            added[f"{size}_slope"] = past["slope"]
            added[f"{size}_volatility"] = past["std"]
        return rows.withColumns(added)

    return with_halo(grid, keys, compute, back=max(windows), block=block)


def component_split(wide: DataFrame, part: str, total: str) -> DataFrame:
    """Remainder of a total, the part's share, the gap and whether the total covers the part."""
    rest = F.col(total) - F.col(part)
    return wide.withColumns({
        "extra_load": rest,
        "extra_ratio": safe_ratio(part, total),
        "target_gap": rest,
        "target_consistent": F.coalesce(F.col(total) >= F.col(part), F.lit(False)).cast("int"),
    })
