"""Gas balances, holder movements, available gas and use per load, on the wide grid.

Every feature is shifted by one slot: the newest figure inside it belongs to the slot before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from slotwise.functions.numbers import at_least, row_sum, safe_ratio
from slotwise.operators.blocks import with_halo
from slotwise.operators.features import rolling

Sources = Mapping[str, Sequence[str]]
TREND_WINDOWS = (4, 8, 16, 32)


@dataclass(frozen=True)
class Roles:
    """Which fields play which role, per gas type."""

    production: Sources = field(default_factory=dict)
    user_demand: Sources = field(default_factory=dict)
    process_demand: Sources = field(default_factory=dict)
    generator_use: Sources = field(default_factory=dict)
    holder: Mapping[str, str] = field(default_factory=dict)
    targets: Sequence[str] = ()

    def columns(self) -> list[str]:
        groups = (self.production, self.user_demand, self.process_demand, self.generator_use)
        names = [c for g in groups for cols in g.values() for c in cols]
        return list(dict.fromkeys([*names, *self.holder.values(), *self.targets]))


def role_table(spark: SparkSession, roles: Roles) -> DataFrame:
    rows = [
        (role, gas, name)
        for role, sources in (("production", roles.production), ("user_demand", roles.user_demand),
                              ("process_demand", roles.process_demand), ("generator_use", roles.generator_use))
        for gas, names in sources.items() for name in names
    ]
    return spark.createDataFrame(rows, "role string, gas_type string, field string")


def role_sums(long: DataFrame, roles: DataFrame) -> DataFrame:
    """(series_id, pos, role, gas_type, value): null only where every member is null."""
    return long.join(roles, "field").groupBy("series_id", "pos", "role", "gas_type").agg(F.sum("value").alias("value"))


def _present(columns: Sequence[str], wide: DataFrame) -> list[str]:
    return [c for c in columns if c in wide.columns]


def _total(sources: Sequence[str], wide: DataFrame) -> Column | None:
    names = _present(sources, wide)
    return row_sum(names) if names else None


def _flat(sources: Sources) -> list[str]:
    return [c for names in sources.values() for c in names]


def role_columns(wide: DataFrame, roles: Roles) -> dict[str, Column]:
    """Named row sums: prod_<gas>, demand_<gas> (user plus process, null if either is null) ..."""
    out: dict[str, Column] = {}
    for gas in sorted(set(roles.production) & set(roles.user_demand)):
        produced = _total(roles.production[gas], wide)
        parts = [p for p in (_total(roles.user_demand[gas], wide),
                             _total(roles.process_demand.get(gas, ()), wide)) if p is not None]
        if produced is None or not parts:
            continue
        out[f"_prod_{gas}"] = produced
        out[f"_demand_{gas}"] = parts[0] if len(parts) == 1 else parts[0] + parts[1]
    for gas, names in roles.generator_use.items():
        used = _total(names, wide)
        if used is not None:
            out[f"_use_{gas}"] = used
    for name, sources in (("production", roles.production), ("demand", roles.user_demand),
                          ("process_demand", roles.process_demand), ("use", roles.generator_use)):
        total = _total(_flat(sources), wide)
        if total is not None:
            out[f"_total_{name}"] = total
    return out


def gas_features(
    wide: DataFrame, roles: Roles, step_minutes: int = 15, momentum: Sequence[int] = (4, 8, 16),
    capacity: float | None = None, safe_range: tuple[float, float] = (0.15, 0.90),
    windows: Sequence[int] = TREND_WINDOWS, block: int | None = None,
) -> DataFrame:
    """Balance, holder, availability and plant-total features beside the wide columns."""
    low, high = safe_range
    if capacity is not None and (capacity <= 0 or not 0 <= low < high <= 1):
        raise ValueError("holder capacity and its safe range are not valid")
    sums = role_columns(wide, roles)
    gases = [n[len("_prod_"):] for n in sums if n.startswith("_prod_")]
    holders = {g: c for g, c in roles.holder.items() if c in wide.columns}

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        back = lambda c, k=1: F.lag(c, k).over(w)
        rows = rows.withColumns(sums)
        rows = rows.withColumns({f"_bal_{g}": F.col(f"_prod_{g}") - F.col(f"_demand_{g}") for g in gases})
        rows = rows.withColumns({f"_dh_{g}": F.col(c) - back(c) for g, c in holders.items()})
        rows = rows.withColumns({
            f"_avail_{g}": F.col(f"_bal_{g}") - F.col(f"_dh_{g}") if g in holders else F.col(f"_bal_{g}")
            for g in gases})
        if gases:
            everything = F.col(f"_avail_{gases[0]}")
            for g in gases[1:]:
                everything = everything + F.col(f"_avail_{g}")
            rows = rows.withColumn("_avail", everything)
        out: dict[str, Column] = {}
        for g in gases:
            balance = back(f"_bal_{g}")
            out[f"feat_gas_balance_{g}"] = balance
            out[f"feat_gas_production_{g}"] = back(f"_prod_{g}")
            out[f"feat_gas_priority_demand_{g}"] = back(f"_demand_{g}")
            out[f"feat_gas_supply_gap_{g}"] = at_least(-balance, 0.0)
            out[f"feat_gas_production_demand_ratio_{g}"] = safe_ratio(back(f"_prod_{g}"), back(f"_demand_{g}"))
            out[f"feat_gas_available_{g}"] = back(f"_avail_{g}")
            out |= _trend(f"_bal_{g}", f"feat_gas_balance_{g}", w, windows)
            if f"_use_{g}" in sums:
                out[f"feat_generator_use_ratio_{g}"] = safe_ratio(back(f"_use_{g}"), back(f"_prod_{g}"))
        for g, c in holders.items():
            out |= _holder(g, c, back, step_minutes, momentum, capacity, low, high)
        totals = {n[len("_total_"):] for n in sums if n.startswith("_total_")}
        out |= {f"feat_gas_total_{n}": back(f"_total_{n}") for n in totals}
        if {"production", "demand"} <= totals:
            net = back("_total_production") - back("_total_demand")
            out["feat_gas_total_balance"] = net - back("_total_process_demand") if "process_demand" in totals else net
        if {"production", "use"} <= totals:
            out["feat_gas_use_to_production_ratio"] = safe_ratio(back("_total_use"), back("_total_production"))
        if gases:
            out["feat_gas_total_available"] = back("_avail")
            out["feat_gas_total_supply_gap"] = at_least(-back("_avail"), 0.0)
            out |= _trend("_avail", "feat_gas_total_available", w, windows)
        return rows.withColumns(out)

    reach = max([*windows, *[k + 1 for k in momentum], 3]) + 1
    computed = with_halo(wide, ["series_id"], compute, back=reach, block=block)
    return computed.drop(*[c for c in computed.columns if c.startswith(("_prod_", "_demand_", "_use_", "_total_",
                                                                        "_bal_", "_dh_", "_avail"))])


def _trend(column: str, prefix: str, w: WindowSpec, windows: Sequence[int]) -> dict[str, Column]:
    return {
        f"{prefix}_{size}_{name}": c
        for size in windows for name, c in rolling(column, w, size, ("mean", "std", "slope")).items()
    }


def _holder(gas, column, back, step_minutes, momentum, capacity, low, high) -> dict[str, Column]:
    level, change = back(column), back(column) - back(column, 2)
    out = {
        f"feat_holder_change_rate_{gas}": change / step_minutes,
        f"feat_holder_change_acceleration_{gas}":
            (back(column) - 2 * back(column, 2) + back(column, 3)) / step_minutes**2,
        f"feat_holder_level_{gas}": level,
        f"feat_holder_fill_{gas}": at_least(change, 0.0),
        f"feat_holder_release_{gas}": at_least(-change, 0.0),
    }
    for k in sorted({k for k in momentum if k > 1}):
        out[f"feat_holder_change_rate_{gas}_{k}"] = (back(column) - back(column, k + 1)) / (k * step_minutes)
    if capacity is not None:
        share = level / capacity
        out |= {
            f"feat_holder_level_fraction_{gas}": share,
            f"feat_holder_low_margin_{gas}": share - low,
            f"feat_holder_high_margin_{gas}": high - share,
            f"feat_holder_safe_margin_{gas}": F.least(share - low, high - share),
            f"feat_holder_projected_fraction_{gas}": (level + change) / capacity,
        }
    return out


def use_per_load(
    wide: DataFrame, roles: Roles, windows: Sequence[int] = (4, 8, 16), minimum_load: float = 1.0,
    block: int | None = None,
) -> DataFrame:
    """Last slot's gas use per unit of current load, its gap to the past median and its past slope."""
    if minimum_load <= 0:
        raise ValueError("the least load must be positive")
    sizes = sorted({w for w in windows if w >= 2})
    pairs = [(g, t) for g, names in roles.generator_use.items() if _present(names, wide)
             for t in roles.targets if t in wide.columns]

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumns({f"_use_{g}": _total(roles.generator_use[g], wide) for g, _ in pairs})
        ratio = lambda g, t: f"feat_gas_load_{g}_use_per_mw_{t}"
        rows = rows.withColumns({
            ratio(g, t): F.lag(f"_use_{g}").over(w) / F.when(F.abs(F.col(t)) >= minimum_load, F.col(t))
            for g, t in pairs})
        out: dict[str, Column] = {}
        for g, t in pairs:
            for size in sizes:
                past = rolling(ratio(g, t), w, size, ("median", "slope"))
                out[f"{ratio(g, t)}_{size}_relative_gap"] = safe_ratio(F.col(ratio(g, t)), past["median"]) - 1
                out[f"{ratio(g, t)}_{size}_slope"] = past["slope"]
        return rows.withColumns(out).drop(*{f"_use_{g}" for g, _ in pairs})

    return with_halo(wide, ["series_id"], compute, back=max(sizes) + 1, block=block)
