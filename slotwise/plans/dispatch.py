"""Dispatch data products: resource forecasts, input contract, plan audit, plan figures.

Plans are long tables, so any number of plants and plans is audited in one job.
Gas rows: (plan_id, pos, gas_type, production, demand, use, storage, flare, shortage).
Unit rows: (plan_id, pos, unit, load, on, start).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.clock import tariff
from slotwise.functions.numbers import at_least, finite
from slotwise.functions.slots import slot_start
from slotwise.operators.balance import Roles, role_columns
from slotwise.operators.blocks import asof_last, with_halo
from slotwise.operators.grid import lengthen
from slotwise.plans.forecast import Model, forecast


@dataclass(frozen=True)
class Unit:
    name: str
    rated: float
    group: str = ""
    least_share: float = 0.60
    initial_on: float = 0.0
    initial_load: float = 0.0


def _lookup(key: str, values: Mapping[str, float]) -> Column:
    return F.coalesce(*[F.when(F.col(key) == k, F.lit(float(v))) for k, v in values.items()])


def material_residual(gas: DataFrame, initial: Mapping[str, float], block: int | None = None) -> DataFrame:
    """Storage now minus storage before plus use, flare and minus shortage, against production minus demand."""
    lagged = with_halo(gas, ["plan_id", "gas_type"], lambda rows, w: rows.withColumn("_before", F.lag("storage").over(w)),
                       back=1, block=block)
    before = F.coalesce("_before", _lookup("gas_type", initial))
    residual = F.col("storage") - before + F.col("use") + F.col("flare") - F.col("shortage") - F.col("production") + F.col("demand")
    return lagged.select("plan_id", "pos", F.lit("material_balance").alias("rule"), F.abs(residual).alias("violation"))


def conversion_residual(gas: DataFrame, units: DataFrame, conversion: Mapping[str, float]) -> DataFrame:
    """Total load against converted gas use."""
    made = gas.groupBy("plan_id", "pos").agg(F.sum(F.col("use") * _lookup("gas_type", conversion)).alias("_made"))
    load = units.groupBy("plan_id", "pos").agg(F.sum("load").alias("_load"))
    return load.join(made, ["plan_id", "pos"]).select(
        "plan_id", "pos", F.lit("generation_conversion").alias("rule"), F.abs(F.col("_load") - F.col("_made")).alias("violation"))


def unit_residuals(units: DataFrame, fleet: Sequence[Unit], ramp_share: float = 0.01, step_minutes: int = 15,
                   block: int | None = None) -> DataFrame:
    """Load against on-state, start logic, ramps and integrality of every unit and period."""
    of = lambda attribute: _lookup("unit", {u.name: getattr(u, attribute) for u in fleet})
    rows = with_halo(
        units, ["plan_id", "unit"],
        lambda df, w: df.withColumns({"_load": F.lag("load").over(w), "_on": F.lag("on").over(w)}), back=1, block=block)
    rated = of("rated")
    load_before, on_before = F.coalesce("_load", of("initial_load")), F.coalesce("_on", of("initial_on"))
    ramp = rated * ramp_share * step_minutes
    uneven = lambda c: F.abs(F.col(c) - F.rint(c))
    rules = {
        "load_above_rated": F.col("load") - rated * F.col("on"),
        "load_below_least": rated * of("least_share") * F.col("on") - F.col("load"),
        "start_while_off": F.col("start") - F.col("on"),
        "unmarked_start": F.col("on") - on_before - F.col("start"),
        "ramp_up": F.col("load") - load_before - ramp,
        "ramp_down": load_before - F.col("load") - ramp,
        "not_integer": F.greatest(uneven("on"), uneven("start")),
        "unit_bounds": F.greatest(-F.col("load"), -F.col("on"), F.col("on") - 1, -F.col("start"), F.col("start") - 1),
    }
    listed = F.array(*[F.struct(F.lit(n).alias("rule"), F.greatest(c, F.lit(0.0)).alias("violation")) for n, c in rules.items()])
    return rows.withColumn("_r", F.explode(listed)).select("plan_id", "pos", "_r.rule", "_r.violation")


def gas_bounds(gas: DataFrame, capacity: Mapping[str, float], low: float = 0.15, high: float = 0.90) -> DataFrame:
    size = _lookup("gas_type", capacity)
    over = F.greatest(size * low - F.col("storage"), F.col("storage") - size * high,
                      -F.col("use"), -F.col("flare"), -F.col("shortage"), F.lit(0.0))
    return gas.select("plan_id", "pos", F.lit("gas_bounds").alias("rule"), over.alias("violation"))


def audit_plan(
    gas: DataFrame, units: DataFrame, fleet: Sequence[Unit], initial: Mapping[str, float], conversion: Mapping[str, float],
    capacity: Mapping[str, float], tolerance: float = 1e-5, **settings,
) -> DataFrame:
    """(plan_id, rule, violation, broken): the largest violation of every rule."""
    parts = (
        material_residual(gas, initial)
        .unionByName(conversion_residual(gas, units, conversion))
        .unionByName(unit_residuals(units, fleet, **settings))
        .unionByName(gas_bounds(gas, capacity)))
    return parts.groupBy("plan_id", "rule").agg(
        F.max("violation").alias("violation"), F.count_if(F.col("violation") > tolerance).alias("broken"))


def largest_violation(audit: DataFrame) -> DataFrame:
    return audit.groupBy("plan_id").agg(F.max("violation").alias("max_violation"))


def plan_figures(
    gas: DataFrame, units: DataFrame, price: DataFrame, hours: float = 0.25, flare_penalty: float = 0.0,
    revenue_scale: float = 1.0,
) -> DataFrame:
    """Shortage, flare, energy, price-weighted load, benefit and its gain over the baseline per plan.

    ``price``: (plan_id, pos, price, baseline_generation, baseline_flare).
    """
    gas_totals = gas.groupBy("plan_id", "pos").agg(F.sum("shortage").alias("shortage"), F.sum("flare").alias("flare"))
    power = units.groupBy("plan_id", "pos").agg(F.sum("load").alias("generation"))
    periods = gas_totals.join(power, ["plan_id", "pos"]).join(price, ["plan_id", "pos"])
    out = periods.groupBy("plan_id").agg(
        F.sum("shortage").alias("total_shortage"), F.sum("flare").alias("total_flare"),
        (F.sum("generation") * hours).alias("generation_mwh"),
        F.count_if(F.col("shortage") > 1e-9).alias("shortage_periods"),
        F.sum(F.col("generation") * F.col("price")).alias("_worth"), F.avg("price").alias("_price"),
        F.sum("generation").alias("_generation"),
        F.sum(F.col("baseline_generation") * F.col("price")).alias("_base"), F.sum("baseline_flare").alias("_base_flare"))
    level = F.col("_generation") * F.col("_price")
    gained = F.col("_worth") * hours * revenue_scale - F.col("total_flare") * flare_penalty
    base = F.col("_base") * hours * revenue_scale - F.col("_base_flare") * flare_penalty
    return out.select(
        "plan_id", "total_shortage", "total_flare", "generation_mwh", "shortage_periods",
        F.when(level > 0, F.col("_worth") / level).alias("price_weighted_load_ratio"),
        gained.alias("benefit"), base.alias("baseline_benefit"),
        F.when(F.abs(base) > 1e-12, (gained - base) / base).alias("relative_improvement"))


def group_totals(units: DataFrame, fleet: Sequence[Unit], group: str) -> DataFrame:
    """Planned load of one unit group and of the whole fleet per period."""
    members = [u.name for u in fleet if u.group == group]
    return units.groupBy("plan_id", "pos").agg(
        F.sum(F.when(F.col("unit").isin(members), F.col("load")).otherwise(0.0)).alias(f"{group}_plan"),
        F.sum("load").alias("total_plan"))


def shortage_verdict(figures: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    return figures.select("plan_id", "total_shortage", F.when(
        F.col("total_shortage") > tolerance, "rejected").otherwise("accepted").alias("verdict"))


def input_rules(inputs: DataFrame, periods: int, capacity: Mapping[str, float], low: float = 0.15, high: float = 0.90) -> DataFrame:
    """Contract of dispatch inputs (plan_id, pos, gas_type, production, demand, initial_storage, price)."""
    size = _lookup("gas_type", capacity)
    bad = lambda c: finite(c).isNull()
    return inputs.groupBy("plan_id", "gas_type").agg(
        (F.count_distinct("pos") == periods).alias("_whole"),
        (F.count(F.lit(1)) == F.count_distinct("pos")).alias("_unique"),
        F.count_if(bad("production") | bad("demand") | bad("price")).alias("non_finite"),
        F.count_if((F.col("production") < 0) | (F.col("demand") < 0)).alias("negative"),
        F.count_if(~F.coalesce(F.col("initial_storage").between(size * low, size * high), F.lit(False))).alias("storage_outside"),
    ).withColumn("status", F.when(
        F.expr("_whole AND _unique AND non_finite = 0 AND negative = 0 AND storage_outside = 0"), "passed").otherwise("failed")).drop("_whole", "_unique")


def resource_history(wide: DataFrame, roles: Roles, generation: str) -> tuple[DataFrame, list[str]]:
    """Production and priority demand per gas plus total generation as long series."""
    sums = role_columns(wide, roles)
    gases = [n[len("_prod_"):] for n in sums if n.startswith("_prod_")]
    named = {f"production_{g}": sums[f"_prod_{g}"] for g in gases} | {f"demand_{g}": sums[f"_demand_{g}"] for g in gases}
    named["baseline_generation"] = F.col(generation)
    return lengthen(wide.select("series_id", "pos", *[c.alias(n) for n, c in named.items()]), list(named)), gases


def resource_forecast(wide: DataFrame, roles: Roles, generation: str, rule: Model, periods: int, origins: DataFrame) -> DataFrame:
    """Floored resource forecasts (series_id, origin pos, target_pos, gas_type, production, demand, available,
    baseline_generation) of many plants and origins at once."""
    history, gases = resource_history(wide, roles, generation)
    tidy = forecast(history, [rule], list(range(1, periods + 1)), origins)
    picks = [F.max(F.when(F.col("field") == n, at_least(rule.name, 0.0))).alias(n)
             for g in gases for n in (f"production_{g}", f"demand_{g}")]
    flat = tidy.groupBy("series_id", "pos", "target_pos").agg(
        *picks, F.max(F.when(F.col("field") == "baseline_generation", at_least(rule.name, 0.0))).alias("baseline_generation"))
    per_gas = F.explode(F.array(*[
        F.struct(F.lit(g).alias("gas_type"), F.col(f"production_{g}").alias("production"), F.col(f"demand_{g}").alias("demand")) for g in gases]))
    return flat.withColumn("_g", per_gas).select(
        "series_id", "pos", "target_pos", "_g.gas_type", "_g.production", "_g.demand",
        (F.col("_g.production") - F.col("_g.demand")).alias("available"), "baseline_generation")


def dispatch_input(
    wide: DataFrame, roles: Roles, generation: str, rule: Model, periods: int, origins: DataFrame, step_seconds: int,
    price_field: str | None = None,
) -> DataFrame:
    """Forecast resources with the last known holder level at the origin and a price path.

    A price field is forecast like the resources; without one the hourly tariff is the price.
    """
    plan = resource_forecast(wide, roles, generation, rule, periods, origins)
    holders = lengthen(wide.select("series_id", "pos", *dict.fromkeys(roles.holder.values())), list(dict.fromkeys(roles.holder.values())))
    probes = origins.select("series_id", "pos").distinct().withColumn("field", F.explode(F.array(*[
        F.lit(c) for c in dict.fromkeys(roles.holder.values())])))
    level = asof_last(holders, probes, ["series_id", "field"], "value", "initial_storage")
    holder = F.coalesce(*[F.when(F.col("gas_type") == g, F.lit(c)) for g, c in roles.holder.items()], F.lit(None).cast("string"))
    held = plan.withColumn("field", holder).join(level, ["series_id", "pos", "field"], "left").drop("field")
    if price_field is None:
        return held.withColumn("price", tariff(slot_start("target_pos", step_seconds)))
    path = forecast(lengthen(wide.select("series_id", "pos", price_field), [price_field]), [rule], list(range(1, periods + 1)), origins)
    return held.join(path.select("series_id", "pos", "target_pos", F.col(rule.name).alias("price")), ["series_id", "pos", "target_pos"], "left")
