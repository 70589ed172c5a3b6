"""Data contracts: small aggregates that name every broken rule, and a guard that raises."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.names import forecast_columns
from slotwise.functions.numbers import finite
from slotwise.operators.blocks import beside, with_halo


class ContractError(AssertionError):
    """A table does not keep its contract."""


def require_zero(offenders: DataFrame, rule: str) -> None:
    """Raise if any offending row exists; reads at most one row."""
    if offenders.limit(1).count():
        raise ContractError(rule)


def count_rules(df: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows breaking each rule, all rules in one pass: (by..., check, broken, status)."""
    counted = df.groupBy(*by).agg(*[
        F.count_if(F.coalesce(broken, F.lit(True))).alias(name) for name, broken in rules.items()])
    return counted.unpivot(list(by), list(rules), "check", "broken").withColumn(
        "status", F.when(F.col("broken") == 0, "passed").otherwise("failed"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def missing_origins(origins: DataFrame, grid: DataFrame, keys: Sequence[str] = ("series_id", "pos")) -> DataFrame:
    """Origins that the grid does not hold."""
    return origins.join(grid.select(*keys).distinct(), list(keys), "left_anti")


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows found on one side only, tagged; empty means equal as multisets."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right")))


def validate_targets(long: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(series_id, field, present, status) for every wanted target of every series."""
    present = long.where(F.col("field").isin(list(targets))).groupBy("series_id", "field").agg(
        F.count("value").alias("present"))
    wanted = long.select("series_id").distinct().withColumn(
        "field", F.explode(F.array(*[F.lit(t) for t in targets])))
    return wanted.join(present, ["series_id", "field"], "left").select(
        "series_id", "field", F.coalesce("present", F.lit(0)).alias("present"),
        F.when(F.col("present") > 0, "passed").otherwise("failed").alias("status"))


def check_request(grid: DataFrame, origins: DataFrame, targets: Sequence[str], horizons: Sequence[int]) -> None:
    """A forecast request: known targets, origins on the grid, positive horizons."""
    if not horizons or min(horizons) <= 0:
        raise ContractError("horizons must be positive")
    require_zero(validate_targets(grid, targets).where("status = 'failed'"), "unknown or empty target")
    require_zero(missing_origins(origins, grid), "origin outside the grid")


def input_frame_rules(
    frame: DataFrame, columns: Sequence[str], key: str = "series_id", origins: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Contract of a model-input frame: one row per slot, no hole, every cell finite.

    With ``origins`` (key, pos) every expected series has a row here, also if the frame lacks it, and ``missing`` and
    ``unexpected`` count the differing slots; ``rows`` is the expected number per series. An empty frame gives one failed row.
    """
    stepped = with_halo(
        frame, [key], lambda rows, w: rows.withColumn("_prev", F.lag("pos").over(w)), back=1)
    cells = [F.col(c) for c in columns]
    bad_cells = sum((finite(c).isNull().cast("bigint") for c in cells), F.lit(0).cast("bigint"))
    spans = frame.groupBy(key).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count(F.lit(1)).alias("rows"))
    scanned = stepped.withColumn("_bad", bad_cells).groupBy(key).agg(
        F.count_if(F.col("_prev") == F.col("pos")).alias("repeated"),
        F.count_if(F.col("pos") - F.col("_prev") > 1).alias("holes"),
        F.sum("_bad").alias("non_finite"))
    out = spans.join(scanned, key)
    broken = F.expr("repeated > 0 OR holes > 0 OR non_finite > 0")
    if origins is not None:
        apart = origin_difference(frame, origins, (key, "pos")).groupBy(key).agg(
            F.count_if(F.col("problem") == "missing").alias("missing"), F.count_if(F.col("problem") == "unexpected").alias("unexpected"))
        out = out.join(apart, key, "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("missing", "unexpected", "rows")})
        broken = broken | F.expr("missing > 0 OR unexpected > 0")
    if rows is not None:
        broken = broken | (F.col("rows") != rows)
    out = out.withColumn("status", F.when(F.coalesce(broken, F.lit(True)), "failed").otherwise("passed"))
    nothing = frame.sparkSession.range(1).select(*[
        F.lit("failed" if f.name == "status" else 0 if f.name == "rows" else None).cast(f.dataType).alias(f.name) for f in out.schema.fields])
    empty = out.agg(F.count(F.lit(1)).alias("n")).select("n")
    return out.unionByName(beside(nothing, empty).where("n = 0").drop("n"))


def origin_difference(frame: DataFrame, origins: DataFrame, keys: Sequence[str] = ("series_id", "pos")) -> DataFrame:
    """Expected origins without a row and rows without an expected origin."""
    have, want = frame.select(*keys).distinct(), origins.select(*keys).distinct()
    return want.join(have, list(keys), "left_anti").withColumn("problem", F.lit("missing")).unionByName(
        have.join(want, list(keys), "left_anti").withColumn("problem", F.lit("unexpected")))


def forecast_frame_rules(
    wide: DataFrame, targets: Sequence[str], horizons: Sequence[int], step_minutes: int = 15,
    capacities: Mapping[str, float] | None = None, part: str | None = None, total: str | None = None,
    time_column: str = "datetime", origins: DataFrame | None = None, tolerance: float = 1e-6,
) -> DataFrame:
    """Rules of a wide forecast table (``datetime`` text plus one column per target and horizon).

    Limits hold up to ``tolerance``. An empty table breaks ``empty``. With ``origins`` (the key columns), ``origins`` counts
    the keys found on one side only.
    """
    expected = forecast_columns(targets, horizons, step_minutes)
    found = [c for c in wide.columns if c not in (time_column, "series_id")]
    if found != expected:
        raise ContractError(f"forecast columns differ: expected {expected[:4]}..., found {found[:4]}...")
    name = lambda t, h: forecast_columns([t], [h], step_minutes)[0]
    cell = lambda t, h: F.col(f"`{name(t, h)}`")
    pattern = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
    rules = {
        "time_format": ~F.col(time_column).rlike(pattern),
        "non_finite": sum((finite(F.col(f"`{c}`")).isNull().cast("int") for c in expected), F.lit(0)) > 0,
        "negative": F.least(*[F.col(f"`{c}`") for c in expected], F.lit(0.0)) < -tolerance,
    }
    for target, capacity in (capacities or {}).items():
        rules[f"capacity_{target}"] = F.greatest(*[cell(target, h) for h in horizons], F.lit(0.0)) > capacity + tolerance
    if part and total:
        over = [(cell(part, h) > cell(total, h) + tolerance).cast("int") for h in horizons]
        rules["part_over_total"] = sum(over, F.lit(0)) > 0
    counted = count_rules(wide, rules)
    keys = [c for c in ("series_id", time_column) if c in wide.columns]
    copies = duplicates(wide, keys).agg(F.lit("unique_origin").alias("check"), F.count(F.lit(1)).alias("broken"))
    checks = [copies, empty_table(wide)]
    if origins is not None:
        apart = origin_difference(wide, origins, keys)
        checks.append(apart.agg(F.lit("origins").alias("check"), F.count(F.lit(1)).alias("broken")))
    for check in checks:
        counted = counted.unionByName(check.withColumn("status", F.when(F.col("broken") == 0, "passed").otherwise("failed")))
    return counted


def empty_table(df: DataFrame) -> DataFrame:
    """(check, broken): one breach if there is no row."""
    return df.agg(F.lit("empty").alias("check"), (F.count(F.lit(1)) == 0).cast("bigint").alias("broken"))


def plan_frame_rules(
    plan: DataFrame, time_column: str = "datetime", prefix: str = "opt_", columns: Sequence[str] | None = None,
    tolerance: float = 1e-9,
) -> DataFrame:
    """A dispatch plan table: prefixed columns (``columns``: exactly these, in order), a time in every row, once per plan,
    cells finite and not below -``tolerance``, and not empty."""
    cells = [c for c in plan.columns if c not in (time_column, "series_id", "plan_id")]
    wrong = [c for c in cells if not c.startswith(prefix)]
    if columns is not None and cells != list(columns):
        raise ContractError(f"plan columns differ: expected {list(columns)}, found {cells}")
    if wrong or not cells:
        raise ContractError(f"plan columns must start with {prefix}: {wrong}")
    counted = count_rules(plan, {
        "non_finite": sum((finite(F.col(c)).isNull().cast("int") for c in cells), F.lit(0)) > 0,
        "negative": F.least(*[F.col(c) for c in cells], F.lit(0.0)) < -tolerance,
        "no_time": F.col(time_column).isNull(),
    })
    keys = [c for c in ("series_id", "plan_id", time_column) if c in plan.columns]
    copies = duplicates(plan, keys).agg(F.lit("unique_time").alias("check"), F.count(F.lit(1)).alias("broken"))
    for check in (copies, empty_table(plan)):
        counted = counted.unionByName(check.withColumn("status", F.when(F.col("broken") == 0, "passed").otherwise("failed")))
    return counted


def bundle_rules(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Rules of several tables as one report (table, check, broken, status)."""
    out = None
    for name, rules in parts.items():
        tagged = rules.select(F.lit(name).alias("table"), "check", "broken", "status")
        out = tagged if out is None else out.unionByName(tagged)
    return out


def target_time_errors(tidy: DataFrame) -> DataFrame:
    """Rows whose target slot is not origin + horizon."""
    return tidy.where(F.col("target_pos") != F.col("pos") + F.col("horizon"))


def aligned_sources(frames: Mapping[str, DataFrame], columns: int, rows: int, keys: Sequence[str] = ("series_id", "pos")) -> DataFrame:
    """Contract of several forecast tables that are to be blended: shape, unique origins, one time axis."""
    names = list(frames)
    out = None
    for name, df in frames.items():
        cells = [c for c in df.columns if c not in keys]
        empty = sum((finite(F.col(f"`{c}`")).isNull().cast("int") for c in cells), F.lit(0)) > 0
        part = df.agg(
            F.lit(name).alias("table"), (F.lit(len(cells)) != columns).cast("bigint").alias("wrong_columns"),
            F.abs(F.count(F.lit(1)) - F.lit(rows)).alias("row_difference"),
            (F.count(F.lit(1)) - F.count_distinct(*keys)).alias("repeated_origins"), F.count_if(empty).alias("non_finite"))
        other = origin_difference(df, frames[names[0]], keys).agg(F.count(F.lit(1)).alias("axis_difference"))
        part = beside(part, other)
        out = part if out is None else out.unionByName(part)
    return out
