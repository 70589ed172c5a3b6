"""Binning raw rows onto slots, aligning several tables and filling the regular grid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.functions.slots import VARIANTS, slot_of
from slotwise.operators.blocks import DEFAULT_BLOCK, block_of
from slotwise.operators.order_stats import exact_quantiles

AGGREGATES = ("mean", "sum", "min", "max", "first", "last", "median")


def _aggregate(method: str, value: Column, ordinal: Column | None) -> Column:
    if method in ("first", "last"):
        if ordinal is None:
            raise ValueError(f"{method} needs an ingest ordinal")
        present = F.when(value.isNotNull(), ordinal)
        return F.min_by(value, present) if method == "first" else F.max_by(value, present)
    builtin = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    if method not in builtin:
        raise ValueError(f"unsupported aggregate {method!r}")
    return builtin[method](value)


def collapse(
    df: DataFrame, keys: Sequence[str], methods: Mapping[str, str], ordinal: str | None = None,
) -> DataFrame:
    """One row per key, each column folded by its own rule.

    A partially aggregated ``groupBy`` does the work; medians use exact order statistics, which
    do not gather a group in one task.
    """
    bad = set(methods.values()) - set(AGGREGATES)
    if bad:
        raise ValueError(f"unsupported aggregate {sorted(bad)}")
    order = F.col(ordinal) if ordinal else None
    plain = {c: m for c, m in methods.items() if m != "median"}
    aggregates = [_aggregate(m, F.col(c), order).alias(c) for c, m in plain.items()]
    out = df.groupBy(*keys).agg(*(aggregates or [F.count(F.lit(1)).alias("_rows")]))
    for column in [c for c, m in methods.items() if m == "median"]:
        middle = exact_quantiles(df, keys, F.col(column), {column: 0.5}).drop("n")
        out = out.join(middle, list(keys), "left")
    return out.select(*keys, *methods)


def resample(
    df: DataFrame, keys: Sequence[str], ts: str, methods: Mapping[str, str], step_seconds: int,
    label: str = "right", closed: str = "right", ordinal: str | None = None,
) -> DataFrame:
    """Tumbling bins (keys, pos, columns...); only bins that hold a row, see ``densify``."""
    binned = df.withColumn("pos", slot_of(ts, step_seconds, label, closed))
    return collapse(binned, [*keys, "pos"], methods, ordinal)


def resample_variants(
    df: DataFrame, keys: Sequence[str], ts: str, methods: Mapping[str, str], step_seconds: int,
) -> DataFrame:
    """All four boundary variants in one pass over the rows."""
    options = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(closed).alias("closed"),
                 slot_of(ts, step_seconds, label, closed).alias("pos"))
        for label, closed in VARIANTS
    ])
    spread = df.withColumn("_v", F.explode(options)).select("*", "_v.label", "_v.closed", "_v.pos").drop("_v")
    return collapse(spread, [*keys, "label", "closed", "pos"], methods)


def slot_skeleton(bounds: DataFrame, lo: str = "lo", hi: str = "hi", block: int = DEFAULT_BLOCK) -> DataFrame:
    """One row per slot of [lo, hi]; expanded block by block so that one long series spreads."""
    others = [c for c in bounds.columns if c not in (lo, hi)]
    blocks = bounds.withColumn("_blk", F.explode(F.sequence(block_of(lo, block), block_of(hi, block))))
    spread = blocks.repartition(*[c for c in others if bounds.schema[c].dataType.typeName() == "string"], "_blk")
    first = F.greatest(F.col(lo), F.col("_blk") * block)
    last = F.least(F.col(hi), F.col("_blk") * block + (block - 1))
    return spread.select(*others, F.explode(F.sequence(first, last)).alias("pos"))


def densify(binned: DataFrame, series: str = "series_id", field: str = "field", value: str = "value") -> DataFrame:
    """Every field of a series on every slot between the series' first and last bin."""
    # one light pass over keys and slots; the span of the series comes from the short result
    per_field = binned.groupBy(series, field).agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    whole = Window.partitionBy(series)
    bounds = per_field.select(series, field, F.min("_lo").over(whole).alias("lo"), F.max("_hi").over(whole).alias("hi"))
    return slot_skeleton(bounds).join(binned.select(series, field, "pos", value), [series, field, "pos"], "left")


def align(tables: Mapping[str, DataFrame], sum_fields: Sequence[str] = ()) -> DataFrame:
    """Several binned long tables (series_id, field, pos, value) on one common grid.

    Inside its own table's range an empty bin of a summed field is 0.0. A slot that no table's
    range covers is marked ``gap_inserted``.
    """
    stacked = None
    for name, table in tables.items():
        part = table.select("series_id", F.lit(name).alias("table"), "field", "pos", "value")
        stacked = part if stacked is None else stacked.unionByName(part)
    per_table = stacked.groupBy("series_id", "table").agg(
        F.min("pos").alias("t_lo"), F.max("pos").alias("t_hi"), F.collect_set("field").alias("fields"))
    # everything else is window arithmetic on that short table
    plant = Window.partitionBy("series_id")
    ranges = F.collect_list(F.struct("t_lo", "t_hi")).over(plant)
    owners = per_table.select(
        "series_id", "t_lo", "t_hi", F.min("t_lo").over(plant).alias("lo"), F.max("t_hi").over(plant).alias("hi"),
        ranges.alias("ranges"), F.explode("fields").alias("field"))
    counted = owners.withColumn("_owners", F.count(F.lit(1)).over(Window.partitionBy("series_id", "field")))
    refuse = F.raise_error(F.concat(F.lit("field comes from several tables: "), F.col("field"))).cast("boolean")
    checked = counted.where(F.when(F.col("_owners") > 1, refuse).otherwise(F.lit(True))).drop("_owners")
    slots = slot_skeleton(checked)
    joined = slots.join(stacked.drop("table"), ["series_id", "field", "pos"], "left")
    in_own = F.col("pos").between(F.col("t_lo"), F.col("t_hi"))
    zero_bin = in_own & F.col("field").isin(list(sum_fields)) if sum_fields else F.lit(False)
    covered = F.exists("ranges", lambda r: F.col("pos").between(r["t_lo"], r["t_hi"]))
    return joined.select(
        "series_id", "field", "pos",
        F.when(F.col("value").isNull() & zero_bin, F.lit(0.0)).otherwise(F.col("value")).alias("value"),
        (~covered).cast("int").alias("gap_inserted"),
    )


def widen(long: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("series_id", "pos"),
          field: str = "field", value: str = "value") -> DataFrame:
    """Fixed list of fields as columns; one shuffle whatever the number of source tables."""
    picks = [F.max(F.when(F.col(field) == name, F.col(value))).alias(name) for name in fields]
    return long.groupBy(*keys).agg(*picks)


def lengthen(wide: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("series_id", "pos"),
             field: str = "field", value: str = "value") -> DataFrame:
    return wide.unpivot(list(keys), list(fields), field, value)


def outer_align(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer equi-join of wide tables; a repeated non-key column name is refused."""
    seen: set[str] = set(keys)
    out = None
    for table in tables:
        names = [c for c in table.columns if c not in keys]
        if seen & set(names):
            raise ValueError(f"repeated column names: {sorted(seen & set(names))}")
        seen |= set(names)
        out = table if out is None else out.join(table, list(keys), "full_outer")
    return out
