"""Block layouts that let one long series spread over the cluster.

A window needs a partition key. A series may be one third of all rows, so the key is
(series, block of slots) and every row is also copied into the neighbouring block that
looks back (or ahead) at it. Unbounded look-back uses a per-block summary instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.session import stored

DEFAULT_BLOCK = 8192


def block_of(order: Column | str, size: int) -> Column:
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(size)).cast("bigint")


def with_halo(
    df: DataFrame,
    keys: Sequence[str],
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int = 0,
    ahead: int = 0,
    order: str = "pos",
    block: int | None = None,
) -> DataFrame:
    """Run ``compute(rows, window)`` where frames reach at most ``back``/``ahead`` orders away.

    ``order`` must number the rows of a key without gaps if row frames are used. Rows copied
    in from the neighbour blocks are dropped afterwards, so each input row comes out once.
    """
    size = max(block or DEFAULT_BLOCK, back, ahead, 1)
    here = block_of(order, size)
    wanted = [here]
    if back:
        wanted.append(block_of(F.col(order) + back, size))
    if ahead:
        wanted.append(block_of(F.col(order) - ahead, size))
    spread = df.withColumn("_blk", F.explode(F.array_distinct(F.array(*wanted))))
    window = Window.partitionBy(*keys, "_blk").orderBy(order)
    return compute(spread, window).where(F.col("_blk") == here).drop("_blk")


def beside(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """``rows`` with the columns of a one-row aggregate, fetched once as a scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns).alias("_one")).scalar()
    return rows.withColumn("_one", packed).select(*rows.columns, "_one.*")


#: Rows up to which ``join_small`` broadcasts its table.
SMALL_ROWS = 100_000


def join_small(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", limit: int = SMALL_ROWS, ready: bool = False,
) -> DataFrame:
    """Join with a table of cells, columns or folds without moving ``rows``, as long as the table is small.

    A key with a few values would send all rows to as many tasks, so the table is broadcast. It is stored first and its
    rows are counted (``ready``: it is stored already). Beyond ``limit`` it has that many keys, and a merge join follows, of which adaptive execution
    splits the hot keys.
    """
    table = table if ready else stored(table)
    small = table.count() <= limit
    return rows.join(F.broadcast(table) if small else table.hint("merge"), list(keys), how)


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    out: str,
    order: str = "pos",
    include_current: bool = True,
    block: int | None = None,
    tie: Sequence[Column] = (),
    first: str | None = None,
) -> DataFrame:
    """Last non-null ``value`` at or before each row, however far back it lies.

    Pass one takes the last value of every block, pass two carries it over the short block
    table, and the result is joined back: no task ever holds a whole series. ``first`` names a
    column for the smallest order of the key, which the block table knows as well.
    """
    size = block or DEFAULT_BLOCK
    staged = df.withColumn("_v", value).withColumn("_blk", block_of(order, size))
    seen = (
        Window.partitionBy(*keys, "_blk").orderBy(order, *tie)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    rank = F.struct(F.col(order), *tie) if tie else F.col(order)
    ends = staged.groupBy(*keys, "_blk").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), rank)).alias("_end"), F.min(order).alias("_low"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    lowest = [F.min("_low").over(Window.partitionBy(*keys)).alias(first)] if first else []
    carried = ends.select(*keys, "_blk", F.last("_end", ignorenulls=True).over(before).alias("_carry"), *lowest)
    return (
        staged.withColumn("_seen", F.last("_v", ignorenulls=True).over(seen))
        .join(carried, [*keys, "_blk"], "left")
        .withColumn(out, F.coalesce("_seen", "_carry"))
        .drop("_v", "_seen", "_carry", "_blk")
    )


def running_total(
    df: DataFrame, keys: Sequence[str], amount: Column, out: str, order: str = "pos",
    block: int | None = None,
) -> DataFrame:
    """Running sum along ``order`` from per-block totals plus a running sum inside the block."""
    size = block or DEFAULT_BLOCK
    staged = df.withColumn("_amount", amount).withColumn("_blk", block_of(order, size))
    totals = staged.groupBy(*keys, "_blk").agg(F.sum("_amount").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.select(*keys, "_blk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_opening"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        staged.withColumn("_inside", F.sum("_amount").over(inside))
        .join(opening, [*keys, "_blk"], "left")
        .withColumn(out, F.col("_inside") + F.col("_opening"))
        .drop("_amount", "_inside", "_opening", "_blk")
    )


def asof_last(
    facts: DataFrame, probes: DataFrame, keys: Sequence[str], value: str, out: str,
    order: str = "pos", block: int | None = None,
) -> DataFrame:
    """As-of join: for each probe the last non-null fact at or before it, probes kept whole."""
    extra = [c for c in probes.columns if c not in keys and c != order]
    packed = F.struct(*[F.col(c) for c in extra]) if extra else F.struct(F.lit(1).alias("_one"))
    left = facts.where(F.col(value).isNotNull()).select(
        *keys, order, F.col(value).alias("_fact"), F.lit(None).cast(_type_of(probes, packed)).alias("_probe"))
    right = probes.select(
        *keys, order, F.lit(None).cast(facts.schema[value].dataType).alias("_fact"), packed.alias("_probe"))
    # facts sort before probes of the same slot
    found = carry_last(left.unionByName(right), keys, F.col("_fact"), out, order=order, block=block,
                       tie=[F.col("_probe").isNotNull()])
    back = [F.col("_probe")[c].alias(c) for c in extra]
    return found.where(F.col("_probe").isNotNull()).select(*keys, order, *back, out)


def _type_of(df: DataFrame, column: Column):
    return df.select(column.alias("x")).schema["x"].dataType
