"""Exact order statistics of groups that may be as large as the table.

Spark's ``percentile`` keeps a whole group in one task. Here equal values are first collapsed
to counts; the value axis is cut into ranges that hold about equally many collapsed rows, whatever
their group (a sketch finds the *cuts*, never a result); ranks inside a range come from a window per
group and range, and the offset of a range from the short table of range sizes. So no task holds
more than one range, even if a single group is the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.operators.blocks import beside

# fixed values: names of the interpolation rules between two order statistics
INTERPOLATIONS = ("linear", "lower", "higher", "midpoint", "nearest")


def _range_count(df: DataFrame) -> int:
    return min(16384, max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def ranked_masses(
    df: DataFrame, keys: Sequence[str], value: Column, masses: Sequence[Column], ranges: int | None = None,
) -> DataFrame:
    """(keys, value, mass_i, hi_i, total_i): for every distinct value its masses, each up to and with it, and of the group."""
    names = [f"mass_{i}" for i in range(len(masses))]
    distinct = (
        df.select(*keys, value.alias("value"), *[m.alias(n) for m, n in zip(masses, names)])
        .where(F.col("value").isNotNull())
        .groupBy(*keys, "value").agg(*[F.sum(n).alias(n) for n in names])
    )
    ranges = ranges or _range_count(df)
    stride = math.isqrt(ranges) + 1
    steps = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = distinct.agg(F.percentile_approx("value", steps, max(10_000, 4 * ranges)).alias("_cuts"))
    # every stride-th cut finds the stretch, the cuts of that stretch find the range
    cuts = cuts.select("_cuts", F.filter("_cuts", lambda c, i: (i + 1) % stride == 0).alias("_coarse"))
    below = lambda c: c < F.col("value")
    skipped = F.size(F.filter("_coarse", below)) * stride
    placed = beside(distinct, cuts).withColumn("_skip", skipped).select(
        *keys, "value", *names,
        (F.col("_skip") + F.size(F.filter(F.slice("_cuts", F.col("_skip") + 1, F.lit(stride)), below))).alias("_range"))
    sizes = placed.groupBy(*keys, "_range").agg(*[F.sum(n).alias(f"_size_{n}") for n in names])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = sizes.select(
        *keys, "_range", *[F.coalesce(F.sum(f"_size_{n}").over(before), F.lit(0)).alias(f"_offset_{n}") for n in names],
        *[F.sum(f"_size_{n}").over(whole).alias(f"_total_{n}") for n in names])
    inside = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({f"_upto_{n}": F.sum(n).over(inside) for n in names}).join(offsets, [*keys, "_range"])
    return summed.select(
        *keys, "value", *names, *[(F.col(f"_offset_{n}") + F.col(f"_upto_{n}")).alias(n.replace("mass", "hi")) for n in names],
        *[F.col(f"_total_{n}").alias(n.replace("mass", "total")) for n in names])


def ranked_mass(
    df: DataFrame, keys: Sequence[str], value: Column, mass: Column | None = None, ranges: int | None = None,
) -> DataFrame:
    """(keys, value, lo, hi, total): cumulative mass before and after every distinct value."""
    mass = F.lit(1).cast("bigint") if mass is None else mass
    return ranked_masses(df, keys, value, [mass], ranges).select(
        *keys, "value", (F.col("hi_0") - F.col("mass_0")).alias("lo"), F.col("hi_0").alias("hi"), F.col("total_0").alias("total"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column, quantiles: dict[str, float],
    interpolations: Sequence[str] = ("linear",), ranges: int | None = None, mass: Column | None = None,
) -> DataFrame:
    """One row per group; column ``<name>`` (linear) or ``<name>_<rule>`` when several rules are asked. ``mass``: rows that a row stands for."""
    unknown = set(interpolations) - set(INTERPOLATIONS)
    if unknown:
        raise ValueError(f"unknown interpolation {sorted(unknown)}")
    ranks = ranked_mass(df, keys, value, mass, ranges)
    place = {name: (F.col("total") - 1) * F.lit(float(q)) for name, q in quantiles.items()}
    found = []
    for name, at in place.items():
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("lo") <= rank) & (rank < F.col("hi"))
            found.append(F.max(F.when(hit, F.col("value"))).alias(f"_{name}_{side}"))
    stats = ranks.groupBy(*keys).agg(F.max("total").alias("n"), *found)
    outputs = []
    for name, q in quantiles.items():
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        at = (F.col("n") - 1) * F.lit(float(q))
        part = at - F.floor(at)
        # an exact half goes to the even neighbour
        nearer = F.when(part < 0.5, low).when(part > 0.5, high).when(F.floor(at) % 2 == 0, low).otherwise(high)
        rule = {
            "linear": low + (high - low) * part, "lower": low, "higher": high,
            "midpoint": (low + high) / 2, "nearest": nearer,
        }
        for interpolation in interpolations:
            label = name if len(interpolations) == 1 else f"{name}_{interpolation}"
            outputs.append(rule[interpolation].alias(label))
    return stats.select(*keys, "n", *outputs)


def weighted_median(df: DataFrame, keys: Sequence[str], value: Column, weight: Column, out: str) -> DataFrame:
    """Smallest value whose cumulative weight reaches half of the group's weight."""
    ranks = ranked_mass(df, keys, value, weight)
    reached = F.col("hi") >= 0.5 * F.col("total")
    return ranks.groupBy(*keys).agg(F.min(F.when(reached, F.col("value"))).alias(out))


def weighted_median_without(
    df: DataFrame, keys: Sequence[str], part: str, parts: Sequence, value: Column, weight: Column, out: str,
) -> DataFrame:
    """(keys, held, samples, out): for each of ``parts``, the weighted median of the rows of all the others, and their number.

    Values are ranked once, with one mass per part; leaving a part out adds up the running masses of the others. (A total less the
    held mass would lose the digits of light parts.) Null where the others have no weight.
    """
    own = [F.col(part).eqNullSafe(F.lit(p)) for p in parts]
    held = range(len(parts))
    ranks = ranked_masses(df, keys, value, [F.when(o, weight).otherwise(0.0) for o in own])
    rest = lambda name, i: sum((F.col(f"{name}_{j}") for j in held if j != i), F.lit(0.0))
    reached = [(rest("hi", i) >= 0.5 * rest("total", i)) & (rest("total", i) > 0) for i in held]
    middle = ranks.groupBy(*keys).agg(*[F.min(F.when(reached[i], F.col("value"))).alias(f"_m_{i}") for i in held])
    counts = df.where(value.isNotNull()).groupBy(*keys).agg(*[F.count_if(o).alias(f"_n_{i}") for i, o in enumerate(own)])
    others = lambda i: sum((F.col(f"_n_{j}") for j in held if j != i), F.lit(0).cast("bigint"))
    cells = F.array(*[F.struct(
        F.lit(p).cast(df.schema[part].dataType).alias("held"), others(i).alias("samples"), F.col(f"_m_{i}").alias(out)) for i, p in enumerate(parts)])
    return middle.join(counts, list(keys)).select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")


def evenly_spaced(count: int, wanted: int) -> list[int]:
    """Positions of ``wanted`` items spread over ``count`` items, ends included."""
    if wanted >= count:
        return list(range(count))
    if wanted == 1:
        return [count - 1]
    return sorted({math.floor(i * (count - 1) / (wanted - 1)) for i in range(wanted)})
