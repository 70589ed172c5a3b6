"""Analog forecasts: find past trajectories like the current one and follow what came after them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from slotwise.operators.blocks import with_halo
from slotwise.operators.neighbours import nearest
from slotwise.session import stored

MAD_SCALE = 1.4826  # fixed value: MAD of a normal variable to its standard deviation
LEAST_SCALE = 0.5  # fixed value: smallest spread a trajectory is divided by


def _median(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def _over(values: str, scale: Column) -> Column:
    return F.transform(values, lambda v: v / scale)


def trajectory_patterns(
    wide: DataFrame, targets: Sequence[str], levels: Sequence[float], context: int, max_horizon: int = 0,
    keys: Sequence[str] = ("series_id",), block: int | None = None,
) -> DataFrame:
    """(keys, pos, pattern, scale, level[, future]) of every slot with a complete context.

    Pattern: differences over their MAD, the level over a nominal level, the recent mean difference
    over the MAD, target after target.
    """
    cut = lambda t, a, b, w: F.collect_list(F.struct("pos", F.col(t).alias("v"))).over(w.rowsBetween(a, b))

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        added = {f"_w_{t}": cut(t, -(context - 1), 0, w) for t in targets}
        if max_horizon:
            added |= {f"_n_{t}": cut(t, 1, max_horizon, w) for t in targets}
        return rows.withColumns(added)

    rows = with_halo(wide.select(*keys, "pos", *targets), keys, compute, back=context, ahead=max_horizon, block=block)
    full = F.lit(True)
    for t in targets:
        full = full & (F.size(f"_w_{t}") == context) & ~F.exists(f"_w_{t}", lambda s: s["v"].isNull())
    rows = rows.where(full)
    for t in targets:
        values = F.transform(f"_w_{t}", lambda s: s["v"])
        steps = F.zip_with(F.slice(values, 2, context - 1), F.slice(values, 1, context - 1), lambda a, b: a - b)
        rows = rows.withColumn(f"_d_{t}", steps).withColumn(f"_c_{t}", _median(F.col(f"_d_{t}")))
        spread = _median(F.transform(f"_d_{t}", lambda d: F.abs(d - F.col(f"_c_{t}"))))
        rows = rows.withColumn(f"_s_{t}", F.greatest(MAD_SCALE * spread, F.lit(LEAST_SCALE)))
    recent = min(4, context - 1)
    tail = lambda t: F.aggregate(F.slice(f"_d_{t}", -recent, recent), F.lit(0.0), lambda a, x: a + x) / recent
    pattern = F.concat(
        *[_over(f"_d_{t}", F.col(f"_s_{t}")) for t in targets],
        F.array(*[F.col(t) / F.lit(float(n)) for t, n in zip(targets, levels)]),
        F.array(*[tail(t) / F.col(f"_s_{t}") for t in targets]))
    out = [pattern.alias("pattern"), F.array(*[F.col(f"_s_{t}") for t in targets]).alias("scale"),
           F.array(*[F.col(t) for t in targets]).alias("level")]
    if max_horizon:
        out.append(F.array(*[F.transform(f"_n_{t}", lambda s: s["v"]) for t in targets]).alias("future"))
    return rows.select(*keys, "pos", *out)


def analog_forecast(
    patterns: DataFrame, origins: DataFrame, targets: Sequence[str], horizons: Sequence[int], k: int = 32,
    keys: Sequence[str] = ("series_id",), chunk: int = 4096,
) -> DataFrame:
    """(keys, fold, pos, horizon, field, analog): current level plus the weighted changes after the neighbours.

    ``origins``: (keys, fold, pos). Candidates of a fold end early enough for their own future to lie
    before its first origin, so nothing of the validation period is used.
    """
    far = max(horizons)
    starts = origins.groupBy(*keys, "fold").agg((F.min("pos") - 1).alias("_end"))
    complete = F.lit(True)
    for i in range(len(targets)):
        complete = complete & (F.size(F.get("future", F.lit(i))) >= far) & ~F.exists(F.get("future", F.lit(i)), lambda v: v.isNull())
    patterns = stored(patterns)
    pool = stored(patterns.where(complete).join(starts, list(keys)).where(F.col("pos") + far <= F.col("_end")).drop("_end"))
    asked = stored(patterns.join(origins, [*keys, "pos"]))
    group = [*keys, "fold"]
    near = stored(nearest(asked, pool, group, k, chunk=chunk))
    middle = near.groupBy(*group, "query").agg(F.greatest(F.expr("percentile(distance, 0.5D)"), F.lit(1e-6)).alias("_mid"))
    weighted = near.join(middle, [*group, "query"]).withColumn("_w", F.exp(-F.col("distance") / F.col("_mid")))
    told = pool.select(*group, F.col("pos").alias("neighbour"), F.col("scale").alias("_ns"), F.col("level").alias("_nl"), "future")
    mine = asked.select(*group, F.col("pos").alias("query"), F.col("scale").alias("_qs"), F.col("level").alias("_ql"))
    rows = weighted.join(told, [*group, "neighbour"]).join(mine, [*group, "query"])
    cells = []
    for i, t in enumerate(targets):
        at = F.lit(i)
        ratio = F.least(F.greatest(F.get("_qs", at) / F.greatest(F.get("_ns", at), F.lit(1e-6)), F.lit(0.5)), F.lit(2.0))
        for h in horizons:
            change = (F.get(F.get("future", at), F.lit(h - 1)) - F.get("_nl", at)) * ratio
            cells.append(F.struct(F.lit(t).alias("field"), F.lit(h).alias("horizon"), change.alias("change"), F.get("_ql", at).alias("level")))
    spread = rows.withColumn("_x", F.explode(F.array(*cells)))
    out = spread.groupBy(*group, F.col("query").alias("pos"), F.col("_x.field").alias("field"), F.col("_x.horizon").alias("horizon")).agg(
        (F.first("_x.level") + F.sum(F.col("_x.change") * F.col("_w")) / F.greatest(F.sum("_w"), F.lit(1e-12))).alias("analog"))
    return out
