"""Online compensation: correct a forecast by the errors that have already become known.

An error matures when its target slot is reached. All settings of the grid are columns or
exploded structs of one plan; nothing is replayed origin by origin.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.functions.numbers import ape_floor, finite
from slotwise.operators.blocks import asof_last, beside
from slotwise.session import cut_lineage

# fixed values: signals, centres, windows and shares of the full grid
SIGNALS = (
    "shared_absolute", "shared_relative", "horizon_absolute", "horizon_relative", "blended_absolute",
    "blended_relative", "scaled_shared_absolute",
)
CENTRES = ("median", "mean")
WINDOWS = (1, 2, 4, 8, 16, 32, 64)
SHARES = (0.10, 0.20, 0.30, 0.50, 0.75, 1.00)


@dataclass(frozen=True)
class Setting:
    signal: str
    centre: str
    window: int
    share: float

    @property
    def name(self) -> str:
        return f"{self.signal}|{self.centre}|{self.window}|{self.share:g}"


def setting_grid(signals=SIGNALS, centres=CENTRES, windows=WINDOWS, shares=SHARES) -> list[Setting]:
    return [Setting(*parts) for parts in product(signals, centres, windows, shares)]


def _centred(column: str, centre: str, size: int, window) -> Column:
    frame = window.rowsBetween(-(size - 1), 0)
    return F.avg(column).over(frame) if centre == "mean" else F.expr(f"percentile({column}, 0.5D)").over(frame)


def matured_errors(tidy: DataFrame, groups: Sequence[str], prediction: str = "y_pred") -> DataFrame:
    """(groups, pos, horizon, absolute, relative): errors known at origin ``pos`` of the same group."""
    origins = tidy.select(*groups, "pos").distinct()
    errors = tidy.where(finite("y_true").isNotNull() & finite(prediction).isNotNull()).select(
        *groups, F.col("target_pos").alias("pos"), "horizon",
        (F.col("y_true") - F.col(prediction)).alias("absolute"),
        ((F.col("y_true") - F.col(prediction)) / F.greatest(F.abs(F.col(prediction)), F.lit(1.0))).alias("relative"))
    return errors.join(origins, [*groups, "pos"], "left_semi")


def compensate(
    tidy: DataFrame, settings: Sequence[Setting], groups: Sequence[str] = ("series_id", "field", "fold"),
    prediction: str = "y_pred", max_horizon: int = 8, keep: Sequence[str] = ("y_true",),
) -> DataFrame:
    """(groups, pos, horizon, keep..., setting, y_comp) for every setting.

    A group is one validation fold of one series and target: its length is the fold's, not the
    history's, so plain windows per group and horizon are bounded.
    """
    # the tidy table is read as errors, as origins and as probes: stored once
    tidy = cut_lineage(tidy)
    needs = sorted({(s.centre, s.window) for s in settings})
    errors = matured_errors(tidy, groups, prediction)
    shared = errors.groupBy(*groups, "pos").agg(
        F.expr("percentile(absolute, 0.5D)").alias("absolute"), F.expr("percentile(relative, 0.5D)").alias("relative"))

    def history(rows: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("pos")
        parts = [
            _centred(kind, c, n, w).alias(f"{prefix}_{kind}_{c}_{n}") for kind in ("absolute", "relative") for c, n in needs]
        return rows.select(*keys, "pos", F.struct(*parts).alias(f"_{prefix}"))

    probes = tidy.select(*groups, "pos", "horizon", "target_pos", prediction, *keep)
    own = [*groups, "horizon"]
    rows = asof_last(history(errors, own, "own"), probes, own, "_own", "_own_now")
    rows = asof_last(history(shared, list(groups), "all"), rows, list(groups), "_all", "_all_now")
    zero = F.lit(0.0)

    def correction(s: Setting) -> Column:
        pick = lambda side, kind: F.coalesce(F.col(f"_{side}_now")[f"{side}_{kind}_{s.centre}_{s.window}"], zero)
        base = F.col(prediction)
        rules = {
            "shared_absolute": lambda: pick("all", "absolute"),
            "shared_relative": lambda: base * pick("all", "relative"),
            "horizon_absolute": lambda: pick("own", "absolute"),
            "horizon_relative": lambda: base * pick("own", "relative"),
            "blended_absolute": lambda: 0.5 * (pick("all", "absolute") + pick("own", "absolute")),
            "blended_relative": lambda: 0.5 * base * (pick("all", "relative") + pick("own", "relative")),
            "scaled_shared_absolute": lambda: pick("all", "absolute") * F.col("horizon") / float(max_horizon),
        }
        return rules[s.signal]()

    arms = F.array(*[
        F.struct(F.lit(s.name).alias("setting"), (F.col(prediction) + s.share * correction(s)).alias("y_comp")) for s in settings])
    return rows.withColumn("_s", F.explode(arms)).select(*groups, "pos", "horizon", *keep, "_s.setting", "_s.y_comp")


def recipe(compensated: DataFrame, by: Sequence[str] = (), prefix: str = "cross_month_",
           cell: Sequence[str] = ("field", "horizon")) -> DataFrame:
    """Best setting without each cross-month fold (``held``; null: all of them), globally or per ``by``.

    Only folds whose name starts with ``prefix`` are ever looked at. The score of a setting is the
    mean over cells of the cell's mean error, so sums per (cell, fold, setting) are enough.
    """
    rated = compensated.where(F.col("fold").startswith(prefix) & F.col("y_true").isNotNull())
    sums = cut_lineage(rated.groupBy(*cell, "fold", "setting").agg(
        F.sum(ape_floor("y_true", "y_comp")).alias("e"), F.count("y_comp").alias("n")))
    names = sums.agg(F.array_append(F.array_sort(F.collect_set("fold")), F.lit(None).cast("string")).alias("_names"))
    others = F.filter("_names", lambda held: held.isNull() | (held != F.col("fold")))
    training = beside(sums, names).withColumn("held", F.explode(others)).drop("_names")
    cells = training.groupBy(*cell, "held", "setting").agg((F.sum("e") / F.sum("n")).alias("m"))
    scores = cells.groupBy(*by, "held", "setting").agg((100 * (1 - F.avg("m"))).alias("score"))
    # settings that agree to ten digits are tied: the name decides, not the order of summation
    order = Window.partitionBy(*by, "held").orderBy(F.round("score", 10).desc(), "setting")
    return scores.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
