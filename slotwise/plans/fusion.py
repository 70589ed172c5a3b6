"""Fusing candidate forecasts by out-of-fold evidence.

Rows are only ever summed: per (cell, fold) Gram matrices and losses are plain aggregates, and
leave-one-fold figures are totals minus the held fold. Python sees a few short rows per cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from slotwise.functions.clock import hour_bin
from slotwise.functions.numbers import ape_floor, finite
from slotwise.operators.blocks import join_small
from slotwise.operators.order_stats import weighted_median, weighted_median_without
from slotwise.plans.gates import CELL, column_gate
from slotwise.session import cut_lineage

FLOOR = 1e-6  # fixed value: least denominator of a selection loss
NOBODY = "__none__"


def fold_weight(fold: Column, prefixes: Mapping[str, float] | None) -> Column:
    """Row weight by prefix of the fold's name, 1 without a match."""
    out = F.lit(1.0)
    for prefix, weight in (prefixes or {}).items():
        if not prefix or not np.isfinite(weight) or weight <= 0:
            raise ValueError("fold weights need a prefix and a positive number")
        out = F.when(fold.cast("string").startswith(prefix), F.lit(float(weight))).otherwise(out)
    return out


def eligible(wide: DataFrame, models: Sequence[str], masks: DataFrame | None, cell: Sequence[str]) -> tuple[DataFrame, Column]:
    """``wide`` with ``_mask`` (which models its cell may use), and the condition that a row counts."""
    if masks is None:
        wide = wide.withColumn("_mask", F.array(*[F.lit(True)] * len(models)))
    else:
        wide = join_small(wide, masks.select(*cell, F.col("mask").alias("_mask")), cell)
    usable = finite("y_true").isNotNull()
    for i, m in enumerate(models):
        usable = usable & (finite(m).isNotNull() | ~allowed(i))
    return wide, usable


def allowed(i: int) -> Column:
    return F.coalesce(F.get("_mask", F.lit(i)), F.lit(False))


def gram(
    wide: DataFrame, models: Sequence[str], by: Sequence[str] = (*CELL, "fold"),
    prefixes: Mapping[str, float] | None = None, fold: str = "fold",
    masks: DataFrame | None = None, cell: Sequence[str] = CELL,
) -> DataFrame:
    """Sums of scaled products per group: g_i_j = sum w p_i p_j / d^2, b_i = sum w p_i y / d^2.

    A row counts if the label and all models that ``masks`` (cell, mask) allows in its cell are finite; a
    rejected model may be missing and adds nothing.
    """
    wide, usable = eligible(wide, models, masks, cell)
    wide = wide.select(*[c for c in wide.columns if c not in models], *[
        F.when(allowed(i), F.col(m)).otherwise(0.0).alias(m) for i, m in enumerate(models)])
    scale = fold_weight(F.col(fold), prefixes) / F.pow(F.greatest(F.abs(F.col("y_true")), F.lit(FLOOR)), F.lit(2.0))
    rows = wide.where(usable).withColumn("_s", scale)
    sums = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(models):
        sums.append(F.sum(F.col("_s") * F.col(a) * F.col("y_true")).alias(f"b_{i}"))
        sums += [F.sum(F.col("_s") * F.col(a) * F.col(models[j])).alias(f"g_{i}_{j}") for j in range(i, len(models))]
    return rows.groupBy(*by).agg(*sums)


def simplex_fit(matrix: np.ndarray, vector: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """argmin w'Gw - 2b'w over the simplex, restricted to allowed members, by an active set.

    Starts at the best single member; the member that lowers the loss fastest joins the support, the support is solved
    in closed form, and a member whose weight would turn negative leaves at the boundary. The loss falls with each
    support, so none comes twice and the number of members is not limited.
    """
    members = np.flatnonzero(allowed)
    g, b = matrix[np.ix_(members, members)], vector[members]
    out = np.zeros(len(vector))
    if not len(members):
        return out
    if not (np.isfinite(g).all() and np.isfinite(b).all()):
        out[members] = 1.0 / len(members)
        return out
    scale = max(np.abs(np.diag(g)).max(), np.abs(b).max(), 1e-300)
    g, b = g / scale, b / scale
    w = np.zeros(len(members))
    w[np.argmin(np.diag(g) - 2 * b)] = 1.0
    for _ in range(20 * len(members) + 20):
        slope = g @ w - b
        support = w > 0
        level = float(slope @ w)
        outside = np.where(support, np.inf, slope - level)
        enter = int(np.argmin(outside))
        if outside[enter] >= -1e-12:
            break
        support[enter] = True
        while True:
            idx = np.flatnonzero(support)
            kkt = np.zeros((len(idx) + 1, len(idx) + 1))
            kkt[:-1, :-1] = g[np.ix_(idx, idx)]
            kkt[:-1, -1] = kkt[-1, :-1] = 1.0
            part = np.linalg.lstsq(kkt, np.append(b[idx], 1.0), rcond=None)[0][:-1]
            if part.min() >= -1e-12:
                w[:] = 0.0
                w[idx] = np.maximum(part, 0.0)
                break
            falling = part < 0
            share = np.min(w[idx][falling] / (w[idx][falling] - part[falling]))
            w[idx] = w[idx] + share * (part - w[idx])
            leave = idx[falling & (w[idx] <= 1e-12)]
            if not len(leave):
                leave = idx[[int(np.argmin(np.where(falling, w[idx], np.inf)))]]
            w[leave] = 0.0
            support[leave] = False
        w = w / w.sum()
    out[members] = w
    return out


def _unpack(row: pd.Series, k: int) -> tuple[np.ndarray, np.ndarray]:
    matrix = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            matrix[i, j] = matrix[j, i] = row[f"g_{i}_{j}"]
    return matrix, np.array([row[f"b_{i}"] for i in range(k)])


def oof_weights(
    grams: DataFrame, models: Sequence[str], cell: Sequence[str] = CELL, masks: DataFrame | None = None,
    regime: str | None = None, minimum_samples: int = 96, shrinkage: float = 192.0, fold: str = "fold",
) -> DataFrame:
    """(cell, held, regime, samples, weights): ``held`` null is the fit on all folds.

    A null regime row is the pooled fit; a regime with enough samples is mixed n/(n+shrinkage)
    into it. ``masks`` (cell, mask) limits a cell to some of the models.
    """
    k = len(models)
    sums = ["n", *[f"b_{i}" for i in range(k)], *[f"g_{i}_{j}" for i in range(k) for j in range(i, k)]]
    keyed = grams.withColumn("_fold", F.col(fold).cast("string")).withColumn(
        "_regime", F.col(regime) if regime else F.lit(NOBODY)).select(*cell, "_fold", "_regime", *sums)
    if masks is not None:
        keyed = keyed.join(masks.select(*cell, "mask"), list(cell))
    else:
        keyed = keyed.withColumn("mask", F.array(*[F.lit(True)] * k))
    schema = T.StructType([
        *[keyed.schema[c] for c in cell], T.StructField("held", T.StringType()), T.StructField("regime", T.StringType()),
        T.StructField("samples", T.LongType()), T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = np.array(list(pdf["mask"].iloc[0]), dtype=bool)
        out = []
        for held in [None, *sorted(pdf["_fold"].unique())]:
            train = pdf if held is None else pdf[pdf["_fold"] != held]
            if train.empty:
                continue
            total = train[sums].sum()
            pooled = simplex_fit(*_unpack(total, k), mask)
            fits = [(None, int(total["n"]), pooled)]
            if regime:
                for name, group in train.groupby("_regime", sort=True):
                    part = group[sums].sum()
                    if part["n"] < minimum_samples:
                        continue
                    trust = part["n"] / (part["n"] + max(shrinkage, 0.0))
                    mixed = (1 - trust) * pooled + trust * simplex_fit(*_unpack(part, k), mask)
                    fits.append((name, int(part["n"]), mixed / mixed.sum()))
            for name, n, w in fits:
                out.append([*[pdf[c].iloc[0] for c in cell], held, name, n, w.tolist()])
        return pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return keyed.groupBy(*cell).applyInPandas(solve, schema)


def mix(models: Sequence[str], weights: Column) -> Column:
    """Weighted sum of the model columns by an array of weights; null if a used member is null."""
    members = F.array(*[F.col(m) for m in models])
    terms = F.zip_with(members, weights, lambda p, w: F.when(w == 0, F.lit(0.0)).otherwise(p * w))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def apply_weights(
    wide: DataFrame, weights: DataFrame, models: Sequence[str], out: str, cell: Sequence[str] = CELL,
    held_out: bool = True, regime: str | None = None, fold: str = "fold",
) -> DataFrame:
    """Blend each row: by the fit that did not see its fold, with its regime's weights if there are any."""
    chosen = weights.where(F.col("held").isNotNull() if held_out else F.col("held").isNull())
    on_fold = [F.col("held").alias("_held")] if held_out else []
    pooled = chosen.where("regime IS NULL").select(*cell, *on_fold, F.col("weights").alias("_pooled"))
    rows = wide.withColumn("_held", F.col(fold).cast("string"))
    keys = [*cell, "_held"] if held_out else list(cell)
    rows = join_small(rows, pooled, keys, "left")
    use = F.col("_pooled")
    if regime:
        special = chosen.where("regime IS NOT NULL").select(
            *cell, *on_fold, F.col("regime").alias(regime), F.col("weights").alias("_special"))
        rows = join_small(rows, special, [*keys, regime], "left")
        use = F.coalesce("_special", "_pooled")
    return rows.withColumn(out, mix(models, use)).drop("_held", "_pooled", "_special")


def blend_report(rows: DataFrame, prediction: str, by: Sequence[str]) -> DataFrame:
    return rows.where(finite(prediction).isNotNull() & finite("y_true").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(ape_floor("y_true", prediction)).alias("mape"))


def _sum_at(rows: Column, place: int) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + F.get(r["_loss"], F.lit(place)))


def hard_winner(
    wide: DataFrame, models: Sequence[str], cell: Sequence[str] = CELL, fold: str = "fold",
    prefixes: Mapping[str, float] | None = None, masks: DataFrame | None = None,
) -> DataFrame:
    """(cell, held, winner, ...): least weighted loss on the other folds; ``held`` null uses all folds.

    Models that ``masks`` rejects neither win nor drop a row by being missing.
    """
    weight = fold_weight(F.col(fold), prefixes)
    wide, labelled = eligible(wide, models, masks, cell)
    loss = [F.when(allowed(i), ape_floor("y_true", m)).otherwise(0.0) for i, m in enumerate(models)]
    per_fold = wide.groupBy(*cell, F.col(fold).cast("string").alias("held")).agg(
        F.sum(F.when(labelled, weight).otherwise(0.0)).alias("_w"), F.count_if(labelled).alias("_n"),
        F.array(*[F.coalesce(F.sum(F.when(labelled, weight * x)), F.lit(0.0)) for x in loss]).alias("_loss"),
        F.array(*[F.coalesce(F.sum(F.when(labelled, x)), F.lit(0.0)) for x in loss]).alias("_plain"))
    if masks is not None:
        per_fold = per_fold.join(masks.select(*cell, "mask"), list(cell))
    else:
        per_fold = per_fold.withColumn("mask", F.array(*[F.lit(True)] * len(models)))
    # a cell has one row per fold; the folds other than the held one are added up directly, because
    # a total minus a very bad fold would lose the digits of the others
    whole = Window.partitionBy(*cell)
    listed = F.array_sort(F.collect_list(F.struct("held", "_w", "_n", "_loss")).over(whole))
    rated = per_fold.withColumn("_folds", listed)

    def pooled(rows: Column) -> tuple[Column, Column, Column]:
        total = F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + r["_w"])
        count = F.aggregate(rows, F.lit(0).cast("bigint"), lambda acc, r: acc + r["_n"])
        return total, count, F.array(*[_sum_at(rows, i) for i in range(len(models))])

    names = F.array(*[F.lit(m) for m in models])

    def champion(losses: Column, total: Column) -> Column:
        numbered = F.transform(
            losses, lambda x, i: F.when(F.get(F.col("mask"), i), F.struct((x / total).alias("loss"), i.alias("i"))))
        return F.array_min(F.array_compact(numbered))

    rest_w, rest_n, rest_loss = pooled(F.filter("_folds", lambda r: r["held"] != F.col("held")))
    held = rated.withColumn("_best", F.when(rest_w > 0, champion(rest_loss, rest_w))).select(
        *cell, "held", F.get(names, F.col("_best.i")).alias("winner"),
        rest_n.alias("selection_samples"), F.col("_best.loss").alias("selection_mape"),
        F.col("_n").alias("held_out_samples"),
        F.when(F.col("_n") > 0, F.get("_plain", F.col("_best.i")) / F.col("_n")).alias("held_out_mape"))
    all_w, all_n, all_loss = pooled(F.col("_folds"))
    final = rated.dropDuplicates(list(cell)).where(all_w > 0).withColumn("_best", champion(all_loss, all_w)).select(
        *cell, F.lit(None).cast("string").alias("held"), F.get(names, F.col("_best.i")).alias("winner"),
        all_n.alias("selection_samples"), F.col("_best.loss").alias("selection_mape"),
        F.lit(None).cast("bigint").alias("held_out_samples"), F.lit(None).cast("double").alias("held_out_mape"))
    return held.unionByName(final)


def apply_winner(wide: DataFrame, winners: DataFrame, models: Sequence[str], out: str,
                 cell: Sequence[str] = CELL, fold: str = "fold") -> DataFrame:
    """Prediction of the model that won without the row's fold."""
    picks = winners.where("held IS NOT NULL").select(*cell, F.col("held").alias("_held"), F.col("winner").alias("_winner"))
    rows = join_small(wide.withColumn("_held", F.col(fold).cast("string")), picks, [*cell, "_held"], "left")
    value = F.coalesce(*[F.when(F.col("_winner") == m, F.col(m)) for m in models])
    return rows.withColumn(out, value).drop("_held", "_winner")


def _hour_ratios(rows: DataFrame, prediction: str, bin_size: int, time: str) -> DataFrame:
    usable = finite("y_true").isNotNull() & finite(prediction).isNotNull() & (F.abs(F.col(prediction)) > FLOOR)
    return rows.where(usable).withColumn("hour_bin", hour_bin(time, bin_size)).withColumns({
        "_ratio": F.col("y_true") / F.col(prediction),
        "_weight": F.abs(F.col(prediction)) / F.greatest(F.abs(F.col("y_true")), F.lit(FLOOR))})


def _shrunk(middle: DataFrame, minimum_samples: int, shrinkage: float, least: float, most: float) -> DataFrame:
    trust = F.col("samples") / (F.col("samples") + max(shrinkage, 0.0))
    factor = 1 + trust * (F.col("raw_factor") - 1)
    return middle.where(F.col("samples") >= minimum_samples).withColumn(
        "factor", F.least(F.greatest(factor, F.lit(least)), F.lit(most)))


def hour_factors(
    rows: DataFrame, prediction: str = "y_pred", keys: Sequence[str] = CELL, bin_size: int = 4,
    minimum_samples: int = 24, shrinkage: float = 48.0, least: float = 0.90, most: float = 1.10,
    time: str = "target_ts",
) -> DataFrame:
    """(keys, hour_bin, factor): shrunk and clipped weighted median of truth over forecast."""
    binned, group = _hour_ratios(rows, prediction, bin_size, time), [*keys, "hour_bin"]
    counts = binned.groupBy(*group).agg(F.count(F.lit(1)).alias("samples"))
    middle = weighted_median(binned, group, F.col("_ratio"), F.col("_weight"), "raw_factor")
    return _shrunk(counts.join(middle, group), minimum_samples, shrinkage, least, most)


def held_out_hour_factors(
    rows: DataFrame, prediction: str = "y_pred", keys: Sequence[str] = CELL, fold: str = "fold", bin_size: int = 4,
    minimum_samples: int = 24, shrinkage: float = 48.0, least: float = 0.90, most: float = 1.10,
    time: str = "target_ts",
) -> DataFrame:
    """(keys, hour_bin, held, factor): factors of the rows outside each fold, from one ranking of all rows."""
    folds = [r[0] for r in rows.select(fold).where(F.col(fold).isNotNull()).distinct().orderBy(fold).collect()]
    binned = _hour_ratios(rows, prediction, bin_size, time)
    middle = weighted_median_without(binned, [*keys, "hour_bin"], fold, folds or [None], F.col("_ratio"), F.col("_weight"), "raw_factor")
    return _shrunk(middle.where(F.col("raw_factor").isNotNull()), minimum_samples, shrinkage, least, most)


def calibrate(
    rows: DataFrame, factors: DataFrame, prediction: str = "y_pred", out: str = "calibrated",
    keys: Sequence[str] = CELL, bin_size: int = 4, time: str = "target_ts",
) -> DataFrame:
    """Multiply by the factor of the target hour; no factor means 1."""
    on = [*keys, "hour_bin"]
    joined = join_small(rows.withColumn("hour_bin", hour_bin(time, bin_size)), factors.select(*on, "factor"), on, "left")
    return joined.withColumn(out, F.col(prediction) * F.coalesce("factor", F.lit(1.0))).drop("factor", "hour_bin")


def cross_fit_calibration(
    rows: DataFrame, prediction: str = "y_pred", out: str = "calibrated", keys: Sequence[str] = CELL,
    fold: str = "fold", time: str = "target_ts", **settings,
) -> DataFrame:
    """Every fold is calibrated with factors learnt on the other folds."""
    factors = held_out_hour_factors(rows, prediction, keys, fold, time=time, **settings).withColumnRenamed("held", "_held")
    marked = rows.withColumn("_held", F.col(fold))
    return calibrate(marked, factors, prediction, out, ["_held", *keys], settings.get("bin_size", 4), time).drop("_held")


def fuse(
    wide: DataFrame, models: Sequence[str], baseline: str = "last_value", cell: Sequence[str] = CELL,
    prefixes: Mapping[str, float] | None = None, regime: str | None = None, minimum_folds: int = 5,
    worst: float = 0.01, minimum_samples: int = 96, shrinkage: float = 192.0, hard_router: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """All cells at once: candidate gates, blend, regime blend, hard router, final gate, fallback.

    Returns (rows with ``fused`` out-of-fold predictions, one summary row per cell).
    """
    # the tidy table feeds a dozen aggregates; each stage is stored once instead of recomputed
    wide = cut_lineage(wide)
    gate = dict(cell=cell, minimum_non_degraded_folds=minimum_folds, maximum_worst_degradation=worst)
    contenders = [m for m in models if m != baseline]
    ordered = [baseline, *contenders]
    admitted = column_gate(wide, contenders, baseline, **gate)
    passed = admitted.groupBy(*cell).agg(F.collect_set(F.when(F.col("passed"), F.col("candidate"))).alias("_in"))
    masks = passed.select(*cell, F.array(
        F.lit(True), *[F.array_contains("_in", m) for m in contenders]).alias("mask"))
    weights = oof_weights(gram(wide, ordered, (*cell, "fold"), prefixes, masks=masks, cell=cell), ordered, cell, masks)
    rows = apply_weights(wide, weights, ordered, "_blend", cell)
    if regime:
        special = oof_weights(gram(wide, ordered, (*cell, "fold", regime), prefixes, masks=masks, cell=cell), ordered, cell, masks, regime,
                              minimum_samples, shrinkage)
        rows = apply_weights(rows, special, ordered, "_regime_blend", cell, regime=regime)
        rows = _advance(rows, "_blend", "_regime_blend", "_after_regime", "_regime_ok", cell, gate)
    else:
        rows = rows.withColumn("_after_regime", F.col("_blend")).withColumn("_regime_ok", F.lit(False))
    winners = hard_winner(wide, ordered, cell, prefixes=prefixes, masks=masks)
    if hard_router:
        rows = apply_winner(rows, winners, ordered, "_routed", cell)
        rows = _advance(rows, "_after_regime", "_routed", "_after_router", "_router_ok", cell, gate)
    else:
        rows = rows.withColumn("_after_router", F.col("_after_regime")).withColumn("_router_ok", F.lit(False))
    rows = _advance(rows, baseline, "_after_router", "_final", "_fusion_ok", cell, gate)
    source = (
        F.when(~F.col("_fusion_ok"), baseline).when(F.col("_router_ok"), "hard_router")
        .when(F.col("_regime_ok"), "regime_blend").otherwise("blend"))
    fused = rows.withColumn("source", source).withColumnRenamed("_final", "fused")
    outcome = fused.groupBy(*cell).agg(F.first("source").alias("source"))
    final_weights = weights.where("held IS NULL AND regime IS NULL").select(*cell, "weights")
    final_winner = winners.where("held IS NULL").select(*cell, "winner")
    summary = outcome.join(final_weights, list(cell), "left").join(final_winner, list(cell), "left").join(masks, list(cell), "left")
    return fused.drop("_blend", "_regime_blend", "_after_regime", "_routed", "_after_router", "_regime_ok",
                      "_router_ok", "_fusion_ok"), summary


def _advance(rows: DataFrame, current: str, challenger: str, out: str, flag: str, cell, gate) -> DataFrame:
    """Replace ``current`` by ``challenger`` in the cells where the challenger passes the gate."""
    verdict = column_gate(rows, [challenger], current, **gate).select(*cell, F.col("passed").alias(flag))
    joined = join_small(rows, verdict, cell, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return cut_lineage(joined.withColumn(out, F.when(F.col(flag), F.col(challenger)).otherwise(F.col(current))))


def used_models(summary: DataFrame, models: Sequence[str], baseline: str = "last_value") -> DataFrame:
    """Accepted columns and the models they draw on."""
    names = F.array(*[F.lit(m) for m in models])
    heavy = F.filter(F.zip_with(names, "weights", lambda m, w: F.when(w > 1e-10, m)), lambda m: m.isNotNull() & (m != baseline))
    used = F.when(F.col("source") == "hard_router", F.array("winner")).when(F.col("source") == baseline, F.array().cast("array<string>")).otherwise(heavy)
    used = F.filter(used, lambda m: m != baseline)
    return summary.withColumn("_used", used).agg(
        F.count(F.lit(1)).alias("columns"), F.count_if(F.size("_used") > 0).alias("accepted_columns"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_used")))).alias("models"))
