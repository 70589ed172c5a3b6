"""Ridge paths: every family of features, every penalty and every output of a target from one pass over its rows.

One aggregate gives the moments of all features and labels of a target (the Gram matrix with a block of labels). Each family of
features is a part of that matrix; its eigen-decomposition gives the solutions of all penalties.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.functions.numbers import finite, safe_ratio
from slotwise.operators.blocks import join_small, with_halo
from slotwise.operators.order_stats import exact_quantiles

#: Gram matrices that a task holds before it sends them on.
HELD = 256


def ratio_labels(features: DataFrame, horizons: Sequence[int], keys: Sequence[str] = ("series_id", "field"), block: int | None = None) -> DataFrame:
    """``features`` with ``ratio_<h>``: the value h slots later over the value now, less one."""
    return with_halo(features, list(keys), lambda rows, w: rows.withColumns({
        f"ratio_{h}": finite(safe_ratio(F.lead("value", int(h)).over(w), F.col("value")) - 1) for h in horizons}), ahead=max(horizons), block=block)


def medians(rows: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, _medians): the median of each feature, null for one without a value. All features are ranked in one run."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), finite(n).alias("x")) for i, n in enumerate(names)]))
    long = rows.select(*keys, cells.alias("_c")).select(*keys, F.col("_c.i").alias("_i"), "_c.x")
    found = exact_quantiles(long, [*keys, "_i"], F.col("x"), {"_median": 0.5})
    return found.groupBy(*keys).agg(F.array(*[F.max(F.when(F.col("_i") == i, F.col("_median"))) for i in range(len(names))]).alias("_medians"))


def filled(names: Sequence[str], middle: Column) -> Column:
    """Features as an array of distances from their medians; a missing one lies at the median."""
    return F.array(*[F.coalesce(finite(n) - F.get(middle, F.lit(i)), F.lit(0.0)) for i, n in enumerate(names)])


def grams(rows: DataFrame, names: Sequence[str], labels: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, _gram): sums of products of (1, features, labels) as rows (i, j, s) with i <= j, from ``_x`` and ``labels``.

    A task adds up the batches of a key and sends one matrix; the matrices are added by a plain aggregate.
    """
    size = 1 + len(names) + len(labels)
    upper = np.triu_indices(size)
    types = [rows.schema[k] for k in keys]
    schema = T.StructType([*types, T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("s", T.DoubleType())])

    def emit(held):
        for key, matrix in held.items():
            frame = pd.DataFrame({"i": upper[0].astype(np.int32), "j": upper[1].astype(np.int32), "s": matrix[upper]})
            for place, (name, value) in enumerate(zip(keys, key)):
                frame.insert(place, name, value)
            yield frame

    def add(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, mine in batch.groupby(list(keys), sort=False):
                key = key if isinstance(key, tuple) else (key,)
                z = np.column_stack([np.ones(len(mine)), np.stack(mine["_x"].to_numpy()), np.stack(mine["_y"].to_numpy())])
                held[key] = held.get(key, 0.0) + z.T @ z
            if len(held) >= HELD:
                yield from emit(held)
                held = {}
        yield from emit(held)

    packed = rows.select(*keys, "_x", F.array(*[F.col(c).cast("double") for c in labels]).alias("_y"))
    sums = packed.mapInPandas(add, schema).groupBy(*keys, "i", "j").agg(F.sum("s").alias("s"))
    return sums.groupBy(*keys).agg(F.collect_list(F.struct("i", "j", "s")).alias("_gram"))


def solve_paths(gram: np.ndarray, inputs: int, family: Sequence[int], alphas: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(intercepts, coefficients, scales) by alpha and output: least squares of the standardised features plus alpha times their squares.

    Coefficients and scales are those of the features as they came; a feature outside the family has zero. Standard deviations are of
    the population; a constant feature counts as it is.
    """
    n, ins, outs = gram[0, 0], 1 + np.array(list(family), int), np.arange(1 + inputs, len(gram))
    mean, label = gram[0, ins] / n, gram[0, outs] / n
    inner = gram[np.ix_(ins, ins)] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(inner), 0.0) / n)
    flat = scale <= 1e-12 * (1.0 + np.abs(mean))
    scale = np.where(flat, 1.0, scale)
    inner = inner / np.outer(scale, scale)
    cross = (gram[np.ix_(ins, outs)] - n * np.outer(mean, label)) / scale[:, None]
    inner[flat], inner[:, flat], cross[flat] = 0.0, 0.0, 0.0
    values, vectors = np.linalg.eigh(inner)
    turned = vectors.T @ cross
    out = np.zeros((len(alphas), len(outs), inputs))
    for k, alpha in enumerate(alphas):
        solved = vectors @ (turned / (np.maximum(values, 0.0) + alpha)[:, None]) / scale[:, None]
        out[k][:, ins - 1] = solved.T
    wide = np.zeros(inputs)
    wide[ins - 1] = mean
    scales = np.zeros(inputs)
    scales[ins - 1] = scale
    return label[None, :] - out @ wide, out, scales


def ridge_paths(
    rows: DataFrame, labels: Mapping[int, str], families: Mapping[str, Sequence[str]], alphas: Sequence[float], keys: Sequence[str] = ("field",),
) -> DataFrame:
    """(keys, family, alpha, horizon, rows, names, medians, intercept, coefficients, scales): a model per row.

    ``labels`` names the label column of each horizon. Rows without one of them are left out; missing features lie at the median of
    their target; features are standardised and the intercept isn't penalised. No row: no model.
    """
    if not alphas or min(alphas) <= 0:
        raise ValueError("penalties must be above zero")
    names = list(dict.fromkeys(n for family in families.values() for n in family))
    rows = rows.where(F.forall(F.array(*[finite(c) for c in labels.values()]), lambda v: v.isNotNull()))
    middle = medians(rows, names, keys)
    staged = join_small(rows, middle, list(keys)).withColumn("_x", filled(names, F.col("_medians")))
    found = grams(staged, names, list(labels.values()), keys).join(middle, list(keys))
    schema = T.StructType([
        *[rows.schema[k] for k in keys], T.StructField("family", T.StringType()), T.StructField("alpha", T.DoubleType()),
        T.StructField("horizon", T.IntegerType()), T.StructField("rows", T.LongType()), T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("medians", T.ArrayType(T.DoubleType())), T.StructField("intercept", T.DoubleType()),
        T.StructField("coefficients", T.ArrayType(T.DoubleType())), T.StructField("scales", T.ArrayType(T.DoubleType()))])
    places = {name: [names.index(n) for n in family] for name, family in families.items()}
    steps, size = [int(h) for h in labels], 1 + len(names) + len(labels)

    def solve(batches):
        for batch in batches:
            out = []
            for record in batch.to_dict("records"):
                gram = np.zeros((size, size))
                for cell in record["_gram"]:
                    gram[cell["i"], cell["j"]] = gram[cell["j"], cell["i"]] = cell["s"]
                for family, place in places.items():
                    intercepts, coefficients, scales = solve_paths(gram, len(names), place, alphas)
                    for k, alpha in enumerate(alphas):
                        for h, horizon in enumerate(steps):
                            out.append([*[record[key] for key in keys], family, float(alpha), horizon, int(round(gram[0, 0])), names,
                                        list(record["_medians"]), float(intercepts[k, h]), coefficients[k, h].tolist(), scales.tolist()])
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return found.mapInPandas(solve, schema)


def predict_paths(rows: DataFrame, models: DataFrame, names: Sequence[str], keys: Sequence[str] = ("field",)) -> DataFrame:
    """``rows`` for every model of their target, with ``predicted``: the label that the model gives. ``names``: the models' names, in order."""
    joined = join_small(rows, models, list(keys)).withColumn("_x", filled(names, F.col("medians")))
    gain = F.aggregate(F.zip_with("_x", "coefficients", lambda x, c: x * c), F.lit(0.0), lambda a, b: a + b)
    return joined.withColumn("predicted", F.col("intercept") + gain)


def unsolved(rows: DataFrame, models: DataFrame, labels: Mapping[int, str], names: Sequence[str], keys: Sequence[str] = ("field",)) -> DataFrame:
    """(keys, family, alpha, horizon, rows, residual): how far each model is from its normal equations, recomputed from the rows.

    The penalty's pull on each standardised feature must equal the errors' and the errors must add up to zero; ``residual`` is the
    largest difference per row.
    """
    whole = rows.where(F.forall(F.array(*[finite(c) for c in labels.values()]), lambda v: v.isNotNull()))
    label = F.coalesce(*[F.when(F.col("horizon") == int(h), F.col(c)) for h, c in labels.items()])
    told = predict_paths(whole, models, names, keys).withColumn("_miss", label - F.col("predicted"))
    pull = [F.sum(F.get("_x", F.lit(i)) * F.col("_miss")).alias(f"_p_{i}") for i in range(len(names))]
    sums = told.groupBy(*keys, "family", "alpha", "horizon").agg(F.count(F.lit(1)).alias("_n"), F.sum("_miss").alias("_s"), *pull)
    both = sums.join(models, [*keys, "family", "alpha", "horizon"])
    scale, weight = (lambda i: F.get("scales", F.lit(i))), (lambda i: F.get("coefficients", F.lit(i)))
    apart = [F.when(scale(i) > 0, F.abs(F.col(f"_p_{i}") / scale(i) - F.col("alpha") * weight(i) * scale(i))).otherwise(0.0) for i in range(len(names))]
    return both.select(*keys, "family", "alpha", "horizon", F.col("_n").alias("rows"), (F.greatest(F.abs("_s"), *apart) / F.col("_n")).alias("residual"))
