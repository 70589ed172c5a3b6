"""Correlations of fields with shifted targets, and small least-squares fits from moments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from slotwise.operators.blocks import DEFAULT_BLOCK, beside, block_of, join_small
from slotwise.session import stored


#: Squared deviations below this share of a series' energy are rounding errors of the transforms.
_NOISE = 1e-12
_SUMS = ("rows", "n", "sx", "sy", "sxx", "syy", "sxy")


def shifted_sums(
    x: np.ndarray, y: np.ndarray, place: np.ndarray, size: int, low: int, high: int,
) -> np.ndarray:
    """Sums of every pair (field, target) at every offset of one block, as (field, target, sum, offset).

    ``x`` and ``y`` hold a row per field and target (NaN: missing), ``place`` the slots from the block's start. Fields count in the
    slots [0, size), targets also around it. Each sum is a correlation of values, squares or masks, so all offsets follow from
    one transform per array and one product per sum (overlap-save).
    """
    length = 1 << int(size + high - low).bit_length()
    own = (place >= 0) & (place < size)
    late = (place >= low) & (place < size + high)

    def spectra(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of presence, values and squares of every series."""
        out = np.zeros((len(values), 3, length))
        there = np.isfinite(values)
        clean = np.where(there, values, 0.0)
        out[:, 0, at], out[:, 1, at], out[:, 2, at] = there, clean, clean * clean
        return np.fft.rfft(out, axis=2)

    fields, targets = spectra(x[:, own], place[own]).conj(), spectra(y[:, late], place[late] - low)
    rows = np.zeros((2, length))
    rows[0, place[own]], rows[1, place[late] - low] = 1.0, 1.0
    here, around = np.fft.rfft(rows, axis=1)
    count = high - low + 1
    seen = np.rint(np.fft.irfft(here.conj() * around, length)[:count])
    out = np.empty((len(x), len(y), len(_SUMS), count))
    for i, f in enumerate(fields):
        for j, t in enumerate(targets):
            products = np.stack([f[0] * t[0], f[1] * t[0], f[0] * t[1], f[2] * t[0], f[0] * t[2], f[1] * t[1]])
            sums = np.fft.irfft(products, length, axis=1)[:, :count]
            out[i, j, 0], out[i, j, 1], out[i, j, 2:] = seen, np.rint(sums[0]), sums[1:]
    return out


def lag_moments(
    wide: DataFrame, fields: Sequence[str], targets: Sequence[str], low: int, high: int,
    keys: Sequence[str] = ("series_id",), least_pairs: int = 10, block: int | None = None,
) -> DataFrame:
    """(keys, field, target, offset, pairs, correlation, coefficient, intercept) for every offset.

    A block of slots and its surroundings give the sums of all offsets by transforms, about the means of the series; they are
    added up over the blocks. The cost hardly depends on the number of offsets. offset > 0 is the future.
    """
    columns = list(dict.fromkeys([*fields, *targets]))
    fields, targets = list(fields), list(targets)
    size = max(block or DEFAULT_BLOCK, abs(low), abs(high), 1)
    rows = wide.select(*keys, "pos", *[F.col(c).cast("double").alias(c) for c in columns])
    centres = stored(rows.groupBy(*keys).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"_m_{c}") for c in columns]))
    moved = join_small(rows, centres, keys, ready=True) if keys else beside(rows, centres)
    moved = moved.select(*keys, "pos", *[(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in columns])
    wanted = [block_of("pos", size), block_of(F.col("pos") + max(0, -low), size), block_of(F.col("pos") - max(0, high), size)]
    spread = moved.withColumn("_blk", F.explode(F.array_distinct(F.array(*wanted))))
    schema = T.StructType([
        *[wide.schema[k] for k in keys], T.StructField("field", T.StringType()), T.StructField("target", T.StringType()),
        T.StructField("offset", T.IntegerType()), *[T.StructField(s, T.DoubleType()) for s in (*_SUMS, "ex", "ey")]])
    out_schema, names = to_arrow_schema(schema), list(keys)

    def sums(table: pa.Table) -> pa.Table:
        place = table.column("pos").to_numpy().astype(np.int64) - table.column("_blk")[0].as_py() * size
        values = {c: table.column(c).to_numpy().astype(float) for c in columns}
        x, y = np.stack([values[c] for c in fields]), np.stack([values[c] for c in targets])
        found = shifted_sums(x, y, place, size, low, high)
        own = (place >= 0) & (place < size)
        energy = lambda v: np.nansum(v[:, own] ** 2, axis=1)
        shape = found.shape[:2] + found.shape[3:]
        i, j, k = np.nonzero(found[:, :, 0] > 0)
        made = [pa.array(np.array(fields, object)[i], pa.string()), pa.array(np.array(targets, object)[j], pa.string()),
                pa.array((k + low).astype(np.int32)), *[pa.array(found[i, j, s, k]) for s in range(len(_SUMS))],
                pa.array(np.broadcast_to(energy(x)[:, None, None], shape)[i, j, k]), pa.array(np.broadcast_to(energy(y)[None, :, None], shape)[i, j, k])]
        first = [table.column(c).combine_chunks().take(pa.array(np.zeros(len(i), np.int64))) for c in names]
        return pa.Table.from_arrays([*first, *made], schema=out_schema)

    total = spread.groupBy(*keys, "_blk").applyInArrow(sums, schema).groupBy(*keys, "field", "target", "offset").agg(
        *[F.sum(s).alias(s) for s in (*_SUMS, "ex", "ey")])
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    cross = F.col("sxy") - F.col("sx") * F.col("sy") / n
    usable = (n >= least_pairs) & (vx > _NOISE * F.col("ex")) & (vy > _NOISE * F.col("ey"))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cross / F.sqrt(vx * vy)))
    pick = lambda name, of: F.coalesce(*[F.when(F.col(name) == c, F.col(f"_m_{c}")) for c in of])
    judged = total.select(
        *keys, "field", "target", "offset", n.cast("bigint").alias("pairs"), F.when(usable, r).alias("correlation"),
        F.when(usable, cross / vx).alias("coefficient"), (F.col("sx") / n).alias("_x"), (F.col("sy") / n).alias("_y"))
    placed = join_small(judged, centres, keys, ready=True) if keys else beside(judged, centres)
    intercept = F.col("_y") + pick("target", targets) - F.col("coefficient") * (F.col("_x") + pick("field", fields))
    return placed.select(*keys, "field", "target", "offset", "pairs", "correlation", "coefficient", intercept.alias("intercept"))


# fixed values: risk classes of a correlation with a target value ahead, now and behind
SHIFT_RISKS = ("red_future_diagnostic_only", "amber_current", "green_historical")


def shift_risk(offset: Column) -> Column:
    ahead, now, behind = SHIFT_RISKS
    return F.when(offset > 0, ahead).when(offset == 0, now).otherwise(behind)


def least_squares(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], target: str) -> DataFrame:
    """(keys, n, y_mean, intercept, coefficients array): minimum-norm fit from centred moments.

    Rows stay distributed; the solve sees one row of K x K covariances per group.
    """
    complete = rows.where(complete_row([*fields, target]))
    moments = [F.count(F.lit(1)).alias("n"), F.avg(target).alias("y_mean")]
    moments += [F.avg(f).alias(f"m_{i}") for i, f in enumerate(fields)]
    moments += [F.covar_pop(f, target).alias(f"b_{i}") for i, f in enumerate(fields)]
    moments += [
        F.covar_pop(a, fields[j]).alias(f"g_{i}_{j}") for i, a in enumerate(fields) for j in range(i, len(fields))]
    grouped = complete.groupBy(*keys).agg(*moments)
    k = len(fields)
    schema = T.StructType([
        *[grouped.schema[c] for c in keys], T.StructField("n", T.LongType()), T.StructField("y_mean", T.DoubleType()),
        T.StructField("intercept", T.DoubleType()), T.StructField("coefficients", T.ArrayType(T.DoubleType()))])

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                g = np.array([[row[f"g_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
                b = np.array([row[f"b_{i}"] for i in range(k)], dtype=float)
                ok = np.isfinite(g).all() and np.isfinite(b).all()
                w = np.linalg.pinv(g, rcond=1e-12, hermitian=True) @ b if ok else np.full(k, np.nan)
                m = np.array([row[f"m_{i}"] for i in range(k)], dtype=float)
                out.append([*[row[c] for c in keys], row["n"], row["y_mean"], float(row["y_mean"] - w @ m), w.tolist()])
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    return grouped.mapInPandas(solve, schema)


#: Rows of a group that are kept before they are folded into a triangle, and of all groups of a task before those are sent on.
_FOLD, _HELD = 4096, 1 << 16


def _triangle(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(parts), mode="r")


def least_squares_direct(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], target: str) -> DataFrame:
    """(keys, n, intercept, coefficients array): least squares by a singular value decomposition of the rows themselves.

    Moments square the condition of the fields, and a field of small values next to one of large ones gets lost in them. Here each task folds its
    rows (1, fields, target) into an orthogonal triangle per group, which has the singular values and solutions of the rows; triangles
    of a group are folded again, and one of (K + 2)^2 numbers is solved. The minimum-norm solution, with the intercept among the coefficients.
    """
    complete = rows.where(complete_row([*fields, target]))
    k, names = len(fields), [f"_c{i}" for i in range(len(fields) + 2)]
    seen = complete.select(*keys, F.lit(1).cast("bigint").alias("_n"), F.lit(1.0).alias(names[0]), *[
        F.col(c).cast("double").alias(n) for c, n in zip([*fields, target], names[1:])])
    schema = T.StructType([*[complete.schema[c] for c in keys], T.StructField("n", T.LongType()), T.StructField("intercept", T.DoubleType()),
                           T.StructField("coefficients", T.ArrayType(T.DoubleType()))])
    kinds = {"seen": to_arrow_schema(seen.schema), "fit": to_arrow_schema(schema)}

    def made(kind: str, rows: list[tuple]) -> pa.RecordBatch:
        own = kinds[kind]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(own)], schema=own)

    def table(groups: dict) -> pa.RecordBatch:
        # the count travels in the first row of a triangle
        return made("seen", [(*key, 0 if i else n, *row) for key, (n, parts, _) in groups.items() for i, row in enumerate(_triangle(parts).tolist())])

    def add(groups: dict, batch: pa.RecordBatch) -> tuple[int, tuple]:
        """(rows held beyond before, group of the last row)."""
        values = np.column_stack([batch.column(batch.schema.get_field_index(n)).to_numpy() for n in names])
        count, held = batch.column(batch.schema.get_field_index("_n")).to_numpy(), 0
        number = np.zeros(len(values), np.int64)
        for i in range(len(keys)):
            codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
            number = np.unique(number * (len(values) + 1) + codes, return_inverse=True)[1]
        order = np.argsort(number, kind="stable")
        of = lambda i: tuple(batch.column(c)[i].as_py() for c in range(len(keys)))
        for at in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
            key = of(int(at[0]))
            n, parts, was = groups.get(key, (0, [], 0))
            parts, size = [*parts, values[at]], was + len(at)
            if size >= _FOLD:
                parts = [_triangle(parts)]
                size = len(parts[0])
            groups[key] = (n + int(count[at].sum()), parts, size)
            held += size - was
        return held, of(len(values) - 1)

    def fold(batches):
        groups, held = {}, 0
        for batch in batches:
            if batch.num_rows:
                held += add(groups, batch)[0]
            if held >= _HELD:
                yield table(groups)
                groups, held = {}, 0
        if groups:
            yield table(groups)

    def solved(groups: dict) -> pa.RecordBatch:
        out = []
        for key, (n, parts, _) in groups.items():
            r = _triangle(parts)
            w = np.linalg.lstsq(r[:, : k + 1], r[:, k + 1], rcond=np.finfo(float).eps * max(n, k + 1))[0]
            out.append((*key, n, float(w[0]), w[1:].tolist()))
        return made("fit", out)

    def solve(batches):
        groups = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            # groups come one after another; the last one may go on
            last = add(groups, batch)[1]
            going = {last: groups.pop(last)}
            if groups:
                yield solved(groups)
            groups = going
        if groups:
            yield solved(groups)

    folded = seen.mapInArrow(fold, seen.schema)
    together = folded.repartition(*keys).sortWithinPartitions(*keys) if keys else folded.repartition(1)
    return together.mapInArrow(solve, schema)


def complete_row(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def finite_row(columns: Sequence[str]) -> Column:
    """No value is null, NaN or infinite; null is not passed on."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.abs(F.col(c).cast("double")) < F.lit(float("inf")), F.lit(False))
    return out


def fitted(fields: Sequence[str], intercept: str = "intercept", coefficients: str = "coefficients") -> Column:
    out = F.col(intercept)
    for i, f in enumerate(fields):
        out = out + F.col(f) * F.get(F.col(coefficients), F.lit(i))
    return out


def with_residual(rows: DataFrame, fit: DataFrame, keys: Sequence[str], fields: Sequence[str], target: str) -> DataFrame:
    complete = rows.where(complete_row([*fields, target]))
    joined = complete.join(fit, list(keys)) if keys else beside(complete, fit)
    return joined.withColumn("residual", F.col(target) - fitted(fields))
