"""Quality gates of a model-input matrix: profile, outliers, duplicates, pruning, winsorising.

Column-level results (as many rows as the matrix has columns) may reach the driver, because they
decide which columns the next plan selects; cell values never do.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions.numbers import finite
from slotwise.operators.blocks import carry_last, join_small
from slotwise.operators.clean import CleanRule, clean
from slotwise.operators.grid import widen
from slotwise.operators.order_stats import INTERPOLATIONS, exact_quantiles
from slotwise.plans.contracts import input_frame_rules
from slotwise.session import cut_lineage, stored

QUARTILES = {"q1": 0.25, "q3": 0.75}


def cells(matrix: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series_id", "pos")) -> DataFrame:
    """Long cells (keys, column, value), non-finite values null."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), finite(F.col(c).cast("double")).alias("value")) for c in columns])
    return matrix.select(*keys, F.explode(pairs).alias("_c")).select(*keys, "_c.column", "_c.value")


def tallies(matrix: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series_id", "pos")) -> DataFrame:
    """(column, value, _n): how often each value occurs, null for missing cells; stored, so that the cells are made once."""
    return stored(cells(matrix, columns, keys).groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n")))


def spreads(tally: DataFrame) -> DataFrame:
    """(column, mean, std) of the finite values, population spread, in two passes over the tallies."""
    rows = tally.where("value IS NOT NULL")
    means = stored(rows.groupBy("column").agg((F.sum(F.col("value") * F.col("_n")) / F.sum("_n")).alias("mean")))
    off = F.col("value") - F.col("mean")
    return join_small(rows, means, ["column"], ready=True).groupBy("column").agg(
        F.first("mean").alias("mean"), F.sqrt(F.sum(off * off * F.col("_n")) / F.sum("_n")).alias("std"))


def profile(matrix: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series_id", "pos"), tally: DataFrame | None = None) -> DataFrame:
    """Per column: rows, non-finite, distinct, quartiles, median, mean, population spread. ``tally``: its ``tallies``, if they are there."""
    tally = tallies(matrix, columns, keys) if tally is None else tally
    plain = tally.groupBy("column").agg(
        F.sum("_n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("_n")).otherwise(0)).alias("nonfinite"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("distinct_values"))
    quartiles = exact_quantiles(
        tally, ["column"], F.col("value"), {**QUARTILES, "median": 0.5}, mass=F.col("_n")).drop("n")
    return plain.join(spreads(tally), "column", "left").join(quartiles, "column", "left").select(
        "column", "rows", "nonfinite", "mean", "std", "low", "high", "distinct_values", *[c for c in quartiles.columns if c != "column"])


def outlier_counts(
    matrix: DataFrame, columns: Sequence[str], multiplier: float = 1.5, zscore: float | None = 3.0,
    interpolations: Sequence[str] = INTERPOLATIONS, keys: Sequence[str] = ("series_id", "pos"), tally: DataFrame | None = None,
) -> DataFrame:
    """Per column: cells outside the IQR fence under every interpolation, under any of them, and by z-score."""
    if multiplier <= 0 or (zscore is not None and zscore <= 0):
        raise ValueError("outlier limits must be positive")
    tally = tallies(matrix, columns, keys) if tally is None else tally
    bounds = exact_quantiles(tally, ["column"], F.col("value"), QUARTILES, interpolations, mass=F.col("_n")).drop("n")
    spread = spreads(tally).withColumnsRenamed({"mean": "_m", "std": "_s"})
    rows = join_small(tally.where("value IS NOT NULL"), bounds.join(spread, "column"), ["column"])
    count = lambda hit: F.sum(F.when(hit, F.col("_n")).otherwise(0))
    outside, counts = F.lit(False), []
    for name in interpolations:
        suffix = "" if len(interpolations) == 1 else f"_{name}"
        q1, q3 = F.col(f"q1{suffix}"), F.col(f"q3{suffix}")
        hit = (F.col("value") < q1 - multiplier * (q3 - q1)) | (F.col("value") > q3 + multiplier * (q3 - q1))
        counts.append(count(hit).alias(f"iqr_{name}"))
        outside = outside | hit
    counts.append(count(outside).alias("iqr_any"))
    if zscore is not None:
        far = (F.col("_s") > 0) & (F.abs(F.col("value") - F.col("_m")) > zscore * F.col("_s"))
        counts.append(count(far).alias("zscore"))
    return rows.groupBy("column").agg(*counts)


def signatures(matrix: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series_id", "pos")) -> DataFrame:
    """Order-free fingerprint of every column: xor of row-and-value hashes plus the number of values."""
    long = cells(matrix, columns, keys)
    return long.groupBy("column").agg(
        F.bit_xor(F.xxhash64(*keys, "value")).alias("fingerprint"), F.count("value").alias("filled"))


def duplicate_columns(matrix: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series_id", "pos")) -> list[tuple[str, str]]:
    """(column, first equal column): equal fingerprints confirmed cell by cell in one pass."""
    found: dict[tuple, list[str]] = {}
    marks = {r["column"]: (r["fingerprint"], r["filled"]) for r in signatures(matrix, columns, keys).collect()}
    for c in columns:
        found.setdefault(marks.get(c), []).append(c)
    # within a group of equal fingerprints every column is held against the group's first one; the
    # few that differ (a hash collision) form a group of their own in the next pass
    groups, first = [g for g in found.values() if len(g) > 1], {}
    while groups:
        pairs = [(g[0], other) for g in groups for other in g[1:]]
        same = lambda a, b: finite(F.col(a).cast("double")).eqNullSafe(finite(F.col(b).cast("double")))
        differ = matrix.agg(*[F.count_if(~same(a, b)).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]).first()
        rest: dict[str, list[str]] = {}
        for i, (original, copy) in enumerate(pairs):
            if differ[f"d{i}"]:
                rest.setdefault(original, []).append(copy)
            else:
                first[copy] = original
        groups = [g for g in rest.values() if len(g) > 1]
    return [(c, first[c]) for c in columns if c in first]


def quality_report(matrix: DataFrame, columns: Sequence[str], multiplier: float = 1.5, zscore: float | None = 3.0,
                   interpolations: Sequence[str] = INTERPOLATIONS, keys: Sequence[str] = ("series_id", "pos")) -> DataFrame:
    """Profile, outlier counts and the duplicate mark of every column in one table."""
    tally = tallies(matrix, columns, keys)
    facts = profile(matrix, columns, keys, tally)
    counts = outlier_counts(matrix, columns, multiplier, zscore, interpolations, keys, tally)
    copies = dict(duplicate_columns(matrix, columns, keys))
    mark = F.coalesce(*[F.when(F.col("column") == c, F.lit(o)) for c, o in copies.items()], F.lit(None).cast("string"))
    return facts.join(counts, "column", "left").withColumns({
        "constant": F.col("distinct_values") <= 1, "duplicate_of": mark})


@dataclass
class Pruning:
    kept: list[str]
    all_nonfinite: list[str] = field(default_factory=list)
    constant: list[str] = field(default_factory=list)
    duplicate: list[str] = field(default_factory=list)
    not_in_scoring: list[str] = field(default_factory=list)


def prune_features(
    training: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series_id", "pos"), scoring: DataFrame | None = None,
) -> Pruning:
    """Which features the training period can support and ``scoring`` has too; the first of equal columns stays."""
    missing = [c for c in columns if scoring is not None and c not in scoring.columns]
    columns = [c for c in columns if c not in missing]
    facts = {
        r["column"]: (r["present"], r["low"], r["high"]) for r in
        cells(training, columns, keys).groupBy("column").agg(
            F.count("value").alias("present"), F.min("value").alias("low"), F.max("value").alias("high")).collect()}
    out = Pruning([], not_in_scoring=missing)
    for c in columns:
        present, low, high = facts.get(c, (0, None, None))
        (out.all_nonfinite if not present else out.constant if low == high else out.kept).append(c)
    if out.kept:
        out.duplicate = [c for c, _ in duplicate_columns(training, out.kept, keys)]
        out.kept = [c for c in out.kept if c not in out.duplicate]
    return out


def fill_from_training(scoring: DataFrame, training: DataFrame, columns: Sequence[str], key: str = "series_id") -> DataFrame:
    """Last finite scoring value of the series, else the training median of the column."""
    keys = [key, "pos"]
    medians = exact_quantiles(cells(training, columns, keys), ["column"], F.col("value"), {"_median": 0.5}).drop("n")
    carried = carry_last(cells(scoring, columns, keys), [key, "column"], F.col("value"), "_last")
    filled = join_small(carried, medians, ["column"], "left").withColumn("value", F.coalesce("_last", "_median"))
    return widen(filled, columns, keys, "column")


def repair_scoring(
    training: DataFrame, scoring: DataFrame, origins: DataFrame, rule: CleanRule = CleanRule(), history: int = 672,
) -> tuple[DataFrame, DataFrame]:
    """Causal repair of scoring fields with the tail of training as context, in long form.

    Returns (series_id, pos, field, value) on the origins and counts of repaired cells per field.
    Fields without any training value are left out.
    """
    useful = training.groupBy("field").agg(F.count("value").alias("_n")).where("_n > 0").select("field")
    context = join_small(with_history(training, scoring, history), useful, ["field"], "left_semi")
    cleaned = clean(context, rule)
    # a hole before the first reading of the context is the only one left for the training median
    carried = carry_last(cleaned, ["series_id", "field"], F.col("robust"), "_carried")
    medians = exact_quantiles(training, ["field"], F.col("value"), {"_median": 0.5}).drop("n")
    at_origin = carried.join(origins.select("series_id", "pos").distinct(), ["series_id", "pos"])
    repaired = join_small(at_origin, medians, ["field"]).select(
        "series_id", "pos", "field", F.coalesce("_carried", "_median").alias("value"), "outlier",
        F.col("value").isNull().cast("int").alias("was_missing"))
    counts = repaired.groupBy("field").agg(
        F.sum("was_missing").alias("missing_repairs"), F.sum("outlier").alias("outlier_repairs"))
    return repaired.select("series_id", "pos", "field", "value"), counts


def with_history(training: DataFrame, scoring: DataFrame, history: int = 672) -> DataFrame:
    """Scoring rows preceded by the last ``history`` training slots.

    A training row at or after the first scoring slot gives way; training beyond it is an error.
    """
    if history <= 0:
        raise ValueError("the history must hold at least one slot")
    starts = scoring.groupBy("series_id").agg(F.min("pos").alias("_start"))
    known = training.join(starts, "series_id")
    late = F.raise_error(F.lit("training ends after the scoring start")).cast("boolean")
    tail = known.where(F.when(F.col("pos") > F.col("_start"), late).otherwise(
        (F.col("pos") < F.col("_start")) & (F.col("pos") >= F.col("_start") - history))).drop("_start")
    return tail.unionByName(scoring.select(*tail.columns))


def winsorise(
    matrix: DataFrame, columns: Sequence[str], gate: float = 1.5, clip: float = 1.0, passes: int = 10,
    zscore: float = 3.0, keys: Sequence[str] = ("series_id", "pos"),
) -> tuple[DataFrame, DataFrame]:
    """Clip cells beyond the gate to an inner fence until none is left; drop what cannot be mended.

    Every pass reads fences of all columns in one aggregation, clips in one projection and stores
    the result in the shared checkpoint folder. Returns (matrix, log of columns and passes).
    """
    if not 0 < clip < gate or passes <= 0:
        raise ValueError("the clip fence must lie inside the gate")
    spark = matrix.sparkSession
    log: list[tuple[int, str, str, int]] = []
    facts = profile(matrix, columns, keys).collect()
    broken = [r["column"] for r in facts if r["nonfinite"]]
    if broken:
        raise ValueError(f"matrix holds missing cells: {broken[:5]}")
    flat = [r["column"] for r in facts if r["distinct_values"] <= 1]
    kept = [c for c in columns if c not in flat]
    log += [(0, c, "constant", 0) for c in flat]
    twins = [c for c, _ in duplicate_columns(matrix, kept, keys)] if kept else []
    kept = [c for c in kept if c not in twins]
    log += [(0, c, "duplicate", 0) for c in twins]
    out = matrix.select(*keys, *[F.col(c).cast("double").alias(c) for c in kept])
    for number in range(1, passes + 1):
        if not kept:
            break
        fences = {
            r["column"]: (r["q1"], r["q3"]) for r in
            exact_quantiles(cells(out, kept, keys), ["column"], F.col("value"), QUARTILES).collect()}
        clipped, hits = {}, []
        for c in kept:
            q1, q3 = fences[c]
            spread, v = q3 - q1, F.col(c)
            far = (v < q1 - gate * spread) | (v > q3 + gate * spread)
            hits.append(F.count_if(far).alias(c))
            clipped[c] = F.least(F.greatest(v, F.lit(q1 - clip * spread)), F.lit(q3 + clip * spread))
        found = out.agg(*hits).first()
        touched = {c: found[c] for c in kept if found[c]}
        if not touched:
            break
        log += [(number, c, "winsorised", n) for c, n in touched.items()]
        # a column with a far cell is clipped as a whole, the others stay as they are
        out = cut_lineage(out.withColumns({c: clipped[c] for c in touched}))
        spans = out.agg(*[(F.min(c) == F.max(c)).alias(c) for c in kept]).first()
        flat = [c for c in kept if spans[c]]
        log += [(number, c, "constant", 0) for c in flat]
        kept = [c for c in kept if c not in flat]
        out = out.drop(*flat)
    if kept:
        twins = [c for c, _ in duplicate_columns(out, kept, keys)]
        kept = [c for c in kept if c not in twins]
        log += [(passes + 1, c, "duplicate", 0) for c in twins]
        out = out.drop(*twins)
    if kept:
        rest = outlier_counts(out, kept, gate, zscore, keys=keys).where("iqr_any > 0 OR zscore > 0").collect()
        log += [(passes + 1, r["column"], "residual_outliers", max(r["iqr_any"], r["zscore"])) for r in rest]
        out = out.drop(*[r["column"] for r in rest])
        kept = [c for c in kept if c not in {r["column"] for r in rest}]
    if not kept:
        raise ValueError("no column is left after winsorising")
    return out, spark.createDataFrame(log or [], "pass int, column string, action string, cells bigint")


def reread_input(
    spark: SparkSession, path: str, columns: Sequence[str], origins: DataFrame, key: str = "series_id",
) -> tuple[DataFrame, DataFrame]:
    """Gate of a stored input matrix: its contract (one row per expected series) and its quality report, from what is on disk."""
    frame = spark.read.parquet(path)
    return input_frame_rules(frame, columns, key, origins), quality_report(frame, columns, keys=(key, "pos"))


def assemble_input(raw: DataFrame, features: DataFrame, keys: Sequence[str] = ("series_id", "pos"), prefix: str = "feat_") -> DataFrame:
    """Repaired raw fields beside pruned features; derived names carry the prefix, no name twice."""
    derived = [c for c in features.columns if c not in keys]
    wrong = [c for c in derived if not c.startswith(prefix)]
    clash = set(derived) & set(raw.columns) - set(keys)
    if wrong or clash:
        raise ValueError(f"derived names must start with {prefix} and be new: {wrong or sorted(clash)}")
    return raw.join(features, list(keys))

